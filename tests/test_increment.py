"""Snapshots appended from the stored state equal the full build."""
import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from churnlens.config import DEFAULT
from churnlens.functions.dates import Calendar, py_add_periods
from churnlens.operators import churn, cohort, increment, monthly, rfm
from churnlens.sources.mart import read_mart


def _tmp():
    return tempfile.mkdtemp(prefix="churnlens-inc-", dir="/tmp")


def same(a, b):
    b = b.select(*a.columns)
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert rows(a) == rows(b)


def _events(events, days, users=40, seed=5, gap=None):
    rnd, day = random.Random(seed), dt.date(2020, 1, 3)
    rows = []
    for u in range(users):
        for _ in range(rnd.randrange(1, 9)):
            d = day + dt.timedelta(days=rnd.randrange(days))
            if gap is None or not gap[0] <= d < gap[1]:
                rows.append((u, str(d), rnd.choice(["purchase", "purchase", "view"]), rnd.randrange(1, 90)))
    return events(rows)


@pytest.mark.parametrize("grain, days, gap", [("week", 40, None), ("month", 170, (dt.date(2020, 5, 1), dt.date(2020, 6, 1)))])
def test_appends_equal_a_full_build(spark, events, grain, days, gap):
    """Also with a period without any event."""
    ev, root = _events(events, days, gap=gap).cache(), _tmp()
    params = DEFAULT.with_(grain=grain, active_days=20, risk_days=45)
    cal = Calendar.from_data(ev, grain=grain)
    start = py_add_periods(cal.last, -2, grain)
    increment.seed(ev, root, start, params, buckets=4)
    for k in (1, 2):
        increment.append_period(ev, root, py_add_periods(start, k, grain), params)
    assert increment.last_period(spark, root) == cal.last
    same(read_mart(spark, root, "monthly_churn"), churn.churn_status(ev, cal, params))
    same(read_mart(spark, root, "monthly_rfm"), monthly.monthly_rfm(monthly.monthly_rfm_base(ev, cal, params), params))
    same(increment.stored_rfm_base(spark, root, cal.last), rfm.rfm_base(ev, params))
    same(cohort.cohort_retention(None, params, ages=increment.stored_cohort_ages(spark, root)), cohort.cohort_retention(ev, params))
    ev.unpersist()


def test_last_period_again_with_late_events(spark, events):
    """Appending the last period again replaces it; other periods are refused."""
    rows = [(1, "2020-01-05", "purchase", 3), (2, "2020-01-09", "purchase", 4), (1, "2020-02-07", "purchase", 5)]
    late = rows + [(2, "2020-02-20", "purchase", 7), (3, "2020-02-21", "purchase", 8)]
    root, jan, feb, mar = _tmp(), dt.date(2020, 1, 1), dt.date(2020, 2, 1), dt.date(2020, 3, 1)
    with pytest.raises(ValueError, match="seed"):
        increment.append_period(events(rows), root, feb)
    increment.seed(events(rows), root, jan, buckets=2)
    increment.append_period(events(rows), root, feb)
    increment.append_period(events(late), root, feb)
    same(read_mart(spark, root, "monthly_churn"), churn.churn_status(events(late), Calendar(jan, feb)))
    same(increment.stored_rfm_base(spark, root, feb), rfm.rfm_base(events(late)))
    for bad, message in ((jan, "not follow"), (dt.date(2020, 4, 1), "not follow"), (dt.date(2020, 3, 2), "start of a month")):
        with pytest.raises(ValueError, match=message):
            increment.append_period(events(late), root, bad)
    increment.append_period(events(late), root, mar)
    assert read_mart(spark, root, "monthly_churn", where="snapshot_date = '2020-03-31'").count() == 3


def test_append_reads_its_month_and_never_shuffles_the_state(spark, events):
    """The month's bounds reach the scan; the bucketed state meets the new buyers without an exchange,
    also in a session whose catalog does not know it."""
    ev, root = _events(events, 120), _tmp()
    path = _tmp() + "/events"
    ev.write.parquet(path)
    ev = spark.read.parquet(path)
    increment.seed(ev, root, dt.date(2020, 3, 1), buckets=4)
    table, _ = increment._state_table(root, dt.date(2020, 3, 1))
    spark.sql(f"DROP TABLE {table}")
    state = increment.read_state(spark, root, dt.date(2020, 3, 1))
    totals = increment.period_totals(ev, dt.date(2020, 4, 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = increment.merge_state(state, totals, dt.date(2020, 4, 1), 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(event_time,2020-04-01" in plan and "LessThan(event_time,2020-05-01" in plan
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    # from the join down to the state's scan, its first child
    state_side = plan[plan.index("SortMergeJoin"):plan.index("SelectedBucketsCount")]
    assert state_side.count("FileScan") == 1 and "Exchange" not in state_side, plan


def test_buckets_grow_with_the_purchases(spark, events, monkeypatch):
    ev, root = _events(events, 120), _tmp()
    monkeypatch.setattr(increment, "BUCKET_PURCHASES", 9)
    increment.seed(ev, root, dt.date(2020, 4, 1))
    bought = ev.where("event_type = 'purchase' AND event_time < '2020-05-01'").count()
    assert read_mart(spark, root, "periods").first().buckets == -(-bought // 9) > increment.LEAST_BUCKETS


def test_first_build_shuffles_no_row_by_user_again(spark, events):
    """The status runs and the cohorts read the purchases bucketed by user; the runs are not
    filtered by an interpreted function."""
    ev, root = _events(events, 120), _tmp()
    up = increment._seed_user_period(ev, root, DEFAULT, 4)
    same(up, monthly.user_period(ev))
    cal = Calendar.from_data(ev)
    for df in (churn.churn_status(ev, cal, up=up), cohort.cohort_base(ev, up=up)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(user_id" not in plan and "Window" in plan, plan
    assert "explode(filter" not in churn.churn_status(ev, cal, up=up)._jdf.queryExecution().optimizedPlan().toString()
