"""Physical plan properties: pushdown, pruning, no single-partition sort of raw rows."""
import datetime as dt

import pytest

from churnlens.functions.dates import Calendar
from churnlens.operators import churn, monthly, rfm
from churnlens.sources import tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_purchase_filter_pushed_and_columns_pruned(spark):
    ev = tables.click_events(spark, SF)
    p = _plan(rfm.rfm_base(ev))
    assert "EqualTo(event_type,purchase)" in p
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p


def test_orders_scan_reads_three_columns(spark):
    p = _plan(rfm.rfm_base(tables.order_events(spark, SF)))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in p


def test_single_pass_snapshot_plans_scan_once(spark):
    ev = tables.order_events(spark, SF)
    full = Calendar.from_data(ev)
    one = Calendar(full.last, full.last)
    for op in (monthly.monthly_rfm_base, churn.churn_status):
        p_full, p_one = _plan(op(ev, full)), _plan(op(ev, one))
        # no per-snapshot union: the plan does not grow with the calendar (80 snapshots vs 1)
        assert p_full.count("FileScan parquet") == p_one.count("FileScan parquet") <= 3
        assert p_full.count("Union") == p_one.count("Union") <= 1


def test_no_single_partition_exchange_of_user_rows(spark):
    """Scores, ranks and sums are ordered by range partitions; what reaches one partition
    is one row per range partition and group."""
    from pyspark.sql import functions as F

    from churnlens.functions.ntile import ntiles
    from churnlens.functions.ranks import average_ranks, prefix_sum
    df = spark.range(5000).selectExpr("id AS user_id", "id % 7 AS k", "1 AS w")
    for out in (ntiles(df, 5, [("k", True, "a"), ("user_id", False, "b")]),
                prefix_sum(df, [F.col("k").asc(), F.col("user_id").asc()], "w", "s"), average_ranks(df, "k")):
        out.collect()
        assert "SinglePartition" not in _plan(out), _plan(out)


def test_one_scan_of_the_orders_feeds_all_period_tables(spark, monkeypatch):
    """A5, A12, A13, A14 and A26 read one (user, period) table."""
    from churnlens.plans import catalog
    calls = []
    build = monthly.user_period
    monkeypatch.setattr(monthly, "user_period", lambda *a, **k: calls.append(1) or build(*a, **k))
    monkeypatch.setattr(catalog, "_MEMO", {})
    for name in ("monthly_rfm_base", "cohort_retention", "cohort_age_metrics", "cohort_segment_retention", "churn_status"):
        catalog.queries()[name](spark, SF).count()
    assert len(calls) == 1


@pytest.mark.parametrize("first, last", [((1995, 2, 1), (2001, 8, 1)), ((1995, 1, 1), (2001, 7, 1))])
def test_segment_path_fails_on_orders_outside_its_calendar(spark, monkeypatch, first, last):
    """The pivot would drop the first or the last month of the orders."""
    from churnlens.plans import catalog
    monkeypatch.setattr(catalog, "ORDERS_CALENDAR", Calendar(dt.date(*first), dt.date(*last)))
    with pytest.raises(ValueError, match="1995-01-01 to 2001-08-01"):
        catalog.queries()["segment_path"](spark, SF)


def test_churn_statistics_read_intervals_only(spark):
    """A15-A17 make no row per user and snapshot: what they read are a few intervals a user, and
    every table between is bounded by the calendar."""
    from churnlens.plans import catalog
    sf = "/root/testdata/sf0.001"
    intervals, rows = catalog.churn_intervals_df(spark, sf), catalog.churn_df(spark, sf)
    purchases = catalog.user_period_df(spark, sf).count()
    cal = catalog.orders_calendar(spark, sf)
    assert intervals.count() <= 4 * purchases and intervals.count() < rows.count() / 2
    assert intervals.selectExpr("sum(last_idx - first_idx + 1)").first()[0] == rows.count()
    assert churn._user_counts(intervals, cal).count() <= 4 * cal.n
    for query in ("churn_stats", "churn_transition", "churn_loss_estimate", "last_purchase_category"):
        plan = catalog.queries()[query](spark, sf)._jdf.queryExecution().toString()
        assert "sequence(first_idx" not in plan, query


@pytest.mark.parametrize("grain, first, last", [("month", "2020-01-01", "2020-07-01"), ("week", "2020-01-06", "2020-03-30")])
def test_intervals_equal_rows(spark, events, grain, first, last):
    """The statistics of the intervals equal those of the expanded rows, also where purchases lie
    outside the calendar."""
    import datetime as dt
    import random
    rnd = random.Random(3)
    day = dt.date(2019, 11, 1)
    ev = events([(u, str(day + dt.timedelta(days=rnd.randrange(330))), rnd.choice(["purchase", "purchase", "view"]), rnd.randrange(1, 90))
                 for u in range(40) for _ in range(rnd.randrange(1, 9))])
    cal = Calendar(dt.date.fromisoformat(first), dt.date.fromisoformat(last), grain)
    params = churn.DEFAULT.with_(grain=grain, active_days=20, risk_days=45)
    intervals = churn.churn_intervals(ev, cal, params)
    rows = churn.churn_status(ev, cal, params).cache()
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    trans = churn.churn_transition(rows)
    assert rows.select("segment").distinct().count() == 4 and trans.count() > 10
    assert same(churn.interval_stats(intervals, cal), churn.churn_stats(rows))
    assert same(churn.interval_transition(intervals, cal), trans)
    for dedup in (False, True):
        assert same(churn.interval_loss_estimate(intervals, cal, dedup), churn.churn_loss_estimate(rows, trans, cal, dedup))
    rows.unpersist()


def test_result_tables_are_ordered(spark):
    """A10, A12, A16 and A19 come in the order of the original's result tables."""
    from churnlens.plans import catalog
    orders = {"segment_transition_uplift": ["prev_segment", "curr_segment", "snapshot_month"],
              "cohort_retention": ["cohort_date", "cohort_age"],
              "churn_transition": ["snapshot_date", "prev_segment", "curr_segment"],
              "last_purchase_category": ["segment", "-last_purchase_cnt", "category_id"]}
    for name, columns in orders.items():
        rows = catalog.queries()[name](spark, "/root/testdata/sf0.001").collect()
        keys = [tuple(-r[c[1:]] if c[0] == "-" else r[c] for c in columns) for r in rows]
        assert len(keys) > 5 and keys == sorted(keys), name


def test_one_order_for_a_test_battery(spark):
    """The median and the signed ranks of all metrics come from one range order."""
    from churnlens.stats import tests as st
    df = spark.range(400).selectExpr("id % 200 AS user_id", "IF(id < 200, 'past', 'current') AS point_of_view",
                                     "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 11 AS DOUBLE) AS b")
    plan = st.test_battery({"t": (df, ["a", "b"])})._jdf.queryExecution().toString()
    assert plan.count("SinglePartition") == 0
    physical = plan[plan.index("== Physical Plan"):]
    assert physical.count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" not in physical


def test_user_keyed_marts_join_without_a_shuffle(spark, tmp_path):
    """A13, A18, A20 and A25 over bucketed marts: no exchange below their joins."""
    from churnlens.config import WEEKLY_EVENTS as W
    from churnlens.operators import behaviour, cohort
    from churnlens.plans.marts import CO_LOCATED, bucketed_name, put_bucketed
    root, orders, clicks = f"file:{tmp_path}", tables.order_events(spark, SF), tables.click_events(spark, SF)
    cal, wcal = Calendar.from_data(orders), Calendar.from_data(clicks, grain="week")
    keep = {"spark.sql.autoBroadcastJoinThreshold": "-1", **CO_LOCATED}
    plain = {}
    try:
        for bucketed in (False, True):
            put = (lambda n, df: put_bucketed(df, root, n, 4)) if bucketed else (lambda n, df: df)
            up, mrfm = put("up", monthly.user_period(orders)), put("mrfm", monthly.monthly_rfm(monthly.monthly_rfm_base(orders, cal)))
            ev = put("ev", clicks)
            ch = put("ch", churn.churn_status(clicks, wcal, W))
            wm = put("wm", monthly.monthly_rfm(monthly.monthly_rfm_base(clicks, wcal, W), W))
            if bucketed:
                for k, v in keep.items():
                    spark.conf.set(k, v)
            results = {"A13": cohort.cohort_segment_retention(orders, mrfm, up=up), "A18": behaviour.pre_snapshot_activity(ev, ch, wcal, W),
                       "A20": behaviour.churn_event_funnel(ev, ch, wcal, W), "A25": behaviour.high_segment_behaviour(ev, wm, wcal, W)}
            for name, df in results.items():
                rows = sorted(map(str, df.collect()))
                if not bucketed:
                    plain[name] = rows
                    continue
                assert rows == plain[name] and rows, name
                plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin" in plan, name
                assert "Exchange" not in plan[plan.index("SortMergeJoin"):], (name, plan)
    finally:
        for k in keep:
            spark.conf.unset(k)
        for n in ("up", "mrfm", "ev", "ch", "wm"):
            spark.sql(f"DROP TABLE IF EXISTS {bucketed_name(root, n)}")


def test_a_user_of_many_categories_is_split(spark, events):
    """A user with most of the (snapshot, category) pairs meets them in many tasks; the result
    does not depend on the size of the parts."""
    import datetime as dt

    from pyspark.sql import functions as F

    from churnlens.operators import category
    rows = [(1, f"2020-0{m}-0{1 + c % 9}", "purchase", 1 + c, f"c{c}", f"code{c}") for m in (1, 2, 3) for c in range(200)]
    rows += [(u, f"2020-0{1 + u % 3}-11", "purchase", u, f"c{u % 50}", None) for u in range(2, 80)]
    ev = events(rows)
    cal = Calendar(dt.date(2020, 1, 1), dt.date(2020, 3, 1))
    mrfm = monthly.monthly_rfm(monthly.monthly_rfm_base(ev, cal)).cache()
    same = [sorted(map(str, category.monthly_rfm_category(ev, mrfm, cal, part=part).collect())) for part in (7, 4096)]
    assert same[0] == same[1] and len(same[0]) > 400
    uc = ev.groupBy("user_id", "category_id").agg(F.trunc(F.min("event_time"), "month").alias("first_start"))
    m = mrfm.select("user_id", "rfm_segment", F.trunc("snapshot_date", "month").alias("snap_start"))
    keep = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    try:
        for k, v in keep.items():
            spark.conf.set(k, v)
        held = category._held_categories(m, uc, 7).where("user_id = 1")
        sizes = [r["count"] for r in held.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        for k in keep:
            spark.conf.unset(k)
    assert sum(sizes) == 600 and len(sizes) >= 5 and max(sizes) < 300
    mrfm.unpersist()
