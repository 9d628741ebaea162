"""Snapshots appended one period at a time from a stored state of each buyer
(S7 with A1, A5, A6, A12 and A14).

A snapshot's figures need little of a user's past: the first period, the last purchase and
the sums.  That *state* has one row per buyer, is merged with the new period's
purchases, and is kept bucketed by user: the merge shuffles the buyers of the new period and
never the state.  An append reads the events of its period, the state before it and one row
per earlier period; no older event is read again.

Tables under ``root``:

* ``user_state/<period>``   user_id, first_start, last_date, last_ts, cnt, spend up to the period,
                            period_cnt, period_spend in it; bucketed and sorted by user_id;
* ``monthly_rfm``, ``monthly_churn``  by snapshot_date, ``cohort_ages`` by order_date: an append
                            replaces its own partition only;
* ``periods``               one row per period: last event day, last purchase day, buckets.  It is
                            written last, so a period without a row was not finished and is done anew.

The last period may be appended again (late events), any other must follow it.

The first build keeps the (user, period) purchases bucketed by user too: the state, the status runs
and the cohorts read them with no further shuffle, and a task writes the status rows of its own
users, so the rows of all users and snapshots, by far the most, are never shuffled.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, Params
from ..functions.dates import Calendar, period_start, periods_between, py_add_periods, py_period_end, py_period_start
from ..sources.mart import attach_bucketed, mart_exists, mart_path, read_mart, write_bucketed, write_mart
from ..sources.tables import purchases
from .churn import churn_status
from .cohort import cohort_base
from .monthly import monthly_rfm, monthly_rfm_base, user_period

MONEY = "decimal(18,2)"
#: Purchases for each bucket of users, and the least buckets, where ``seed`` is given no number.
BUCKET_PURCHASES, LEAST_BUCKETS = 500_000, 8


def _root_name(root: str) -> str:
    return hashlib.sha1(root.rstrip("/").encode()).hexdigest()[:12]


def _state_table(root: str, period: dt.date) -> tuple[str, str]:
    """Catalog name and folder of the state at the end of ``period``."""
    return f"user_state_{_root_name(root)}_{period:%Y%m%d}", mart_path(root, f"user_state/{period}")


def read_state(spark: SparkSession, root: str, period: dt.date) -> DataFrame:
    """The stored state at the end of ``period``, known to Spark as bucketed by user_id."""
    row = read_mart(spark, root, "periods", where=f"period_start = DATE'{period}'").first()
    if row is None:
        raise ValueError(f"no state of {period}")
    table, path = _state_table(root, period)
    return attach_bucketed(spark, table, path, "user_id", row["buckets"])


def _write_state(state: DataFrame, root: str, period: dt.date, buckets: int) -> DataFrame:
    table, path = _state_table(root, period)
    write_bucketed(state, table, "user_id", buckets, path=path)
    return state.sparkSession.table(table)


def _write_period(days: DataFrame, root: str, buckets: int) -> None:
    """``days``: (period_start, last_event_day, last_purchase_day)."""
    _write_by(days.withColumn("buckets", F.lit(buckets)), root, "periods", "period_start")


def _days(events: DataFrame, params: Params) -> list[Column]:
    day = F.to_date("event_time")
    return [F.max(day).alias("last_event_day"),
            F.max(F.when(F.col("event_type") == params.purchase_type, day)).alias("last_purchase_day")]


def _write_by(df: DataFrame, root: str, name: str, by: str) -> None:
    """Write ``df`` partitioned by ``by``, rows dealt by it first so that tasks write few files;
    a period beyond the advisory partition size is split among tasks."""
    write_mart(df.hint("rebalance", by), root, name, partition_by=(by,))


def _seed_user_period(events: DataFrame, root: str, params: Params, buckets: int) -> DataFrame:
    """The (user, period) purchases, bucketed by user: one file a bucket."""
    table = f"seed_user_period_{_root_name(root)}"
    write_bucketed(user_period(events, params).repartition(buckets, "user_id"), table, "user_id", buckets,
                   path=mart_path(root, "_seed_user_period"))
    return events.sparkSession.table(table)


def seed(events: DataFrame, root: str, through: dt.date, params: Params = DEFAULT, buckets: int | None = None) -> None:
    """Build the tables from the whole history up to the period that starts at ``through``, in
    one pass over the periods (the operators of the full build).  Without ``buckets`` their
    number grows with the purchases."""
    g = params.grain
    events = events.where(F.col("event_time") < _instant(events, py_add_periods(through, 1, g)))
    cal = Calendar(Calendar.from_data(events, grain=g).first, through, g)
    if buckets is None:
        buckets = max(LEAST_BUCKETS, -(-purchases(events, params.purchase_type).count() // BUCKET_PURCHASES))
    up = _seed_user_period(events, root, params, buckets)
    here = F.col("period_start") == F.lit(through)
    state = up.groupBy("user_id").agg(
        F.min("period_start").alias("first_start"), F.max("last_date").alias("last_date"), F.max("last_ts").alias("last_ts"),
        F.sum("cnt").alias("cnt"), F.sum("spend").cast(MONEY).alias("spend"),
        F.coalesce(F.sum(F.when(here, F.col("cnt"))), F.lit(0)).alias("period_cnt"),
        F.coalesce(F.sum(F.when(here, F.col("spend"))), F.lit(0)).cast(MONEY).alias("period_spend"))
    _write_state(state, root, through, buckets)
    base = monthly_rfm_base(events, cal, params, up=up)
    _write_by(monthly_rfm(base, params), root, "monthly_rfm", "snapshot_date")
    # a file for each bucket and snapshot
    write_mart(churn_status(events, cal, params, up=up), root, "monthly_churn", partition_by=("snapshot_date",))
    ages = cohort_base(events, params, up=up).groupBy("cohort_date", "cohort_age", "order_date").agg(
        F.count(F.lit(1)).alias("active_users"), F.sum("revenue").alias("period_revenue"), F.sum("orders").alias("orders"))
    _write_by(ages, root, "cohort_ages", "order_date")
    days = events.groupBy(period_start(F.col("event_time"), g).alias("period_start")).agg(*_days(events, params))
    _write_period(days.join(cal.frame(events.sparkSession).select("period_start"), "period_start", "right"), root, buckets)


def _instant(events: DataFrame, day: dt.date) -> Column:
    """``day`` as a constant of the event time's type, so that comparisons reach the scan."""
    return F.lit(str(day)).cast(events.schema["event_time"].dataType)


def last_period(spark: SparkSession, root: str) -> dt.date | None:
    """Start of the last finished period."""
    if not mart_exists(spark, root, "periods"):
        return None
    return read_mart(spark, root, "periods").agg(F.max("period_start")).first()[0]


def period_totals(events: DataFrame, period: dt.date, params: Params = DEFAULT) -> DataFrame:
    """Per buyer of one period: first and last purchase, count and spend.  Only that period's
    events are read, and a buyer ships one row per task."""
    end = py_add_periods(period, 1, params.grain)
    p = purchases(events, params.purchase_type).where(
        (F.col("event_time") >= _instant(events, period)) & (F.col("event_time") < _instant(events, end)))
    return p.groupBy("user_id").agg(
        F.max(F.to_date("event_time")).alias("p_last_date"), F.max("event_time").alias("p_last_ts"),
        F.count(F.lit(1)).alias("p_cnt"), F.sum("price").cast(MONEY).alias("p_spend"))


def merge_state(state: DataFrame, totals: DataFrame, period: dt.date, buckets: int) -> DataFrame:
    """The state at the end of ``period`` from the state before it and the period's totals, which
    are dealt like the state's ``buckets`` (else Spark would shuffle the side with fewer partitions,
    the state)."""
    totals = totals.repartition(buckets, "user_id")
    zero = F.lit(0).cast(MONEY)
    spend = F.coalesce("p_spend", zero)
    return state.join(totals, "user_id", "full").select(
        "user_id", F.coalesce("first_start", F.lit(period)).alias("first_start"),
        F.coalesce("p_last_date", "last_date").alias("last_date"), F.coalesce("p_last_ts", "last_ts").alias("last_ts"),
        (F.coalesce("cnt", F.lit(0)) + F.coalesce("p_cnt", F.lit(0))).alias("cnt"),
        (F.coalesce("spend", zero) + spend).cast(MONEY).alias("spend"),
        F.coalesce("p_cnt", F.lit(0)).alias("period_cnt"), spend.alias("period_spend"))


def append_period(events: DataFrame, root: str, period: dt.date, params: Params = DEFAULT) -> DataFrame:
    """Add the snapshot of the period that starts at ``period`` to the tables under ``root``;
    returns the new state."""
    g, spark = params.grain, events.sparkSession
    if py_period_start(period, g) != period:
        raise ValueError(f"{period} is not the start of a {g}")
    last = last_period(spark, root)
    if last is None:
        raise ValueError(f"nothing is stored under {root}; seed() comes first")
    if period not in (last, py_add_periods(last, 1, g)):
        raise ValueError(f"{period} does not follow the last period, {last}")
    before = py_add_periods(period, -1, g)
    earlier = read_mart(spark, root, "periods", where=f"period_start < DATE'{period}'")
    past = earlier.agg(F.max("period_start"), F.max("buckets"), F.max("last_event_day")).first()
    if past[0] != before:
        raise ValueError(f"no state of {before}, which comes before {period}")
    buckets = past[1]

    merged = merge_state(read_state(spark, root, before), period_totals(events, period, params), period, buckets)
    state = _write_state(merged, root, period, buckets)

    end = py_add_periods(period, 1, g)
    inside = events.where((F.col("event_time") >= _instant(events, period)) & (F.col("event_time") < _instant(events, end)))
    day = inside.agg(*_days(inside, params)).first()
    asof = max(d for d in (past[2], day["last_event_day"]) if d is not None)
    snapshot = py_period_end(period, g)
    bought = state.where("period_cnt > 0")
    # the as-of date of the scores is that of purchases, the one of the status that of any event
    if day["last_purchase_day"] is not None:
        base = bought.select("user_id", F.lit(snapshot).alias("snapshot_date"),
                             F.datediff(F.date_add(F.lit(day["last_purchase_day"]), 1), "last_date").alias("recency"),
                             F.col("period_cnt").alias("month_freq"), F.col("period_spend").alias("month_monetary"))
        _write_by(monthly_rfm(base, params), root, "monthly_rfm", "snapshot_date")
    recency = F.datediff(F.date_add(F.lit(asof), 1), "last_date")
    status = (F.when(F.col("first_start") == F.lit(period), C.CHURN_NEW).when(recency <= params.active_days, C.CHURN_ACTIVE)
              .when(recency <= params.risk_days, C.CHURN_AT_RISK).otherwise(C.CHURN_CHURNED))
    write_mart(state.select("user_id", status.alias("segment"), F.col("period_spend").alias("ltv"),
                            F.lit(snapshot).alias("snapshot_date")), root, "monthly_churn", partition_by=("snapshot_date",))
    ages = bought.groupBy(F.col("first_start").alias("cohort_date")).agg(
        F.count(F.lit(1)).alias("active_users"), F.sum("period_spend").alias("period_revenue"), F.sum("period_cnt").alias("orders"))
    write_mart(ages.select("cohort_date", periods_between(F.lit(period), F.col("cohort_date"), g).alias("cohort_age"), "active_users",
                           F.col("period_revenue"), "orders", F.lit(period).alias("order_date")),
               root, "cohort_ages", partition_by=("order_date",))
    row = spark.createDataFrame([(period, day["last_event_day"], day["last_purchase_day"])],
                                "period_start date, last_event_day date, last_purchase_day date")
    _write_period(row, root, buckets)
    return state


def stored_cohort_ages(spark: SparkSession, root: str) -> DataFrame:
    """(cohort, age) figures of all stored periods, for ``cohort_retention(ages=...)``."""
    return read_mart(spark, root, "cohort_ages").drop("order_date")


def stored_rfm_base(spark: SparkSession, root: str, period: dt.date) -> DataFrame:
    """A1 as of the end of ``period``, read off the state."""
    day = read_mart(spark, root, "periods", where=f"period_start <= DATE'{period}'").agg(
        F.date_add(F.max("last_purchase_day"), 1)).first()[0]
    standard = F.lit(day).cast("date")
    return read_state(spark, root, period).select(
        "user_id", F.col("last_ts").alias("last_order_ts"), F.col("last_date").alias("last_order_date"),
        standard.alias("standard_date"), F.datediff(standard, "last_date").alias("recency"),
        F.col("cnt").alias("frequency"), F.col("spend").alias("monetary"))
