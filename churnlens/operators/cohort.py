"""Cohort retention, cumulative revenue and segment retention.

All three read the (user, period) purchase aggregate.  A user's cohort is the
first period with a purchase (a running MIN over the user's own rows: bounded
by the number of periods, so no skewed window).  Per-(cohort, age) rows are
few, so the retention ratios and cumulative sums run on aggregated data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.dates import period_start, periods_between
from ._util import money, ratio
from .monthly import user_period


def cohort_base(events: DataFrame, params: Params = DEFAULT, up: DataFrame | None = None) -> DataFrame:
    """(user_id, cohort_date, order_date, cohort_age, revenue, orders).  ``up`` is the
    shared (user, period) table where that is already written."""
    up = up if up is not None else user_period(events, params)
    w = Window.partitionBy("user_id").orderBy("period_start")
    cb = up.select("user_id", F.col("period_start").alias("order_date"),
                   F.col("spend").alias("revenue"), F.col("cnt").alias("orders"),
                   F.min("period_start").over(w).alias("cohort_date"))
    return cb.withColumn("cohort_age", periods_between(F.col("order_date"), F.col("cohort_date"), params.grain))


def cohort_ages(events: DataFrame, params: Params = DEFAULT, up: DataFrame | None = None) -> DataFrame:
    """Per (cohort, age): active users, revenue and orders; what A12 and A26 share."""
    cb = cohort_base(events, params, up)
    # a user has one row per order period, so COUNT(*) = COUNT(DISTINCT user_id)
    return cb.groupBy("cohort_date", "cohort_age").agg(
        F.count(F.lit(1)).alias("active_users"),
        F.sum("revenue").alias("period_revenue"),
        F.sum("orders").alias("orders"))


def cohort_retention(events: DataFrame, params: Params = DEFAULT, ages: DataFrame | None = None) -> DataFrame:
    """A12. Per (cohort, age): cohort size, active users, retention, revenue and
    running revenue totals over age."""
    g = ages if ages is not None else cohort_ages(events, params)
    by_cohort = Window.partitionBy("cohort_date")
    running = Window.partitionBy("cohort_date").orderBy("cohort_age").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # every member is active at age 0, so the age-0 count is the cohort size
    first_user = F.max(F.when(F.col("cohort_age") == 0, F.col("active_users"))).over(by_cohort)
    g = g.select("*", first_user.alias("first_user"))
    g = g.select("*", ratio(F.col("period_revenue"), F.col("first_user")).alias("revenue_per_user"))
    return g.select(
        "cohort_date", "cohort_age", "first_user", "active_users",
        ratio(F.col("active_users"), F.col("first_user")).alias("retention_rate"),
        money(F.col("period_revenue")).alias("period_revenue"),
        "revenue_per_user",
        money(F.sum("period_revenue").over(running)).alias("cumulative_revenue"),
        F.sum("revenue_per_user").over(running).alias("cumulative_revenue_per_user"),
    ).orderBy("cohort_date", "cohort_age")


def cohort_age_metrics(events: DataFrame, params: Params = DEFAULT, ages: DataFrame | None = None) -> DataFrame:
    """A26. Per (cohort, age): orders per active user, revenue per active user, actives."""
    g = ages if ages is not None else cohort_ages(events, params)
    return g.select("cohort_date", "cohort_age",
                    ratio(F.col("orders"), F.col("active_users")).alias("avg_freq"),
                    ratio(F.col("period_revenue"), F.col("active_users")).alias("arpu"),
                    "active_users")


def cohort_segment_retention(events: DataFrame, mrfm: DataFrame, params: Params = DEFAULT,
                             up: DataFrame | None = None) -> DataFrame:
    """A13. Cohort activity split by the user's RFM segment in the order period.

    Order periods without a snapshot row keep a NULL segment (own group).  The
    retention base is the first age present in the (segment, cohort) group,
    which need not be age 0.
    """
    cb = cohort_base(events, params, up)
    seg = mrfm.select("user_id", period_start(F.col("snapshot_date"), params.grain).alias("order_date"),
                      "rfm_segment")
    # both sides hold one row per (user, period), so COUNT(*) counts distinct users
    j = cb.join(seg, ["user_id", "order_date"], "left")
    g = j.groupBy("rfm_segment", "cohort_date", "order_date", "cohort_age").agg(
        F.count(F.lit(1)).alias("active_number"),
        F.sum("revenue").alias("active_revenue"))
    w = Window.partitionBy("rfm_segment", "cohort_date").orderBy("cohort_age")
    return g.select(
        "rfm_segment", "cohort_date", "order_date", "cohort_age", "active_number",
        ratio(F.col("active_number"), F.first("active_number").over(w)).alias("cnt_retention"),
        ratio(F.col("active_revenue"), F.first("active_revenue").over(w)).alias("revenue_retention"),
    )
