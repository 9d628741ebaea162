"""Behaviour around snapshots and first purchases.

Every operator here aggregates the event log first, keyed by (user, ...),
then joins the much smaller per-user result.  The map-side partial aggregate
means a user (or bot) holding a large share of all events still ships only
one row per task and key to the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.dates import Calendar, add_periods, period_end, period_sequence, period_start
from ..functions.segments import point_of_view
from ..sources.tables import purchases


def _trailing_counts(events: DataFrame, calendar: Calendar, days: tuple[int, ...]) -> DataFrame:
    """(user_id, snapshot_date, event_type, c_<n>...) counts of events in the
    half-open windows [snapshot - n days, snapshot) for each n in ``days``."""
    g = calendar.grain
    longest = max(days)
    d = F.to_date("event_time")
    # snapshots s with d < s <= d + longest: periods of d+1 .. d+longest
    lo = F.greatest(period_start(F.date_add(d, 1), g), calendar.first_col())
    hi = F.least(period_start(F.date_add(d, longest), g), calendar.last_col())
    x = events.select("user_id", "event_type", d.alias("d"),
                      F.explode(period_sequence(lo, hi, g)).alias("snap_start"))
    x = x.select("user_id", "event_type", period_end(F.col("snap_start"), g).alias("snapshot_date"),
                 F.datediff(period_end(F.col("snap_start"), g), F.col("d")).alias("lag"))
    x = x.where((F.col("lag") >= 1) & (F.col("lag") <= longest))
    return x.groupBy("user_id", "snapshot_date", "event_type").agg(
        *[F.count(F.when(F.col("lag") <= n, 1)).alias(f"c_{n}") for n in days])


def pre_snapshot_activity(events: DataFrame, churn: DataFrame, calendar: Calendar,
                          params: Params = DEFAULT) -> DataFrame:
    """A18. Events in the 3/7/14 days before each snapshot (snapshot day excluded),
    by the user's churn status at that snapshot: (snapshot_date, segment,
    event_type, interval, event_cnt).  The windows nest, so one scan of the
    longest window serves all of them."""
    days = tuple(sorted(params.trailing_days))
    t = _trailing_counts(events, calendar, days)
    j = t.join(churn.select("user_id", "snapshot_date", "segment"), ["user_id", "snapshot_date"])
    g = j.groupBy("snapshot_date", "segment", "event_type").agg(
        *[F.sum(f"c_{n}").alias(f"c_{n}") for n in days])
    stack = ", ".join(f"'{n} day', c_{n}" for n in days)
    long = g.selectExpr("snapshot_date", "segment", "event_type",
                        f"stack({len(days)}, {stack}) AS (`interval`, event_cnt)")
    return long.where(F.col("event_cnt") > 0)


def pre_snapshot_activity_by_type(activity: DataFrame) -> DataFrame:
    """A18 roll-up: (event_type, interval, cnt) over all snapshots and statuses."""
    return activity.groupBy("event_type", "interval").agg(F.sum("event_cnt").alias("cnt"))


def churn_event_funnel(events: DataFrame, churn: DataFrame, calendar: Calendar,
                       params: Params = DEFAULT) -> DataFrame:
    """A20. Events in each snapshot's period by the users' churn status:
    (snapshot_date, segment, event_type, total_count)."""
    g = calendar.grain
    e = events.groupBy("user_id", period_start(F.col("event_time"), g).alias("p"), "event_type").agg(
        F.count(F.lit(1)).alias("cnt"))
    c = churn.select("user_id", "snapshot_date", "segment",
                     period_start(F.col("snapshot_date"), g).alias("p"))
    return (e.join(c, ["user_id", "p"])
            .groupBy("snapshot_date", "segment", "event_type")
            .agg(F.sum("cnt").alias("total_count")))


def next_period_behaviour(events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """A23. Behaviour in the period after each user's first-purchase period:
    distinct categories, view and cart counts, whether the user bought again.
    Users with no event in that period have no row."""
    g = params.grain
    first = purchases(events, params.purchase_type).groupBy("user_id").agg(
        period_start(F.min("event_time"), g).alias("first_date"))
    first = first.select("user_id", "first_date", add_periods(F.col("first_date"), 1, g).alias("p"))
    e = events.groupBy("user_id", period_start(F.col("event_time"), g).alias("p"),
                       "event_type", "category_id").agg(F.count(F.lit(1)).alias("cnt"))
    j = e.join(first, ["user_id", "p"])
    t = F.col("event_type")
    return j.groupBy("user_id", "first_date").agg(
        F.count_distinct("category_id").alias("category_cnt"),
        F.sum(F.when(t == params.view_type, F.col("cnt")).otherwise(0)).alias("view_cnt"),
        F.sum(F.when(t == params.cart_type, F.col("cnt")).otherwise(0)).alias("cart_cnt"),
        F.max(F.when(t == params.purchase_type, 1).otherwise(0)).alias("tf_purchase"))


def high_segment_behaviour(events: DataFrame, mrfm: DataFrame, calendar: Calendar,
                           params: Params = DEFAULT) -> DataFrame:
    """A25. View / cart / purchase counts per high-segment user and snapshot, in
    the snapshot's period, labelled past / current (last ``current_n`` snapshots)."""
    g = calendar.grain
    t = F.col("event_type")
    e = events.groupBy("user_id", period_end(period_start(F.col("event_time"), g), g).alias("snapshot_date")).agg(
        F.count(F.when(t == params.view_type, 1)).alias("view_cnt"),
        F.count(F.when(t == params.cart_type, 1)).alias("cart_cnt"),
        F.count(F.when(t == params.purchase_type, 1)).alias("purchase_cnt"))
    hs = mrfm.where(F.col("rfm_segment").isin(*params.high_segments)).select("user_id", "snapshot_date")
    current_from = F.lit(calendar.current_from(params.current_n))
    return e.join(hs, ["user_id", "snapshot_date"]).select(
        point_of_view(F.col("snapshot_date"), current_from).alias("point_of_view"),
        "user_id", "snapshot_date", "view_cnt", "cart_cnt", "purchase_cnt")
