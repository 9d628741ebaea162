"""Snapshot RFM: per-period base, scores, KPIs, transitions and journeys.

The original analysis loops over snapshot dates and rescans the whole history
three times per snapshot.  Here every snapshot comes from one aggregate keyed
by (user, period):

* an output row exists only for users who bought in the snapshot's period,
  so "last purchase on or before the snapshot" is that period's last purchase
  day, and the as-of standard date is the period's last purchase day + 1;
* the per-period maximum is a second, narrow branch: Catalyst prunes it to
  the event time and purchase flag, and its partial aggregate leaves one row
  per task and period, so it adds a one-column scan and no real shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.dates import Calendar, period_end, period_start
from ..sources.tables import purchases
from ._util import money, ratio
from .rfm import score


def user_period(events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The shared fact: one row per (user, purchase period).

    columns: user_id, period_start, cnt, spend (decimal), last_date, first_ts, last_ts
    A partial (map-side) aggregate runs before the shuffle, so a user with a
    huge share of the rows still ships one row per task and period.
    """
    p = purchases(events, params.purchase_type)
    return p.groupBy("user_id", period_start(F.col("event_time"), params.grain).alias("period_start")).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.sum("price").alias("spend"),
        F.max(F.to_date("event_time")).alias("last_date"),
        F.min("event_time").alias("first_ts"),
        F.max("event_time").alias("last_ts"),
    )


def monthly_rfm_base(events: DataFrame, calendar: Calendar, params: Params = DEFAULT,
                     up: DataFrame | None = None) -> DataFrame:
    """A5. Per snapshot: users who bought in its period with that period's count and spend,
    and recency to the as-of standard date (last purchase day on/before the snapshot + 1).
    ``up`` is the shared (user, period) table where that is already written."""
    if calendar.grain != params.grain:
        params = params.with_(grain=calendar.grain)
    up = (up if up is not None else user_period(events, params)).where(calendar.contains(F.col("period_start")))
    # one row per calendar period: what is broadcast is bounded by the calendar length
    std = up.groupBy("period_start").agg(F.date_add(F.max("last_date"), 1).alias("standard_date"))
    return up.join(F.broadcast(std), "period_start").select(
        "user_id",
        period_end(F.col("period_start"), calendar.grain).alias("snapshot_date"),
        "standard_date",
        F.datediff("standard_date", "last_date").alias("recency"),
        F.col("cnt").alias("month_freq"),
        F.col("spend").alias("month_monetary"),
    )


def monthly_rfm(base: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """A6. Scores and segment within each snapshot (exact NTILE per snapshot)."""
    df = base.select("user_id", "snapshot_date", "recency", "month_freq", "month_monetary")
    scored = score(df, params, group=("snapshot_date",), freq_col="month_freq",
                   money_col="month_monetary")
    return scored.select("user_id", "snapshot_date", "rfm_segment", "recency", "recency_score",
                         "month_freq", "frequency_score", "month_monetary", "monetary_score")


def monthly_segment_stat(mrfm: DataFrame) -> DataFrame:
    """A9. Segment KPIs per snapshot and the segment's share of the snapshot's spend."""
    g = mrfm.groupBy("snapshot_date", "rfm_segment").agg(
        F.avg("recency").alias("avg_recency"),
        F.avg("month_freq").alias("avg_frequency"),
        F.sum("month_monetary").alias("_total"),
        F.count("month_monetary").alias("_n"),
    )
    snap_total = F.sum("_total").over(Window.partitionBy("snapshot_date"))
    return g.select(
        "snapshot_date", "rfm_segment", "avg_recency", "avg_frequency",
        ratio(F.col("_total"), F.col("_n")).alias("arpu"),
        money(F.col("_total")).alias("total_monetary"),
        ratio(F.col("_total"), snap_total).alias("monetary_ratio"),
    )


def transitions(df: DataFrame, state: str, value: str, time: str = "snapshot_date",
                key: str = "user_id") -> DataFrame:
    """Previous row's state and value per key (LAG over the key's own rows).

    A key has at most one row per snapshot, so a window partition is bounded by
    the calendar length.  The first row of each key is dropped.
    """
    w = Window.partitionBy(key).orderBy(time)
    return (df.select(key, time, F.col(state).alias("curr_state"), F.col(value).alias("curr_value"),
                      F.lag(state).over(w).alias("prev_state"),
                      F.lag(value).over(w).alias("prev_value"))
            .where(F.col("prev_state").isNotNull()))


def segment_transition_uplift(mrfm: DataFrame) -> DataFrame:
    """A10. Segment-to-segment moves between a user's consecutive snapshot rows,
    with spend change and mean uplift (NULL uplift when the previous spend is not > 0)."""
    t = transitions(mrfm, "rfm_segment", "month_monetary")
    diff = F.col("curr_value") - F.col("prev_value")
    uplift = F.when(F.col("prev_value") > 0, ratio(diff, F.col("prev_value")))
    g = t.groupBy(F.col("snapshot_date").alias("snapshot_month"),
                  F.col("prev_state").alias("prev_segment"),
                  F.col("curr_state").alias("curr_segment")).agg(
        F.count(F.lit(1)).alias("transition_cnt"),
        F.sum("prev_value").alias("_prev"),
        F.sum("curr_value").alias("_curr"),
        F.sum(diff).alias("_diff"),
        F.count(diff).alias("_ndiff"),
        F.avg(uplift).alias("avg_uplift_pct"),
    )
    return g.select("snapshot_month", "prev_segment", "curr_segment", "transition_cnt",
                    money(F.col("_prev")).alias("total_prev_amount"),
                    money(F.col("_curr")).alias("total_curr_amount"),
                    money(F.col("_diff")).alias("total_diff_amount"),
                    ratio(F.col("_diff"), F.col("_ndiff")).alias("avg_diff_amount"),
                    "avg_uplift_pct").orderBy("prev_segment", "curr_segment", "snapshot_month")


def segment_path(mrfm: DataFrame, calendar: Calendar) -> DataFrame:
    """A11. One row per user, one column per calendar period holding that period's segment.

    Column names come from the calendar (a parameter), not from the data, so no
    distinct-values job runs; the pivot is a single aggregation by user.
    """
    labels = [calendar.label(s) for s in calendar.starts()]
    fmt = "yyyy-MM" if calendar.grain == "month" else "yyyy-MM-dd"
    start = period_start(F.col("snapshot_date"), calendar.grain)
    return (mrfm.select("user_id", F.date_format(start, fmt).alias("period"), "rfm_segment")
            .groupBy("user_id").pivot("period", labels).agg(F.max("rfm_segment")))
