"""Whole-history RFM: base metrics, NTILE scores and segment summaries (A1-A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.ntile import ntiles
from ..functions.segments import rfm_segment
from ..sources.tables import purchases
from ._util import money, ratio


def rfm_base(events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """A1. Per purchaser: last order, recency to (last purchase day + 1), count, spend.

    ``standard_date`` is one global scalar (max purchase day + 1): a scalar
    subquery whose partial max leaves one row per task, so no wide shuffle.
    """
    p = purchases(events, params.purchase_type)
    per_user = p.groupBy("user_id").agg(
        F.max("event_time").alias("last_order_ts"),
        F.max(F.to_date("event_time")).alias("last_order_date"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum("price").alias("monetary"),
    )
    standard = p.agg(F.date_add(F.max(F.to_date("event_time")), 1)).scalar()
    return per_user.select(
        "user_id", "last_order_ts", "last_order_date",
        standard.alias("standard_date"),
        F.datediff(standard, F.col("last_order_date")).alias("recency"),
        "frequency", "monetary",
    )


def score(df: DataFrame, params: Params, group: tuple[str, ...] = (),
          freq_col: str = "frequency", money_col: str = "monetary") -> DataFrame:
    """Three exact NTILEs (recency DESC, frequency ASC, monetary ASC; user id breaks ties)
    and the ordered segment rule.  ``group`` = per-snapshot scoring."""
    df = ntiles(df, params.tiles, [("recency", True, "recency_score"),
                                   (freq_col, False, "frequency_score"),
                                   (money_col, False, "monetary_score")], group=group)
    return df.withColumn("rfm_segment", rfm_segment())


def rfm_score(base: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """A2. Scores 1-5 (5 = best) and segment per user."""
    scored = score(base.select("user_id", "recency", "frequency", "monetary"), params)
    return scored.select("user_id", "rfm_segment", "recency", "recency_score",
                         "frequency", "frequency_score", "monetary", "monetary_score")


def rfm_segment_share(scores: DataFrame) -> DataFrame:
    """A3. Users per segment and their share.  The share window runs over the
    already aggregated rows (one per segment)."""
    seg = scores.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("cnt"))
    return seg.select("rfm_segment", "cnt",
                      ratio(F.col("cnt"), F.sum("cnt").over(Window.partitionBy())).alias("user_ratio"))


def rfm_segment_sales(scores: DataFrame) -> DataFrame:
    """A4. Per-segment KPIs.  The scores already carry R, F and M, so the
    original self-join of base and scores is not needed."""
    seg = scores.groupBy("rfm_segment").agg(
        F.count("user_id").alias("user_cnt"),  # one row per user
        F.sum("monetary").alias("monetary_dec"),
        F.count("monetary").alias("_n_m"),
        F.avg("frequency").alias("frequency_avg"),
        F.avg("recency").alias("recency_avg"),
    )
    total = F.sum("monetary_dec").over(Window.partitionBy())
    return seg.select(
        "rfm_segment", "user_cnt",
        money(F.col("monetary_dec")).alias("monetary"),
        ratio(F.col("monetary_dec"), total).alias("monetary_ratio"),
        ratio(F.col("monetary_dec"), F.col("_n_m")).alias("arpu"),
        F.col("frequency_avg").cast("double").alias("frequency_avg"),
        F.col("recency_avg").cast("double").alias("recency_avg"),
    )
