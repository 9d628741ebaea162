"""Category views: as-of category dimension, category x segment snapshot KPIs,
and the category of each user's last purchase (A7, A8, A19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.dates import Calendar, add_periods, period_end, period_sequence, period_start
from ..functions.ntile import counted, join_counted, settled
from ..sources.tables import purchases
from ._util import money, ratio


#: Categories of one user that meet the user's snapshots under one join key.
CATEGORIES_A_PART = 4096


def _held_categories(m: DataFrame, uc: DataFrame, part: int) -> DataFrame:
    """Snapshot rows ``m`` joined with the categories ``uc`` that their user had bought by then.

    A user's pairs are snapshots x categories, so a user of very many categories is split:
    users with more than ``part`` categories are counted first, their categories are dealt to
    parts by hash, their snapshot rows are repeated for each part, and both sides meet
    on (user, part).  A key so holds about ``part`` x snapshots pairs at most.  There are at
    most (rows / part) such users; all others have the one part 0.
    """
    parts = F.ceil(F.count(F.lit(1)) / F.lit(part)).cast("int").alias("parts")
    heavy = counted(uc.groupBy("user_id").agg(parts).where("parts > 1"))
    n = F.coalesce("parts", F.lit(1))
    left = m.join(heavy, "user_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).drop("parts")
    right = uc.join(heavy, "user_id", "left").withColumn(
        "part", F.pmod(F.xxhash64("category_id"), n).cast("int")).drop("parts")
    return left.join(right, ["user_id", "part"]).where(F.col("first_start") <= F.col("snap_start")).drop("part")


def _expand_to_snapshots(df: DataFrame, key: str, calendar: Calendar) -> DataFrame:
    """Rows keyed by (key, period_start) -> one row per calendar snapshot from the
    row's period up to the period before the key's next row (LEAD over the key's
    own rows, at most one per period)."""
    g = calendar.grain
    w = Window.partitionBy(key).orderBy("period_start")
    df = df.select("*", F.lead("period_start").over(w).alias("_next"))
    lo = F.greatest(F.col("period_start"), calendar.first_col())
    hi = F.least(F.coalesce(add_periods(F.col("_next"), -1, g), calendar.last_col()), calendar.last_col())
    return df.select("*", F.explode(period_sequence(lo, hi, g)).alias("snap_start")).drop("_next")


def category_dim_asof(events: DataFrame, calendar: Calendar, params: Params = DEFAULT) -> DataFrame:
    """A8. (snapshot_date, category_id, category_code): for each snapshot, the
    non-null code seen last (by purchase time) on or before it; ties on the
    time go to the greatest code.

    Per (category, period) the best (time, code) pair is a max of structs; the
    as-of value is a running max over the category's periods, expanded to the
    calendar snapshots it covers.
    """
    g = calendar.grain
    p = purchases(events, params.purchase_type).where(F.col("category_code").isNotNull())
    per = p.groupBy("category_id", "category_code",
                    period_start(F.col("event_time"), g).alias("period_start")).agg(
        F.max("event_time").alias("last_time"))
    best = per.groupBy("category_id", "period_start").agg(
        F.max(F.struct("last_time", "category_code")).alias("best"))
    w = Window.partitionBy("category_id").orderBy("period_start").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    asof = best.select("category_id", "period_start", F.max("best").over(w).alias("best"))
    x = _expand_to_snapshots(asof, "category_id", calendar)
    return x.select(period_end(F.col("snap_start"), g).alias("snapshot_date"), "category_id",
                    F.col("best.category_code").alias("category_code"))


def monthly_rfm_category(events: DataFrame, mrfm: DataFrame, calendar: Calendar,
                         params: Params = DEFAULT, dim: DataFrame | None = None,
                         part: int = CATEGORIES_A_PART) -> DataFrame:
    """A7. Per (snapshot, category, segment): mean recency and summed frequency /
    spend of the users who bought the category on or before the snapshot, and
    the share of the snapshot's spend.

    As in the original, a user's snapshot figures are credited to *every*
    category the user has bought so far (not only that period's), and users
    without a snapshot row form a NULL-segment group with NULL figures.

    Plan: (user, category) first-purchase period; snapshot rows joined to the
    user's categories with first period <= snapshot period (at most
    #snapshots x #categories pairs per user, whatever the user's raw row
    count; users of more than ``part`` categories are split, see
    ``_held_categories``).  The NULL-segment group exists where more users had bought the
    category by then than were active; that needs only running counts per
    (category, period), never the users x categories x snapshots expansion.
    """
    g = calendar.grain
    p = purchases(events, params.purchase_type)
    # read by the count of heavy users, the join and the buyers so far
    uc = settled(p.groupBy("user_id", "category_id").agg(
        F.min(period_start(F.col("event_time"), g)).alias("first_start")))
    m = mrfm.select("user_id", "snapshot_date", "rfm_segment", "recency", "month_freq",
                    "month_monetary", period_start(F.col("snapshot_date"), g).alias("snap_start"))
    act = _held_categories(m, uc, part)
    seg = act.groupBy("snapshot_date", "category_id", "rfm_segment").agg(
        F.sum("recency").alias("_rsum"), F.count("recency").alias("_rn"),
        F.sum("month_freq").alias("sum_frequency"),
        F.sum("month_monetary").alias("_msum"),
        F.count(F.lit(1)).alias("_pairs"))
    # buyers so far per (category, snapshot) vs. active buyers -> NULL-segment group
    new = uc.groupBy("category_id", F.col("first_start").alias("period_start")).agg(
        F.count(F.lit(1)).alias("_new"))
    wc = Window.partitionBy("category_id").orderBy("period_start").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cum = _expand_to_snapshots(new.select("category_id", "period_start",
                                          F.sum("_new").over(wc).alias("_buyers")), "category_id", calendar)
    cum = cum.select(period_end(F.col("snap_start"), g).alias("snapshot_date"),
                     "category_id",
                     F.lit(None).cast("string").alias("rfm_segment"),
                     F.lit(None).cast("long").alias("_rsum"), F.lit(0).cast("long").alias("_rn"),
                     F.lit(None).cast("long").alias("sum_frequency"),
                     F.lit(None).cast(seg.schema["_msum"].dataType).alias("_msum"),
                     F.lit(0).cast("long").alias("_pairs"), "_buyers")
    # one row per segment plus one candidate NULL row per (snapshot, category); the
    # NULL row stays when more users had bought the category than were active
    u = seg.withColumn("_buyers", F.lit(None).cast("long")).unionByName(cum)
    key = Window.partitionBy("snapshot_date", "category_id")
    u = u.select("*", F.sum("_pairs").over(key).alias("_active"))
    allg = u.where(F.col("_buyers").isNull() | (F.col("_buyers") > F.col("_active"))).drop(
        "_buyers", "_active", "_pairs")
    dim = dim if dim is not None else category_dim_asof(events, calendar, params)
    allg = allg.join(dim, ["snapshot_date", "category_id"], "left")
    snap_total = F.sum("_msum").over(Window.partitionBy("snapshot_date"))
    return allg.select(
        "snapshot_date", "category_id", "category_code", "rfm_segment",
        ratio(F.col("_rsum"), F.col("_rn")).alias("avg_recency"),
        "sum_frequency",
        money(F.col("_msum")).alias("sum_monetary"),
        ratio(F.col("_msum"), snap_total).alias("monetary_ratio"))


def monthly_rfm_category_attributed(events: DataFrame, mrfm: DataFrame, calendar: Calendar,
                                    params: Params = DEFAULT, dim: DataFrame | None = None) -> DataFrame:
    """A7 option (D5): credit each snapshot only with the categories bought in
    that snapshot's period and with the spend on them (no fan-out, no NULL
    group).  sum_frequency / sum_monetary are the category's purchases and
    spend in the period by users of the segment."""
    g = calendar.grain
    cp = purchases(events, params.purchase_type).groupBy(
        "user_id", period_end(period_start(F.col("event_time"), g), g).alias("snapshot_date"), "category_id").agg(
        F.count(F.lit(1)).alias("_f"), F.sum("price").alias("_m"))
    j = cp.join(mrfm.select("user_id", "snapshot_date", "rfm_segment", "recency"), ["user_id", "snapshot_date"])
    seg = j.groupBy("snapshot_date", "category_id", "rfm_segment").agg(
        F.avg("recency").alias("avg_recency"), F.sum("_f").alias("sum_frequency"), F.sum("_m").alias("_msum"))
    dim = dim if dim is not None else category_dim_asof(events, calendar, params)
    seg = seg.join(dim, ["snapshot_date", "category_id"], "left")
    snap_total = F.sum("_msum").over(Window.partitionBy("snapshot_date"))
    return seg.select("snapshot_date", "category_id", "category_code", "rfm_segment", "avg_recency",
                      "sum_frequency", money(F.col("_msum")).alias("sum_monetary"),
                      ratio(F.col("_msum"), snap_total).alias("monetary_ratio"))


def last_purchase_category(events: DataFrame, churn: DataFrame, params: Params = DEFAULT,
                           purchases_only: bool = False) -> DataFrame:
    """A19. Categories of the events at each user's last purchase instant, counted
    by the user's latest churn status.

    As in the original every event at that instant counts, whatever its type.
    Each user's last purchase is found first (a MAX with a partial aggregate), and the
    events are cut down to those instants by one join: a broadcast once the users were
    counted and are few, otherwise a shuffle on (user_id, event_time), which spreads a
    user with a huge share of the rows over many tasks.  Only the rows at the last
    instants are aggregated; the latest status is a MAX_BY aggregate, not a window.
    """
    bought = purchases(events, params.purchase_type)
    last = bought.groupBy("user_id").agg(F.max("event_time").alias("event_time"))
    rows = bought if purchases_only else events  # D9 option: only the purchase events at that instant
    at_last = join_counted(rows.select("user_id", "event_time", "category_id", "category_code"), last,
                           ["user_id", "event_time"])
    n = at_last.groupBy("user_id", "category_id", "category_code").agg(F.count(F.lit(1)).alias("n"))
    status = churn.groupBy("user_id").agg(F.max_by("segment", "snapshot_date").alias("segment"))
    return (n.join(status, "user_id")
            .groupBy("segment", "category_id", "category_code")
            .agg(F.sum("n").alias("last_purchase_cnt"))
            .orderBy("segment", F.desc("last_purchase_cnt"), "category_id", "category_code"))
