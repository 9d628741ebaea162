"""Churn status per user and snapshot, its statistics, transitions and loss
estimate (A14-A17).

Churn status in the original is one full-history scan per snapshot, and its statistics
read a row per user and snapshot.  Here a user's history is a few *intervals*:

* (user, period) purchase aggregate; LEAD gives the user's next purchase period (window
  over the user's own rows, bounded by the calendar length);
* from a purchase to the one before the next the status depends on the as-of standard
  date alone, which never falls from one snapshot to the next.  So the status is NEW, ACTIVE,
  AT_RISK, CHURNED in this order, and the snapshots where it turns follow from the
  day of the purchase: at most four intervals a purchase;
* the as-of standard date (last day with any event on or before the snapshot
  + 1) is a running max over per-period maxima: one row per period.

A15-A17 read intervals only: an interval adds one where it begins and takes one away after
it ends, and a running sum over the calendar gives the users of each snapshot.  A row
per user and snapshot is made only for A14's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, Params
from ..functions.dates import Calendar, period_start
from ..functions.ntile import join_counted
from ._util import half_up, money, ratio
from .monthly import transitions, user_period


def standard_dates(events: DataFrame, calendar: Calendar) -> DataFrame:
    """(period_start, snapshot_date, standard_date) per calendar period:
    max(day of any event on or before the snapshot) + 1.

    The per-period maxima come from a partial aggregate (one row per task and
    period), and the running max runs over at most #periods rows.
    """
    g = calendar.grain
    per_period = events.groupBy(period_start(F.col("event_time"), g).alias("period_start")).agg(
        F.max(F.to_date("event_time")).alias("mx"))
    cal = calendar.frame(events.sparkSession).withColumn("mx", F.lit(None).cast("date"))
    both = per_period.where(F.col("period_start") <= calendar.last_col()).select(
        "period_start", F.lit(None).cast("date").alias("snapshot_date"), "mx").unionByName(
        cal.select("period_start", "snapshot_date", "mx"))
    running = Window.orderBy("period_start", F.col("snapshot_date").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (both.select("period_start", "snapshot_date", F.max("mx").over(running).alias("asof"))
            .where(F.col("snapshot_date").isNotNull())
            .select("period_start", "snapshot_date", F.date_add("asof", 1).alias("standard_date")))


def _numbered(std: DataFrame) -> DataFrame:
    """The calendar's periods with their number from 0 (one row per period)."""
    return std.withColumn("idx", F.row_number().over(Window.orderBy("period_start")) - 1)


def churn_intervals(events: DataFrame, calendar: Calendar, params: Params = DEFAULT,
                    up: DataFrame | None = None) -> DataFrame:
    """(user_id, segment, first_idx, last_idx, spend): runs of snapshots, by their number in the
    calendar, over which a user's status stays; together they cover every snapshot on or
    after the first purchase period.  ``spend`` is the user's in the period of ``first_idx``
    (NULL when the run does not begin with a purchase).  ``up`` is the shared (user, period)
    table where that is already written.

    segment: NEW when the first purchase is in the snapshot's period; else by
    recency = standard date - last purchase day: <= active_days ACTIVE,
    <= risk_days AT_RISK, above CHURNED.
    """
    if params.grain != calendar.grain:
        params = params.with_(grain=calendar.grain)
    up = (up if up is not None else user_period(events, params)).where(F.col("period_start") <= calendar.last_col())
    std = _numbered(standard_dates(events, calendar))
    numbers = _numbered(calendar.frame(events.sparkSession))
    end = len(calendar.snapshots()) - 1

    # one row per calendar period reaches the driver; for a last purchase day, how many
    # snapshots have a standard date within the limits
    dates = [r["standard_date"] for r in std.orderBy("idx").collect()]
    dates = F.array(*[F.lit(d).cast("date") for d in dates])

    def within(days: int):
        return F.size(F.filter(dates, lambda d: F.coalesce(d <= F.date_add("last_date", days), F.lit(True))))
    turns = up.select("last_date").distinct().select("last_date", within(params.active_days).alias("active_to"),
                                                     within(params.risk_days).alias("risk_to"))

    w = Window.partitionBy("user_id").orderBy("period_start")
    # a period before the calendar has the number -1
    u = up.join(F.broadcast(numbers.select("period_start", "idx")), "period_start", "left") \
        .withColumn("idx", F.coalesce("idx", F.lit(-1)))
    u = u.select("user_id", "idx", "spend", "last_date", (F.row_number().over(w) == 1).alias("first"),
                 (F.coalesce(F.lead("idx").over(w), F.lit(end + 1)) - 1).alias("to"))
    u = join_counted(u, turns, ["last_date"])
    start = F.greatest("idx", F.lit(0))
    new = F.col("first") & (F.col("idx") >= 0)
    after = start + new.cast("int")
    a, r = F.col("active_to"), F.col("risk_to")

    def run(segment: str, first, last):
        return F.struct(F.lit(segment).alias("segment"), first.alias("first_idx"), last.alias("last_idx"))
    runs = F.array(run(C.CHURN_NEW, start, F.when(new, start).otherwise(start - 1)),
                   run(C.CHURN_ACTIVE, after, F.least("to", a - 1)),
                   run(C.CHURN_AT_RISK, F.greatest(after, a), F.least("to", r - 1)),
                   run(C.CHURN_CHURNED, F.greatest(after, r), F.col("to")))
    # empty runs are dropped after the explode: a filter of the array would run interpreted, row by row
    return u.select("user_id", "idx", "spend", F.explode(runs).alias("x")).where("x.first_idx <= x.last_idx").select(
        "user_id", "x.segment", "x.first_idx", "x.last_idx",
        F.when(F.col("x.first_idx") == F.col("idx"), F.col("spend")).alias("spend"))


def _snapshots(calendar: Calendar, df: DataFrame) -> DataFrame:
    """``df`` with ``snapshot_date`` for the number ``idx`` (joined with one row per period)."""
    return df.join(F.broadcast(_numbered(calendar.frame(df.sparkSession)).select("idx", "snapshot_date")), "idx")


def expand_intervals(intervals: DataFrame, calendar: Calendar) -> DataFrame:
    """A14's rows (user_id, snapshot_date, segment, ltv) from the intervals."""
    x = intervals.select("*", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"))
    ltv = F.when((F.col("idx") == F.col("first_idx")) & F.col("spend").isNotNull(), F.col("spend")) \
        .otherwise(F.lit(0).cast("decimal(18,2)"))
    return _snapshots(calendar, x.withColumn("ltv", ltv)).select("user_id", "snapshot_date", "segment", "ltv")


def churn_status(events: DataFrame, calendar: Calendar, params: Params = DEFAULT,
                 up: DataFrame | None = None) -> DataFrame:
    """A14. (user_id, snapshot_date, segment, ltv) for every snapshot on or after
    the user's first purchase period: the segment of ``churn_intervals``, and
    ltv = spend in the snapshot's period (0 when none)."""
    return expand_intervals(churn_intervals(events, calendar, params, up), calendar)


def last_status(intervals: DataFrame, calendar: Calendar) -> DataFrame:
    """(user_id, snapshot_date, segment) at the calendar's last snapshot, one row a user."""
    snaps = calendar.snapshots()
    return intervals.where(F.col("last_idx") == len(snaps) - 1).select(
        "user_id", F.lit(snaps[-1]).alias("snapshot_date"), "segment")


def _zero(c: str):
    return F.coalesce(F.col(c), F.lit(0).cast("decimal(18,2)"))


def _running(points: DataFrame, keys: list[str], sums: list[str], last: int) -> DataFrame:
    """Rows (keys, idx) for every snapshot from the difference array ``points``
    (keys, idx, step, sums): ``n`` is the running sum of the steps, and ``sums`` count at
    their own idx.  A few rows per key and period, whatever the number of users."""
    w = Window.partitionBy(*keys).orderBy("idx")
    p = points.select("*", F.sum("step").over(w).alias("n"), (F.coalesce(F.lead("idx").over(w), F.lit(last + 1)) - 1).alias("to"))
    p = p.where(F.col("idx") <= last).select(*keys, "n", *sums, F.col("idx").alias("at"),
                                             F.explode(F.sequence("idx", F.least("to", F.lit(last)))).alias("idx"))
    return p.select(*keys, "idx", "n", *[F.when(F.col("at") == F.col("idx"), F.col(c)).otherwise(F.lit(0)).alias(c) for c in sums])


def _user_counts(intervals: DataFrame, calendar: Calendar) -> DataFrame:
    """(segment, idx, cnt, ltv) by a difference array over the calendar."""
    ends = F.explode(F.array(F.struct(F.col("first_idx").alias("idx"), F.lit(1).cast("long").alias("step"), _zero("spend").alias("ltv")),
                             F.struct((F.col("last_idx") + 1).alias("idx"), F.lit(-1).cast("long").alias("step"),
                                      F.lit(0).cast(intervals.schema["spend"].dataType).alias("ltv"))))
    points = intervals.select("segment", ends.alias("e")).select("segment", "e.*").groupBy("segment", "idx").agg(
        F.sum("step").alias("step"), F.sum("ltv").alias("ltv"))
    rows = _running(points, ["segment"], ["ltv"], len(calendar.snapshots()) - 1)
    return rows.where("n > 0").withColumnRenamed("n", "cnt")


def interval_stats(intervals: DataFrame, calendar: Calendar) -> DataFrame:
    """A15 from the intervals: users and spend per (snapshot, status)."""
    return _snapshots(calendar, _user_counts(intervals, calendar)).select(
        "snapshot_date", "segment", "cnt", money(F.col("ltv")).alias("total_ltv"))


def interval_transition(intervals: DataFrame, calendar: Calendar) -> DataFrame:
    """A16 from the intervals: a move where an interval follows another, and a stay for
    each further snapshot of an interval."""
    kind = intervals.schema["spend"].dataType
    nothing = F.lit(0).cast(kind)
    w = Window.partitionBy("user_id").orderBy("first_idx")      # a user's intervals: four a purchase at most
    x = intervals.select("segment", "first_idx", "last_idx", F.coalesce("spend", nothing).alias("spend"),
                         F.lag("segment").over(w).alias("before"), F.lag("first_idx").over(w).alias("before_idx"),
                         F.lag(F.coalesce("spend", nothing)).over(w).alias("before_spend"))

    def point(when, idx, prev, moves, step, curr_v, prev_v):
        return F.when(when, F.struct(idx.alias("idx"), prev.alias("prev_segment"), F.col("segment").alias("curr_segment"),
                                     F.lit(moves).cast("long").alias("moves"), F.lit(step).cast("long").alias("step"),
                                     curr_v.alias("curr"), prev_v.alias("prev")))
    first, last, seg = F.col("first_idx"), F.col("last_idx"), F.col("segment")
    carried = F.when(F.col("before_idx") == first - 1, F.col("before_spend")).otherwise(nothing)
    points = F.array_compact(F.array(
        point(F.col("before").isNotNull(), first, F.col("before"), 1, 0, F.col("spend"), carried),
        point(last > first, first + 1, seg, 0, 1, nothing, F.col("spend")),
        point(last > first, last + 1, seg, 0, -1, nothing, nothing)))
    keys = ["prev_segment", "curr_segment"]
    points = x.select(F.explode(points).alias("p")).select("p.*").groupBy(*keys, "idx").agg(
        *[F.sum(c).alias(c) for c in ("moves", "step", "curr", "prev")])
    rows = _running(points, keys, ["moves", "curr", "prev"], len(calendar.snapshots()) - 1)
    rows = rows.withColumn("move_users", F.col("moves") + F.col("n")).where("move_users > 0")
    return _transition_rows(_snapshots(calendar, rows).select(
        "snapshot_date", *keys, "move_users", F.col("curr").alias("_curr"), F.col("prev").alias("_prev")))


def interval_loss_estimate(intervals: DataFrame, calendar: Calendar, dedup: bool = False) -> DataFrame:
    """A17 from the intervals; see ``churn_loss_estimate``."""
    last = len(calendar.snapshots()) - 1
    counts = _user_counts(intervals, calendar)
    per_user = intervals.groupBy("user_id").agg(
        F.max(((F.col("last_idx") == last) & (F.col("segment") == C.CHURN_CHURNED)).cast("int")).alias("churned"),
        F.sum(_zero("spend")).alias("ltv_all"))
    at_last = counts.where(F.col("idx") == last).agg(
        F.coalesce(F.sum(F.when(F.col("segment") == C.CHURN_ACTIVE, F.col("cnt"))), F.lit(0)).alias("last_active_cnt"),
        ratio(F.sum("ltv"), F.sum("cnt")).alias("last_arpu"))
    users = _snapshots(calendar, counts.where(F.col("idx") > last - 3).groupBy("idx").agg(F.sum("cnt").alias("cnt")))
    return _loss(per_user, at_last, users.select("snapshot_date", "cnt"), interval_transition(intervals, calendar), calendar, dedup)


def churn_stats(churn: DataFrame) -> DataFrame:
    """A15. Users and spend per (snapshot, status)."""
    return churn.groupBy("snapshot_date", "segment").agg(
        F.count(F.lit(1)).alias("cnt"),  # one row per user and snapshot
        money(F.sum("ltv")).alias("total_ltv"))


def churn_transition(churn: DataFrame) -> DataFrame:
    """A16. Status moves between consecutive snapshots, with the share of the
    previous status' users that made each move (percent, 2 places, half-up)."""
    t = transitions(churn, "segment", "ltv")
    g = t.groupBy("snapshot_date", F.col("prev_state").alias("prev_segment"),
                  F.col("curr_state").alias("curr_segment")).agg(
        F.count(F.lit(1)).alias("move_users"),
        F.sum("curr_value").alias("_curr"),
        F.sum("prev_value").alias("_prev"))
    return _transition_rows(g)


def _transition_rows(g: DataFrame) -> DataFrame:
    """Totals and rates, in the order of the original's result table."""
    prev_total = F.sum("move_users").over(Window.partitionBy("snapshot_date", "prev_segment"))
    g = g.select("*", prev_total.alias("prev_total_users"))
    return g.select("snapshot_date", "prev_segment", "curr_segment", "move_users", "prev_total_users",
                    half_up(F.col("move_users") * 100, F.col("prev_total_users"), 2).alias("transition_rate_pct"),
                    money(F.col("_curr")).alias("curr_total_ltv"),
                    money(F.col("_prev")).alias("prev_total_ltv")).orderBy("snapshot_date", "prev_segment", "curr_segment")


def churn_loss_estimate(churn: DataFrame, trans: DataFrame, calendar: Calendar,
                        dedup: bool = False) -> DataFrame:
    """A17. Spend at risk from the users active at the last snapshot.

    churn_total_cnt / churn_ago_total_ltv: users CHURNED at the last snapshot and
    their spend over all snapshots.  ratio_*: users newly churned in each of the
    last three snapshots over the snapshot's users.  As in the original, the
    denominator is counted once per previous status that fed the churn
    (``dedup=True`` counts it once).  lose_ltv = active users x mean ratio x ARPU.

    Three one-row aggregates are combined by a union and a column-wise max (no
    join is needed to put them side by side).
    """
    at_last = F.col("snapshot_date") == F.lit(calendar.snapshots()[-1])
    per_user = churn.groupBy("user_id").agg(
        F.max((at_last & (F.col("segment") == C.CHURN_CHURNED)).cast("int")).alias("churned"),
        F.sum("ltv").alias("ltv_all"))
    b = churn.where(at_last).agg(
        F.count(F.when(F.col("segment") == C.CHURN_ACTIVE, 1)).alias("last_active_cnt"),
        ratio(F.sum("ltv"), F.count(F.lit(1))).alias("last_arpu"))
    users = churn.where(F.col("snapshot_date").isin(*calendar.snapshots()[-3:])).groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("cnt"))
    return _loss(per_user, b, users, trans, calendar, dedup)


def _loss(per_user: DataFrame, b: DataFrame, users: DataFrame, trans: DataFrame, calendar: Calendar, dedup: bool) -> DataFrame:
    last3 = calendar.snapshots()[-3:]
    a = per_user.agg(F.sum("churned").cast("long").alias("churn_total_cnt"),
                     money(F.sum(F.when(F.col("churned") == 1, F.col("ltv_all")))).alias("churn_ago_total_ltv"))
    moves = trans.where((F.col("curr_segment") == C.CHURN_CHURNED) &
                        (F.col("prev_segment") != C.CHURN_CHURNED) &
                        F.col("snapshot_date").isin(*last3))
    m = moves.groupBy("snapshot_date").agg(F.sum("move_users").alias("moved"),
                                           F.count(F.lit(1)).alias("k"))
    r = m.join(users, "snapshot_date")
    den = F.col("cnt") if dedup else F.col("cnt") * F.col("k")
    r = r.select("snapshot_date", ratio(F.col("moved"), den).alias("r"))
    names = ["ratio_prev2", "ratio_prev1", "ratio_last"][-len(last3):]
    c = r.agg(*[F.max(F.when(F.col("snapshot_date") == F.lit(s), F.col("r"))).alias(n)
                for s, n in zip(last3, names)])
    one = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    cols = ["churn_total_cnt", "churn_ago_total_ltv", "last_active_cnt", *names, "last_arpu"]
    row = one.agg(*[F.max(x).alias(x) for x in cols])
    mean_ratio = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    return row.select(*cols, (F.col("last_active_cnt") * mean_ratio * F.col("last_arpu")).alias("lose_ltv"))
