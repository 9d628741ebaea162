"""Before/after comparison tables that feed the statistical tests.

'current' = the last ``current_n`` snapshots (or cohorts, after skipping the
``skip_latest_cohorts`` still-maturing ones), 'past' = everything before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, Params
from ..functions.dates import Calendar, add_periods
from ..functions.segments import point_of_view
from ._util import ratio


def _current_cohorts(cohort_dates: DataFrame, params: Params):
    """(from, to) bounds of the 'current' cohorts as scalar-subquery Columns."""
    latest = cohort_dates.agg(F.max("cohort_date")).scalar()
    hi = add_periods(latest, -params.skip_latest_cohorts, params.grain)
    lo = add_periods(latest, -(params.skip_latest_cohorts + params.current_n - 1), params.grain)
    return lo, hi


def cohort_period_compare(cohort_ret: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """A21. Mean cohort size and mean age-1 actives of past vs current cohorts
    (two rows, always present; the latest cohort is excluded)."""
    lo, hi = _current_cohorts(cohort_ret, params)
    base = cohort_ret.where(F.col("cohort_age") == 1)
    cur = (F.col("cohort_date") >= lo) & (F.col("cohort_date") <= hi)
    past = F.col("cohort_date") < lo
    agg = base.agg(
        F.avg(F.when(past, F.col("first_user"))).alias("p_first"),
        F.avg(F.when(past, F.col("active_users"))).alias("p_active"),
        F.avg(F.when(cur, F.col("first_user"))).alias("c_first"),
        F.avg(F.when(cur, F.col("active_users"))).alias("c_active"))
    return agg.selectExpr(
        f"stack(2, '{C.PAST}', p_first, p_active, '{C.CURRENT}', c_first, c_active) "
        "AS (point_of_view, first_user, active_user)")


def segment_initial_retention(cohort_seg: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """A22. Per segment and current cohort: users active at age 1 and the rest of
    the age-0 users (NULL segment dropped)."""
    lo, hi = _current_cohorts(cohort_seg, params)
    age = F.col("cohort_age")
    g = cohort_seg.groupBy("rfm_segment", F.col("cohort_date").alias("curr_period")).agg(
        F.sum(F.when(age == 0, F.col("active_number"))).alias("total_number"),
        F.sum(F.when(age == 1, F.col("active_number"))).alias("action_number"))
    return g.where((F.col("curr_period") >= lo) & (F.col("curr_period") <= hi) &
                   F.col("rfm_segment").isNotNull()).select(
        "rfm_segment", "curr_period", "action_number",
        (F.col("total_number") - F.col("action_number")).alias("non_action_number"))


def high_segment_rm(mrfm: DataFrame, calendar: Calendar, params: Params = DEFAULT) -> DataFrame:
    """A24. Mean recency and mean period spend of high-segment users, past vs current."""
    current_from = F.lit(calendar.current_from(params.current_n))
    m = mrfm.where(F.col("rfm_segment").isin(*params.high_segments))
    g = m.groupBy(point_of_view(F.col("snapshot_date"), current_from).alias("point_of_view"), "user_id").agg(
        F.avg("recency").alias("avg_recency"),
        F.sum("month_monetary").alias("_m"), F.count("month_monetary").alias("_n"))
    return g.select("point_of_view", "user_id", "avg_recency",
                    ratio(F.col("_m"), F.col("_n")).alias("avg_monetary"))
