"""Registered queries: one per analytic operator, over the whole driver tables.

Each entry is ``(spark, sf_dir) -> DataFrame``.  Shared upstream frames (the
scored monthly RFM table, the churn status table, ...) are built once per
(session, table folder) and reused, the way a mart is written once and read
by the downstream jobs.  Doubles are rounded to 6 places for comparison with
the SQL oracle; money is exact DECIMAL until then.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import WEEKLY_EVENTS
from ..functions.dates import Calendar, py_add_periods
from ..operators import active_users, behaviour, category, churn, cohort, compare, increment, monthly, rfm
from ..session import ensure_checkpoint_dir
from ..sources import tables
from ..sources.logs import load_events, read_events, read_raw_log
from ..sources.mart import create_if_absent, mart_exists, read_mart, register, write_mart
from ..stats import tests as st
from .calendars import ORDERS_CALENDAR, RETENTION_TESTS, SPEARMAN_MIN_USERS, covering

_MEMO: dict[tuple, object] = {}


def _session_key(spark: SparkSession):
    """Identity of the live session: the application id changes whenever a new
    SparkContext starts, so a stopped session's frames are never reused."""
    try:
        return (spark.sparkContext.applicationId, id(spark))
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        return (getattr(spark, "session_id", None), id(spark))


def _memo(spark: SparkSession, sf_dir: str, key: str, build: Callable[[], object]):
    k = (_session_key(spark), sf_dir.rstrip("/"), key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def mart(df: DataFrame) -> DataFrame:
    """Materialize a shared table once (reliable checkpoint: survives executor
    loss and cuts lineage); downstream queries read it instead of recomputing."""
    return df.checkpoint(eager=True)


def present(df: DataFrame) -> DataFrame:
    """Round every DOUBLE column to 6 places (presentation for the oracle compare)."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name)
                       if isinstance(f.dataType, DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------
def order_events(spark, sf_dir):
    return _memo(spark, sf_dir, "ev_orders", lambda: tables.order_events(spark, sf_dir))


def rfm_base_df(spark, sf_dir):
    return _memo(spark, sf_dir, "rfm_base", lambda: rfm.rfm_base(order_events(spark, sf_dir)))


def rfm_score_df(spark, sf_dir):
    return _memo(spark, sf_dir, "rfm_score", lambda: mart(rfm.rfm_score(rfm_base_df(spark, sf_dir))))


def orders_calendar(spark, sf_dir, grain="month"):
    """Every period from the first to the last order: the whole table."""
    return _memo(spark, sf_dir, f"cal_orders_{grain}",
                 lambda: Calendar.from_data(order_events(spark, sf_dir), grain=grain))


def user_period_df(spark, sf_dir):
    """The (user, month) purchases, built by one scan of the orders and read by A5, A12,
    A13, A14 and A26."""
    return _memo(spark, sf_dir, "user_period", lambda: mart(monthly.user_period(order_events(spark, sf_dir))))


def cohort_ages_df(spark, sf_dir):
    return _memo(spark, sf_dir, "cohort_ages", lambda: mart(cohort.cohort_ages(
        order_events(spark, sf_dir), up=user_period_df(spark, sf_dir))))


def monthly_base_df(spark, sf_dir):
    return _memo(spark, sf_dir, "monthly_base", lambda: monthly.monthly_rfm_base(
        order_events(spark, sf_dir), orders_calendar(spark, sf_dir), up=user_period_df(spark, sf_dir)))


def monthly_rfm_df(spark, sf_dir):
    return _memo(spark, sf_dir, "monthly_rfm",
                 lambda: mart(monthly.monthly_rfm(monthly_base_df(spark, sf_dir))))


def churn_intervals_df(spark, sf_dir):
    return _memo(spark, sf_dir, "churn_intervals", lambda: mart(churn.churn_intervals(
        order_events(spark, sf_dir), orders_calendar(spark, sf_dir), up=user_period_df(spark, sf_dir))))


def churn_df(spark, sf_dir):
    """A row per user and snapshot, where that is what is asked for."""
    return _memo(spark, sf_dir, "churn", lambda: churn.expand_intervals(
        churn_intervals_df(spark, sf_dir), orders_calendar(spark, sf_dir)))


def last_status_df(spark, sf_dir):
    return churn.last_status(churn_intervals_df(spark, sf_dir), orders_calendar(spark, sf_dir))


def category_events(spark, sf_dir):
    """Line items joined to orders and parts once, written as a columnar table by month,
    then read by A7, A8 and A19."""
    def build():
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marts-{uuid.uuid4().hex}"
        load_events(tables.category_purchase_events(spark, sf_dir), f"{root}/category_events")
        return read_events(spark, f"{root}/category_events").drop("event_month")
    return _memo(spark, sf_dir, "ev_lines", build)


def click_events(spark, sf_dir):
    return _memo(spark, sf_dir, "ev_clicks", lambda: tables.click_events(spark, sf_dir))


def click_calendar(spark, sf_dir):
    return _memo(spark, sf_dir, "cal_clicks", lambda: Calendar.from_data(
        click_events(spark, sf_dir), grain=WEEKLY_EVENTS.grain))


def click_churn_df(spark, sf_dir):
    return _memo(spark, sf_dir, "click_churn", lambda: mart(churn.churn_status(
        click_events(spark, sf_dir), click_calendar(spark, sf_dir), WEEKLY_EVENTS)))


def click_mrfm_df(spark, sf_dir):
    return _memo(spark, sf_dir, "click_mrfm", lambda: mart(monthly.monthly_rfm(monthly.monthly_rfm_base(
        click_events(spark, sf_dir), click_calendar(spark, sf_dir), WEEKLY_EVENTS), WEEKLY_EVENTS)))


def cohort_df(spark, sf_dir):
    return _memo(spark, sf_dir, "cohort", lambda: mart(cohort.cohort_retention(
        order_events(spark, sf_dir), ages=cohort_ages_df(spark, sf_dir))))


def cohort_seg_df(spark, sf_dir):
    return _memo(spark, sf_dir, "cohort_seg", lambda: mart(cohort.cohort_segment_retention(
        order_events(spark, sf_dir), monthly_rfm_df(spark, sf_dir), up=user_period_df(spark, sf_dir))))


def _money_cols(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------
def q_rfm_base(spark, sf_dir):
    b = rfm_base_df(spark, sf_dir)
    return present(b.withColumn("monetary", F.col("monetary").cast("double")))


def q_rfm_score(spark, sf_dir):
    s = rfm_score_df(spark, sf_dir)
    return present(s.withColumn("monetary", F.col("monetary").cast("double")))


def q_rfm_segment_share(spark, sf_dir):
    return present(rfm.rfm_segment_share(rfm_score_df(spark, sf_dir)))


def q_rfm_segment_sales(spark, sf_dir):
    return present(rfm.rfm_segment_sales(rfm_score_df(spark, sf_dir)))


def q_monthly_rfm_base(spark, sf_dir):
    return present(_money_cols(monthly_base_df(spark, sf_dir), "month_monetary"))


def q_monthly_rfm(spark, sf_dir):
    return present(_money_cols(monthly_rfm_df(spark, sf_dir), "month_monetary"))


def q_monthly_segment_stat(spark, sf_dir):
    return present(monthly.monthly_segment_stat(monthly_rfm_df(spark, sf_dir)))


def q_segment_transition_uplift(spark, sf_dir):
    return present(monthly.segment_transition_uplift(monthly_rfm_df(spark, sf_dir)))


def q_segment_path(spark, sf_dir):
    cal = covering(ORDERS_CALENDAR, orders_calendar(spark, sf_dir))
    return monthly.segment_path(monthly_rfm_df(spark, sf_dir), cal)


def q_cohort_retention(spark, sf_dir):
    return present(cohort_df(spark, sf_dir))


def q_cohort_age_metrics(spark, sf_dir):
    return present(cohort_age_df(spark, sf_dir))


def q_cohort_segment_retention(spark, sf_dir):
    return present(cohort_seg_df(spark, sf_dir))


def q_churn_status(spark, sf_dir):
    return present(_money_cols(churn_df(spark, sf_dir), "ltv"))


def q_churn_stats(spark, sf_dir):
    return present(churn.interval_stats(churn_intervals_df(spark, sf_dir), orders_calendar(spark, sf_dir)))


def q_churn_transition(spark, sf_dir):
    return present(churn.interval_transition(churn_intervals_df(spark, sf_dir), orders_calendar(spark, sf_dir)))


def q_churn_loss_estimate(spark, sf_dir):
    return present(churn.interval_loss_estimate(churn_intervals_df(spark, sf_dir), orders_calendar(spark, sf_dir)))


def category_dim_df(spark, sf_dir):
    return _memo(spark, sf_dir, "cat_dim", lambda: mart(category.category_dim_asof(
        category_events(spark, sf_dir), orders_calendar(spark, sf_dir))))


def q_category_dim_asof(spark, sf_dir):
    return category_dim_df(spark, sf_dir)


def q_monthly_rfm_category(spark, sf_dir):
    return present(category.monthly_rfm_category(category_events(spark, sf_dir), monthly_rfm_df(spark, sf_dir),
                                                 orders_calendar(spark, sf_dir), dim=category_dim_df(spark, sf_dir)))


def q_monthly_rfm_category_attributed(spark, sf_dir):
    return present(category.monthly_rfm_category_attributed(
        category_events(spark, sf_dir), monthly_rfm_df(spark, sf_dir), orders_calendar(spark, sf_dir),
        dim=category_dim_df(spark, sf_dir)))


def q_last_purchase_category_purchases_only(spark, sf_dir):
    return category.last_purchase_category(category_events(spark, sf_dir), last_status_df(spark, sf_dir),
                                           purchases_only=True)


def q_churn_loss_estimate_dedup(spark, sf_dir):
    return present(churn.interval_loss_estimate(churn_intervals_df(spark, sf_dir), orders_calendar(spark, sf_dir), dedup=True))


def q_last_purchase_category(spark, sf_dir):
    return category.last_purchase_category(category_events(spark, sf_dir), last_status_df(spark, sf_dir))


def _activity(spark, sf_dir):
    return behaviour.pre_snapshot_activity(click_events(spark, sf_dir), click_churn_df(spark, sf_dir),
                                           click_calendar(spark, sf_dir), WEEKLY_EVENTS)


def q_pre_snapshot_activity(spark, sf_dir):
    return _activity(spark, sf_dir)


def q_pre_snapshot_activity_by_type(spark, sf_dir):
    return behaviour.pre_snapshot_activity_by_type(_activity(spark, sf_dir))


def q_churn_event_funnel(spark, sf_dir):
    return behaviour.churn_event_funnel(click_events(spark, sf_dir), click_churn_df(spark, sf_dir),
                                        click_calendar(spark, sf_dir), WEEKLY_EVENTS)


def q_next_period_behaviour(spark, sf_dir):
    return behaviour.next_period_behaviour(click_events(spark, sf_dir), WEEKLY_EVENTS)


def q_high_segment_behaviour(spark, sf_dir):
    return behaviour.high_segment_behaviour(click_events(spark, sf_dir), click_mrfm_df(spark, sf_dir),
                                            click_calendar(spark, sf_dir), WEEKLY_EVENTS)


def q_high_segment_rm(spark, sf_dir):
    return present(compare.high_segment_rm(monthly_rfm_df(spark, sf_dir), orders_calendar(spark, sf_dir)))


def q_cohort_period_compare(spark, sf_dir):
    return present(compare.cohort_period_compare(cohort_df(spark, sf_dir)))


def q_segment_initial_retention(spark, sf_dir):
    return compare.segment_initial_retention(cohort_seg_df(spark, sf_dir))


# ---- statistics over the analytic tables ---------------------------------
def _compare_df(spark, sf_dir):
    return _memo(spark, sf_dir, "cmp", lambda: compare.cohort_period_compare(cohort_df(spark, sf_dir)))


def _seg_ret_df(spark, sf_dir):
    return _memo(spark, sf_dir, "segret", lambda: mart(compare.segment_initial_retention(
        cohort_seg_df(spark, sf_dir), RETENTION_TESTS)))


def q_chi2_rate_test(spark, sf_dir):
    return present(st.chi2_rate_test(_compare_df(spark, sf_dir), "point_of_view", "first_user", "active_user"))


def q_chi2_rate_residuals(spark, sf_dir):
    return present(st.chi2_residuals(_compare_df(spark, sf_dir), "point_of_view", "first_user", "active_user"))


def q_anova_initial_retention(spark, sf_dir):
    return present(st.anova_oneway(st.retention_rates(_seg_ret_df(spark, sf_dir))))


def q_pairwise_mean_diff(spark, sf_dir):
    return present(st.pairwise_mean_diff(st.retention_rates(_seg_ret_df(spark, sf_dir))))


LOGIT_TERMS = ["category_cnt", "view_cnt", "cart_cnt"]


def _next_period_df(spark, sf_dir):
    return _memo(spark, sf_dir, "next_period", lambda: mart(
        behaviour.next_period_behaviour(click_events(spark, sf_dir), WEEKLY_EVENTS)))


def _logit_df(spark, sf_dir):
    return _memo(spark, sf_dir, "logit", lambda: st.logit_odds(
        _next_period_df(spark, sf_dir), "tf_purchase", LOGIT_TERMS))


def q_logit_next_period(spark, sf_dir):
    return present(_logit_df(spark, sf_dir))


def q_logit_significant(spark, sf_dir):
    """The terms of the logit with p < 0.05 (none is a valid answer)."""
    return present(st.logit_odds(_next_period_df(spark, sf_dir), "tf_purchase", LOGIT_TERMS, alpha=0.05))


def q_logit_score_equations(spark, sf_dir):
    """The derivative of the log-likelihood in each coefficient at the fitted ones."""
    scores = st.logit_scores(_next_period_df(spark, sf_dir), _logit_df(spark, sf_dir), "tf_purchase", LOGIT_TERMS)
    return scores.select("term", (F.round("score", 3) + 0.0).alias("score"))


def cohort_age_df(spark, sf_dir):
    return _memo(spark, sf_dir, "cohort_age", lambda: cohort.cohort_age_metrics(
        order_events(spark, sf_dir), ages=cohort_ages_df(spark, sf_dir)))


def q_spearman_cohort_age(spark, sf_dir):
    return present(_spearman_df(spark, sf_dir))


def _spearman_df(spark, sf_dir):
    return _memo(spark, sf_dir, "spearman", lambda: mart(st.spearman_cohort_age(
        cohort_age_df(spark, sf_dir), min_active_users=SPEARMAN_MIN_USERS)))


def _rm_df(spark, sf_dir):
    return compare.high_segment_rm(monthly_rfm_df(spark, sf_dir), orders_calendar(spark, sf_dir))


def q_paired_periods(spark, sf_dir):
    return present(st.paired_periods(_rm_df(spark, sf_dir), value_col="avg_recency"))


def _battery_df(spark, sf_dir):
    def build():
        vcp = behaviour.high_segment_behaviour(click_events(spark, sf_dir), click_mrfm_df(spark, sf_dir),
                                               click_calendar(spark, sf_dir), WEEKLY_EVENTS)
        return mart(st.test_battery({
            "high_segment_rm": (_rm_df(spark, sf_dir), ["avg_recency", "avg_monetary"]),
            "high_segment_behaviour": (vcp, ["view_cnt", "cart_cnt", "purchase_cnt"])}))
    return _memo(spark, sf_dir, "battery", build)


def q_wilcoxon_battery(spark, sf_dir):
    return present(_battery_df(spark, sf_dir))


def q_test_summary(spark, sf_dir):
    """All tests of the analysis in one table."""
    return present(st.test_summary(
        st.chi2_rate_test(_compare_df(spark, sf_dir), "point_of_view", "first_user", "active_user"),
        st.anova_oneway(st.retention_rates(_seg_ret_df(spark, sf_dir))),
        _logit_df(spark, sf_dir), _spearman_df(spark, sf_dir), _battery_df(spark, sf_dir)))


def q_segment_age_regression(spark, sf_dir):
    return present(st.segment_age_regression(cohort_seg_df(spark, sf_dir)))


def q_segment_age_normal_equations(spark, sf_dir):
    """The inner products of the regression's residuals with its demeaned columns."""
    scores = st.regression_scores(cohort_seg_df(spark, sf_dir), st.segment_age_regression(cohort_seg_df(spark, sf_dir)))
    return scores.select("term", (F.round("score", 4) + 0.0).alias("score"))


# ---- sources and sinks ----------------------------------------------------
def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/marts-{uuid.uuid4().hex}"


def q_log_round_trip(spark, sf_dir):
    """The click log as gzip CSV, loaded with the declared schema, written by month,
    read back through a named view and summed by month and type."""
    root = _scratch(spark)
    ev = click_events(spark, sf_dir)
    raw = ev.select(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "event_type",
                    F.lit(None).cast("long").alias("product_id"), F.col("category_id").cast("long").alias("category_id"),
                    "category_code", F.lit(None).cast("string").alias("brand"), "price", "user_id",
                    F.lit(None).cast("string").alias("user_session"))
    raw.write.option("header", "true").option("compression", "gzip").csv(f"{root}/raw")
    loaded = read_raw_log(spark, f"{root}/raw", timestamp_format="yyyy-MM-dd HH:mm:ss")
    load_events(loaded, f"{root}/events")
    view = f"event_log_{uuid.uuid4().hex}"
    register(read_events(spark, f"{root}/events"), view)
    return spark.sql(f"""SELECT event_month, event_type, count(*) AS n, count(DISTINCT user_id) AS users,
                                sum(category_id) AS category_sum, CAST(sum(price) AS DOUBLE) AS price_sum
                         FROM {view} GROUP BY event_month, event_type""")


def q_mart_round_trip(spark, sf_dir):
    """The snapshot table written by append in two parts, one snapshot overwritten
    twice, creation of what exists skipped, then loaded with a projection and a filter."""
    root, m = _scratch(spark), monthly_rfm_df(spark, sf_dir)
    cut, again = dt.date(1998, 1, 31), dt.date(1997, 6, 30)
    assert not mart_exists(spark, root, "monthly_rfm")
    create_if_absent({"monthly_rfm": m.where(F.col("snapshot_date") <= F.lit(cut))}, root,
                     {"monthly_rfm": ("snapshot_date",)})
    write_mart(m.where(F.col("snapshot_date") > F.lit(cut)), root, "monthly_rfm", "append", ("snapshot_date",))
    create_if_absent({"monthly_rfm": m.limit(0)}, root)
    for _ in range(2):
        write_mart(m.where(F.col("snapshot_date") == F.lit(again)), root, "monthly_rfm", "overwrite", ("snapshot_date",))
    back = read_mart(spark, root, "monthly_rfm", ["user_id", "snapshot_date", "rfm_segment", "month_monetary"],
                     "rfm_segment <> 'REGULAR'")
    return back.select("user_id", "snapshot_date", "rfm_segment", F.col("month_monetary").cast("double").alias("month_monetary"))


# ---- snapshots appended from a stored state --------------------------------
APPENDED = 3


def appended_root(spark, sf_dir):
    """All orders up to the third last month stored at once, then the last three months
    appended one by one."""
    def build():
        root, ev, cal = _scratch(spark), order_events(spark, sf_dir), orders_calendar(spark, sf_dir)
        increment.seed(ev, root, py_add_periods(cal.last, -APPENDED, cal.grain))
        for k in range(1 - APPENDED, 1):
            increment.append_period(ev, root, py_add_periods(cal.last, k, cal.grain))
        return root
    return _memo(spark, sf_dir, "appended", build)


def q_appended_churn_status(spark, sf_dir):
    df = read_mart(spark, appended_root(spark, sf_dir), "monthly_churn")
    return present(_money_cols(df.select("user_id", "snapshot_date", "segment", "ltv"), "ltv"))


def q_appended_monthly_rfm(spark, sf_dir):
    return present(_money_cols(read_mart(spark, appended_root(spark, sf_dir), "monthly_rfm"), "month_monetary"))


def q_appended_rfm_base(spark, sf_dir):
    root = appended_root(spark, sf_dir)
    return present(_money_cols(increment.stored_rfm_base(spark, root, orders_calendar(spark, sf_dir).last), "monetary"))


def q_appended_cohort_retention(spark, sf_dir):
    ages = increment.stored_cohort_ages(spark, appended_root(spark, sf_dir))
    return present(cohort.cohort_retention(order_events(spark, sf_dir), ages=ages))


# ---- distinct users at any grain -------------------------------------------
def activity_bitmaps_df(spark, sf_dir):
    def build():
        up = user_period_df(spark, sf_dir)
        return mart(active_users.activity_bitmaps(up, active_users.number_users(up)))
    return _memo(spark, sf_dir, "bitmaps", build)


def q_active_users_by_grain(spark, sf_dir):
    return active_users.active_users_by_grain(activity_bitmaps_df(spark, sf_dir))


def q_cohort_retention_by_grain(spark, sf_dir):
    return present(active_users.cohort_retention_by_grain(activity_bitmaps_df(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries in dependency order (upstream marts first)."""
    return {
        "rfm_base": q_rfm_base,
        "rfm_score": q_rfm_score,
        "rfm_segment_share": q_rfm_segment_share,
        "rfm_segment_sales": q_rfm_segment_sales,
        "monthly_rfm_base": q_monthly_rfm_base,
        "monthly_rfm": q_monthly_rfm,
        "monthly_segment_stat": q_monthly_segment_stat,
        "segment_transition_uplift": q_segment_transition_uplift,
        "segment_path": q_segment_path,
        "category_dim_asof": q_category_dim_asof,
        "monthly_rfm_category": q_monthly_rfm_category,
        "monthly_rfm_category_attributed": q_monthly_rfm_category_attributed,
        "cohort_retention": q_cohort_retention,
        "cohort_age_metrics": q_cohort_age_metrics,
        "cohort_segment_retention": q_cohort_segment_retention,
        "churn_status": q_churn_status,
        "churn_stats": q_churn_stats,
        "churn_transition": q_churn_transition,
        "churn_loss_estimate": q_churn_loss_estimate,
        "churn_loss_estimate_dedup": q_churn_loss_estimate_dedup,
        "last_purchase_category": q_last_purchase_category,
        "last_purchase_category_purchases_only": q_last_purchase_category_purchases_only,
        "pre_snapshot_activity": q_pre_snapshot_activity,
        "pre_snapshot_activity_by_type": q_pre_snapshot_activity_by_type,
        "churn_event_funnel": q_churn_event_funnel,
        "next_period_behaviour": q_next_period_behaviour,
        "high_segment_behaviour": q_high_segment_behaviour,
        "cohort_period_compare": q_cohort_period_compare,
        "segment_initial_retention": q_segment_initial_retention,
        "high_segment_rm": q_high_segment_rm,
        "chi2_rate_test": q_chi2_rate_test,
        "chi2_rate_residuals": q_chi2_rate_residuals,
        "anova_initial_retention": q_anova_initial_retention,
        "pairwise_mean_diff": q_pairwise_mean_diff,
        "logit_next_period": q_logit_next_period,
        "logit_significant": q_logit_significant,
        "logit_score_equations": q_logit_score_equations,
        "spearman_cohort_age": q_spearman_cohort_age,
        "paired_periods": q_paired_periods,
        "wilcoxon_battery": q_wilcoxon_battery,
        "segment_age_regression": q_segment_age_regression,
        "segment_age_normal_equations": q_segment_age_normal_equations,
        "test_summary": q_test_summary,
        "log_round_trip": q_log_round_trip,
        "mart_round_trip": q_mart_round_trip,
        "appended_churn_status": q_appended_churn_status,
        "appended_monthly_rfm": q_appended_monthly_rfm,
        "appended_rfm_base": q_appended_rfm_base,
        "appended_cohort_retention": q_appended_cohort_retention,
        "active_users_by_grain": q_active_users_by_grain,
        "cohort_retention_by_grain": q_cohort_retention_by_grain,
    }
