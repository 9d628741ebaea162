"""Build every mart table from one event table, in dependency order.

Each upstream table is written once and the downstream operators read the
written copy (``read_mart``), so lineage is cut at every mart and a lost
executor only recomputes the current step.  Snapshot-keyed tables are
partitioned by ``snapshot_date`` and written with dynamic partition
overwrite: re-running a calendar replaces its snapshots only.

With ``buckets``, the tables keyed by user (and the behaviour events) are bucketed by user_id
instead, so A13, A18, A20 and A25 join them without a shuffle of either side.  Their
joins are on (user_id, period); Spark takes buckets of user_id for them where
``spark.sql.requireAllClusterKeysForCoPartition`` is false (``CO_LOCATED``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from ..config import DEFAULT, WEEKLY_EVENTS, Params
from ..functions.dates import Calendar
from ..operators import behaviour, category, churn, cohort, compare, monthly, rfm
from ..sources.logs import load_events, read_events
from ..sources.mart import mart_path, read_mart, write_bucketed, write_mart


#: Session setting with which buckets of user_id serve joins on (user_id, period).
CO_LOCATED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def bucketed_name(root: str, name: str) -> str:
    """Catalog name of the bucketed table ``name`` under ``root``."""
    return f"{name}_{hashlib.sha1(root.rstrip('/').encode()).hexdigest()[:12]}"


def put_bucketed(df: DataFrame, root: str, name: str, buckets: int) -> DataFrame:
    """``df`` saved under ``root``, bucketed by user_id, one file a bucket."""
    table = write_bucketed(df.repartition(buckets, "user_id"), bucketed_name(root, name), "user_id", buckets,
                           path=mart_path(root, name))
    return df.sparkSession.table(table)


def build_marts(events: DataFrame, root: str, calendar: Calendar | None = None,
                params: Params = DEFAULT, category_events: DataFrame | None = None,
                behaviour_events: DataFrame | None = None, behaviour_params: Params = WEEKLY_EVENTS,
                buckets: int | None = None) -> dict[str, str]:
    """Write the analytic marts under ``root``; returns table name -> path.

    ``events`` is a canonical event table (see ``sources.tables``);
    ``category_events`` (default: ``events``) feeds the category tables, and
    ``behaviour_events`` (a log with views and carts; default: ``events``) the
    behaviour tables, with a calendar and parameters of its own.
    """
    spark = events.sparkSession
    cal = calendar or Calendar.from_data(events, grain=params.grain)
    params = params.with_(grain=cal.grain)
    cev = category_events if category_events is not None else events
    out: dict[str, str] = {}

    def put(name: str, df: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
        out[name] = write_mart(df, root, name, partition_by=part)
        return read_mart(spark, root, name)

    def put_by_user(name: str, df: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
        if buckets is None:
            return put(name, df, part)
        out[name] = mart_path(root, name)
        return put_bucketed(df, root, name, buckets)

    # the shared (user, period) table, and the category events as a table by month
    up = put_by_user("user_period", monthly.user_period(events, params))
    if category_events is not None:
        out["category_events"] = load_events(cev, f"{root.rstrip('/')}/category_events")
        cev = read_events(spark, out["category_events"]).drop("event_month")
    # whole-history RFM
    base = put("rfm_base", rfm.rfm_base(events, params))
    score = put("rfm_score", rfm.rfm_score(base, params))
    put("rfm_stat", rfm.rfm_segment_share(score))
    put("rfm_detail_stat", rfm.rfm_segment_sales(score))
    # snapshot RFM
    mbase = monthly.monthly_rfm_base(events, cal, params, up=up)
    mrfm = put_by_user("monthly_rfm", monthly.monthly_rfm(mbase, params), ("snapshot_date",))
    put("monthly_rfm_detail_stat", monthly.monthly_segment_stat(mrfm))
    put("monthly_rfm_detail_funnel", monthly.segment_transition_uplift(mrfm))
    put("monthly_rfm_funnel", monthly.segment_path(mrfm, cal))
    dim = put("category_dim", category.category_dim_asof(cev, cal, params), ("snapshot_date",))
    put("monthly_rfm_category", category.monthly_rfm_category(cev, mrfm, cal, params, dim=dim), ("snapshot_date",))
    # cohorts
    ages = put("cohort_ages", cohort.cohort_ages(events, params, up=up))
    cstat = put("cohort_stat", cohort.cohort_retention(events, params, ages=ages))
    cseg = put("cohort_rfm_stat", cohort.cohort_segment_retention(events, mrfm, params, up=up))
    put("cohort_age_metrics", cohort.cohort_age_metrics(events, params, ages=ages))
    # churn
    ch = put_by_user("monthly_churn", churn.churn_status(events, cal, params, up=up), ("snapshot_date",))
    put("monthly_churn_stats", churn.churn_stats(ch))
    moving = put("churn_moving", churn.churn_transition(ch))
    put("churn_user_ltv_stat", churn.churn_loss_estimate(ch, moving, cal))
    if behaviour_events is None:
        bev, bcal, bparams, bch, bmrfm = events, cal, params, ch, mrfm
    else:
        bev, bcal = behaviour_events, Calendar.from_data(behaviour_events, grain=behaviour_params.grain)
        bparams = behaviour_params.with_(grain=bcal.grain)
        if buckets is not None:
            bev = put_by_user("behaviour_events", bev)
        bup = put_by_user("behaviour_user_period", monthly.user_period(bev, bparams))
        bch = put_by_user("behaviour_churn", churn.churn_status(bev, bcal, bparams, up=bup), ("snapshot_date",))
        bmrfm = put_by_user("behaviour_rfm", monthly.monthly_rfm(monthly.monthly_rfm_base(bev, bcal, bparams, up=bup), bparams),
                    ("snapshot_date",))
    activity = put("churn_interval", behaviour.pre_snapshot_activity(bev, bch, bcal, bparams))
    put("churn_interval_by_type", behaviour.pre_snapshot_activity_by_type(activity))
    put("churn_category", category.last_purchase_category(cev, ch, params))
    put("churn_monthly_funnel", behaviour.churn_event_funnel(bev, bch, bcal, bparams))
    # comparison tables for the statistical tests
    put("retention", compare.cohort_period_compare(cstat, params))
    put("rfm_segment", compare.segment_initial_retention(cseg, params))
    put("retention_view_cart", behaviour.next_period_behaviour(bev, bparams))
    put("high_segment_rm", compare.high_segment_rm(mrfm, cal, params))
    put("high_segment_vcp", behaviour.high_segment_behaviour(bev, bmrfm, bcal, bparams))
    return out


def main(argv: list[str]) -> None:
    """python -m churnlens.plans.marts <table folder> <mart root> [buckets]"""
    import json

    from ..session import local_session
    from ..sources import tables
    sf_dir, root = argv[1], argv[2]
    spark = local_session(extra=CO_LOCATED)
    out = build_marts(tables.order_events(spark, sf_dir), root,
                      category_events=tables.category_purchase_events(spark, sf_dir),
                      behaviour_events=tables.click_events(spark, sf_dir),
                      buckets=int(argv[3]) if len(argv) > 3 else None)
    print(json.dumps(out, indent=1))
    spark.stop()


if __name__ == "__main__":
    import sys
    main(sys.argv)
