"""Segment rules as ordered CASE expressions (first matching branch wins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def rfm_segment(r: Column | str = "recency_score", f: Column | str = "frequency_score",
                m: Column | str = "monetary_score") -> Column:
    r, f, m = (F.col(x) if isinstance(x, str) else x for x in (r, f, m))
    return (
        F.when((r == 5) & (f == 5) & (m == 5), C.RFM_VIP)
        .when((r >= 4) & (f >= 4) & (m >= 4), C.RFM_LOYAL)
        .when((r >= 3) & (f >= 3) & (m >= 3), C.RFM_GROWTH)
        .when((r == 5) & (f == 1), C.RFM_NEW)
        .when((r == 1) & (f <= 2), C.RFM_HIGH_CHURN_RISK)
        .when((r == 2) & (f <= 2), C.RFM_CHURN_EXPECTED)
        .otherwise(C.RFM_REGULAR)
    )


def churn_segment(is_new: Column, recency: Column, active_days: int, risk_days: int) -> Column:
    """NEW wins over the recency rule; recency bands are (.., active], (active, risk], (risk, ..)."""
    return (
        F.when(is_new, C.CHURN_NEW)
        .when(recency <= active_days, C.CHURN_ACTIVE)
        .when((recency > active_days) & (recency <= risk_days), C.CHURN_AT_RISK)
        .when(recency > risk_days, C.CHURN_CHURNED)
    )


def point_of_view(snapshot: Column, current_from: Column) -> Column:
    """'current' for snapshots at or after ``current_from``, 'past' before it."""
    return F.when(snapshot >= current_from, C.CURRENT).when(snapshot < current_from, C.PAST)
