"""Parameters of the analytics: calendar grain, tiles, thresholds and labels.

Every operator takes its knobs from :class:`Params`; nothing is a hidden
constant.  The defaults are the values the original analysis used.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values (must equal the original analysis for equal results)
# ---------------------------------------------------------------------------
# RFM segment labels, in the precedence order of the segment rule:
#   VIP (all three scores 5), LOYAL (all >= 4), GROWTH (all >= 3),
#   NEW (recency 5, frequency 1), HIGH_CHURN_RISK (recency 1, frequency <= 2),
#   CHURN_EXPECTED (recency 2, frequency <= 2), REGULAR (everything else).
RFM_VIP = "VIP"
RFM_LOYAL = "LOYAL"
RFM_GROWTH = "GROWTH"
RFM_NEW = "NEW"
RFM_HIGH_CHURN_RISK = "HIGH_CHURN_RISK"
RFM_CHURN_EXPECTED = "CHURN_EXPECTED"
RFM_REGULAR = "REGULAR"
# Segments treated as "high value" by the segment comparisons.
HIGH_SEGMENTS = ("VIP", "GROWTH", "LOYAL")
# Churn status labels.
CHURN_NEW = "NEW"
CHURN_ACTIVE = "ACTIVE"
CHURN_AT_RISK = "AT_RISK"
CHURN_CHURNED = "CHURNED"
# Event vocabulary of the click log.
EVENT_VIEW = "view"
EVENT_CART = "cart"
EVENT_PURCHASE = "purchase"
# Trailing activity windows before a snapshot, in days.
TRAILING_DAYS = (3, 7, 14)
# Period labels of the before/after comparisons.
PAST = "past"
CURRENT = "current"


@dataclass(frozen=True)
class Params:
    """Knobs shared by all operators.

    grain            'month' or 'week': the snapshot period.
    tiles            number of NTILE buckets for the R, F and M scores.
    active_days      churn: recency <= active_days -> ACTIVE.
    risk_days        churn: active_days < recency <= risk_days -> AT_RISK, above -> CHURNED.
    trailing_days    windows of the pre-snapshot activity counts.
    current_n        the last ``current_n`` snapshots (or cohorts) form the 'current' period;
                     everything before is 'past'.
    skip_latest_cohorts  cohorts at the end excluded from cohort comparisons (still maturing).
    view_type / cart_type / purchase_type   event names.
    high_segments    segments compared by the high-segment operators.
    """

    grain: str = "month"
    tiles: int = 5
    active_days: int = 60
    risk_days: int = 90
    trailing_days: tuple[int, ...] = TRAILING_DAYS
    current_n: int = 2
    skip_latest_cohorts: int = 1
    view_type: str = EVENT_VIEW
    cart_type: str = EVENT_CART
    purchase_type: str = EVENT_PURCHASE
    high_segments: tuple[str, ...] = field(default=HIGH_SEGMENTS)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()
# The click-log test table spans one month and has no 'cart' events: weekly
# snapshots, day thresholds scaled to a week, and 'click' as the cart step.
WEEKLY_EVENTS = Params(grain="week", active_days=2, risk_days=4, cart_type="click")
