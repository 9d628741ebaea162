"""Calendars and parameters that registered queries state instead of deriving.

A wide table has a column per period, so its calendar is part of the query: the
months that the order table covers at every scale.  ``covering`` fails where a table
has periods outside it, which a pivot would drop.
"""

from __future__ import annotations

import datetime as dt

from ..config import DEFAULT
from ..functions.dates import Calendar

ORDERS_CALENDAR = Calendar(dt.date(1995, 1, 1), dt.date(2001, 8, 1))


def covering(calendar: Calendar, data: Calendar) -> Calendar:
    """``calendar``, after a check that no period of ``data`` lies outside it."""
    if calendar.grain != data.grain or data.first < calendar.first or data.last > calendar.last:
        raise ValueError(f"the data cover {data.first} to {data.last} by {data.grain}, the query's calendar "
                         f"{calendar.first} to {calendar.last} by {calendar.grain}")
    return calendar


# The tests on initial retention compare segments over five years of cohorts: in the last
# two months alone no segment of the order table has a user who came back.
RETENTION_TESTS = DEFAULT.with_(current_n=60)
# Cells of (cohort, age) with at least so many active users enter the rank correlation.
SPEARMAN_MIN_USERS = 5
