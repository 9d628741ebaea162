"""Snapshot calendar and period arithmetic as Column expressions.

A *period* is a calendar month or an ISO week (Monday start).  Its *snapshot
date* is the last day of the period.  All helpers return built-in Column
expressions so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAINS = ("month", "week")


def _check(grain: str) -> None:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")


def period_start(c: Column | str, grain: str) -> Column:
    """First day (DATE) of the period containing a date/timestamp column."""
    _check(grain)
    d = F.to_date(c) if isinstance(c, str) else F.to_date(c)
    return F.trunc(d, "month" if grain == "month" else "week")


def period_end(start: Column, grain: str) -> Column:
    """Snapshot date (last day) of the period starting at ``start``."""
    _check(grain)
    return F.last_day(start) if grain == "month" else F.date_add(start, 6)


def add_periods(start: Column, k: int | Column, grain: str) -> Column:
    _check(grain)
    if grain == "month":
        return F.add_months(start, k)
    return F.date_add(start, (k * 7) if isinstance(k, int) else k * F.lit(7))


def periods_between(later: Column, earlier: Column, grain: str) -> Column:
    """Whole periods between two period starts (exact: both are period starts)."""
    _check(grain)
    if grain == "month":
        return F.months_between(later, earlier).cast("int")
    return (F.datediff(later, earlier) / 7).cast("int")


def period_sequence(first: Column, last: Column, grain: str) -> Column:
    """Array of period starts first..last (empty when first > last)."""
    _check(grain)
    step = F.expr("INTERVAL 1 MONTH") if grain == "month" else F.expr("INTERVAL 7 DAYS")
    return F.when(first <= last, F.sequence(first, last, step)).otherwise(
        F.array().cast("array<date>"))


def py_period_start(d: dt.date, grain: str) -> dt.date:
    _check(grain)
    if grain == "month":
        return d.replace(day=1)
    return d - dt.timedelta(days=d.weekday())


def py_add_periods(d: dt.date, k: int, grain: str) -> dt.date:
    _check(grain)
    if grain == "week":
        return d + dt.timedelta(days=7 * k)
    m = d.month - 1 + k
    return d.replace(year=d.year + m // 12, month=m % 12 + 1, day=1)


def py_period_end(start: dt.date, grain: str) -> dt.date:
    _check(grain)
    if grain == "week":
        return start + dt.timedelta(days=6)
    return py_add_periods(start, 1, "month") - dt.timedelta(days=1)


def _as_date(v) -> dt.date:
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, str):  # ISO text times
        return dt.date.fromisoformat(v[:10])
    return v


@dataclass(frozen=True)
class Calendar:
    """Contiguous run of snapshot periods ``first..last`` (period starts).

    The calendar is a query parameter (the original analysis hard-codes seven
    month-ends); ``from_data`` derives the run that covers a whole table.
    """

    first: dt.date
    last: dt.date
    grain: str = "month"

    def __post_init__(self):
        _check(self.grain)
        if py_period_start(self.first, self.grain) != self.first or \
                py_period_start(self.last, self.grain) != self.last:
            raise ValueError("calendar bounds must be period starts")
        if self.first > self.last:
            raise ValueError("empty calendar")

    @staticmethod
    def of_snapshots(first_snapshot: dt.date, last_snapshot: dt.date,
                     grain: str = "month") -> "Calendar":
        """Calendar whose snapshot dates run from ``first_snapshot`` to ``last_snapshot``."""
        a, b = py_period_start(first_snapshot, grain), py_period_start(last_snapshot, grain)
        if py_period_end(a, grain) != first_snapshot or py_period_end(b, grain) != last_snapshot:
            raise ValueError("snapshots must be period ends (last day of month / Sunday)")
        return Calendar(a, b, grain)

    @staticmethod
    def from_data(df: DataFrame, time_col: str = "event_time", grain: str = "month") -> "Calendar":
        """All periods from the first to the last event of ``df``.

        One global min/max aggregate (answered from parquet footers when
        aggregate pushdown is on); only the two bounds reach the driver.
        """
        row = df.agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi")).first()
        if row is None or row["lo"] is None:
            raise ValueError("cannot derive a calendar from an empty table")
        lo, hi = _as_date(row["lo"]), _as_date(row["hi"])
        return Calendar(py_period_start(lo, grain), py_period_start(hi, grain), grain)

    @property
    def n(self) -> int:
        if self.grain == "month":
            return (self.last.year - self.first.year) * 12 + self.last.month - self.first.month + 1
        return (self.last - self.first).days // 7 + 1

    def starts(self) -> list[dt.date]:
        return [py_add_periods(self.first, i, self.grain) for i in range(self.n)]

    def snapshots(self) -> list[dt.date]:
        return [py_period_end(s, self.grain) for s in self.starts()]

    def current_from(self, current_n: int) -> dt.date:
        """First snapshot of the 'current' window: the last ``current_n``
        snapshots (the whole calendar when it is shorter)."""
        snaps = self.snapshots()
        return snaps[max(0, len(snaps) - current_n)]

    @property
    def last_snapshot(self) -> dt.date:
        return py_period_end(self.last, self.grain)

    def first_col(self) -> Column:
        return F.lit(self.first)

    def last_col(self) -> Column:
        return F.lit(self.last)

    def contains(self, start: Column) -> Column:
        return (start >= F.lit(self.first)) & (start <= F.lit(self.last))

    def frame(self, spark: SparkSession) -> DataFrame:
        """Calendar as a DataFrame (period_start, snapshot_date), built on executors."""
        start = add_periods(F.lit(self.first), F.col("id").cast("int"), self.grain)
        return (spark.range(self.n)
                .select(start.alias("period_start"))
                .select("period_start", period_end(F.col("period_start"), self.grain).alias("snapshot_date")))

    def label(self, start: dt.date) -> str:
        """Column label of a period in wide (pivot) outputs."""
        return start.strftime("%Y-%m") if self.grain == "month" else start.strftime("%Y-%m-%d")
