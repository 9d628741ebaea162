"""Exact distinct users at any grain from one month table (G3, G4, A12 by quarter and year).

A count of distinct users cannot be added up over months.  Here the month table holds each
(cohort, month)'s users as bitmaps of 32,768 user numbers, 4 KB each; a quarter's or a year's
users are the OR of its months, so no grain reads purchases again and no user is shuffled
after the month table is made.

Users are numbered by first period and id, so a cohort's numbers are contiguous and its
bitmaps are dense: about (users / 32,768 + cohorts) bitmaps a month.  Users of later periods get
the numbers after the known ones, so stored bitmaps stay valid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ntile import global_row_number
from ._util import ratio

#: Grains that months add up to, with their months.
GRAINS = {"month": 1, "quarter": 3, "year": 12}


def number_users(up: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(user_id, cohort_start, number) of the users of the (user, month) table ``up``, numbered from 1.

    ``known`` is an earlier result: its users keep their numbers, new ones follow.  The order
    is by range partitions; only partition sizes are summed in one place."""
    first = up.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.min("period_start").alias("cohort_start"))
    last = 0
    if known is not None:
        first = first.join(known.select("user_id"), "user_id", "left_anti")
        last = known.agg(F.max("number")).first()[0] or 0
    new = global_row_number(first, [F.col("cohort_start").asc(), F.col("user_id").asc()], out="number")
    new = new.select("user_id", "cohort_start", (F.col("number") + last).cast("long").alias("number"))
    return new if known is None else known.select(*new.columns).unionByName(new)


def activity_bitmaps(up: DataFrame, numbers: DataFrame) -> DataFrame:
    """(cohort_start, period_start, bucket, users): a bitmap per (cohort, month, 32,768 numbers)."""
    return (up.select("user_id", "period_start").join(numbers, "user_id")
            .groupBy("cohort_start", "period_start", F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("users")))


def merge_bitmaps(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Two bitmap tables as one; cells that both hold are OR-ed."""
    return (stored.unionByName(new).groupBy("cohort_start", "period_start", "bucket")
            .agg(F.bitmap_or_agg("users").alias("users")))


def _trunc(c: str, grain: str) -> Column:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {tuple(GRAINS)}, got {grain!r}")
    return F.trunc(c, grain)


def active_users_at(bitmaps: DataFrame, grain: str) -> DataFrame:
    """(period_start, active_users) at ``grain``."""
    return (bitmaps.groupBy(_trunc("period_start", grain).alias("period_start"), "bucket")
            .agg(F.bitmap_or_agg("users").alias("users"))
            .groupBy("period_start").agg(F.sum(F.bitmap_count("users")).alias("active_users")))


def active_users_by_grain(bitmaps: DataFrame) -> DataFrame:
    """(grain, period_start, active_users) at every grain."""
    return reduce(DataFrame.unionByName, [active_users_at(bitmaps, g).select(F.lit(g).alias("grain"), "period_start", "active_users")
                                          for g in GRAINS])


def cohort_retention_at(bitmaps: DataFrame, grain: str) -> DataFrame:
    """A12's user counts at ``grain``: (cohort_date, cohort_age, first_user, active_users, retention_rate)."""
    age = F.months_between(_trunc("period_start", grain), _trunc("cohort_start", grain)) / GRAINS[grain]
    n = (bitmaps.groupBy(_trunc("cohort_start", grain).alias("cohort_date"), age.cast("int").alias("cohort_age"), "bucket")
         .agg(F.bitmap_or_agg("users").alias("users"))
         .groupBy("cohort_date", "cohort_age").agg(F.sum(F.bitmap_count("users")).alias("active_users")))
    # every member is active at age 0
    size = F.max(F.when(F.col("cohort_age") == 0, F.col("active_users"))).over(Window.partitionBy("cohort_date"))
    return n.select("cohort_date", "cohort_age", size.alias("first_user"), "active_users",
                    ratio(F.col("active_users"), size).alias("retention_rate"))


def cohort_retention_by_grain(bitmaps: DataFrame) -> DataFrame:
    """``cohort_retention_at`` at every grain, with the grain as first column."""
    return reduce(DataFrame.unionByName, [cohort_retention_at(bitmaps, g).select(F.lit(g).alias("grain"), "*") for g in GRAINS])
