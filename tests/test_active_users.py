"""Bitmaps of user numbers give the distinct counts of every grain."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from churnlens.operators import active_users


def _up(spark, rows):
    return spark.createDataFrame(rows, "user_id string, period_start date")


def test_counts_equal_a_recount(spark):
    rnd = random.Random(4)
    # numbers over several bitmaps, ids far from dense
    rows = [(f"u{u * 7919}", dt.date(2019 + m // 12, m % 12 + 1, 1)) for u in range(40_000)
            for m in {rnd.randrange(30) for _ in range(1 + u % 2)}] + [(None, dt.date(2019, 1, 1))]
    up = _up(spark, rows).cache()
    numbers = active_users.number_users(up).cache()
    assert tuple(numbers.agg(F.min("number"), F.max("number"), F.count_distinct("number")).first()) == (1, 40_000, 40_000)
    bitmaps = active_users.activity_bitmaps(up, numbers).cache()
    # a cohort's numbers are contiguous
    assert bitmaps.groupBy("cohort_start", "period_start").count().agg(F.max("count")).first()[0] <= 2
    for grain in active_users.GRAINS:
        want = {}
        for u, m in rows:
            if u is not None:
                want.setdefault(m.replace(day=1, month={"month": m.month, "quarter": (m.month - 1) // 3 * 3 + 1, "year": 1}[grain]), set()).add(u)
        got = {r["period_start"]: r["active_users"] for r in active_users.active_users_at(bitmaps, grain).collect()}
        assert got == {p: len(u) for p, u in want.items()}
        sizes = active_users.cohort_retention_at(bitmaps, grain).where("cohort_age = 0")
        assert sizes.agg(F.sum("first_user")).first()[0] == 40_000
    for df in (up, numbers, bitmaps):
        df.unpersist()


def test_later_months_keep_the_numbers(spark):
    old = [("a", dt.date(2020, 1, 1)), ("b", dt.date(2020, 2, 1))]
    new = [("0", dt.date(2020, 3, 1)), ("a", dt.date(2020, 3, 1)), ("c", dt.date(2020, 4, 1))]
    numbers = active_users.number_users(_up(spark, old))
    stored = active_users.activity_bitmaps(_up(spark, old), numbers)
    more = active_users.number_users(_up(spark, new), numbers)
    assert {r["user_id"]: r["number"] for r in more.collect()} == {"a": 1, "b": 2, "0": 3, "c": 4}
    both = active_users.merge_bitmaps(stored, active_users.activity_bitmaps(_up(spark, new), more))
    whole = active_users.activity_bitmaps(_up(spark, old + new), more)
    for f in (active_users.active_users_by_grain, active_users.cohort_retention_by_grain):
        assert sorted(map(str, f(both).collect())) == sorted(map(str, f(whole).collect()))


def test_empty_table_and_unknown_grain(spark):
    empty = _up(spark, [])
    bitmaps = active_users.activity_bitmaps(empty, active_users.number_users(empty))
    assert active_users.active_users_by_grain(bitmaps).count() == 0
    with pytest.raises(ValueError, match="grain"):
        active_users.active_users_at(bitmaps, "week")
