"""Distributed NTILE / prefix sums / ranks / median equal their plain definitions."""
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.functions.ntile import ntile, ntiles
from churnlens.functions.ranks import average_ranks, exact_median, prefix_sum


def _frame(spark, n=600, keys=7, groups=3, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(groups), rnd.randrange(keys), rnd.random()) for i in range(n)]
    return spark.createDataFrame(rows, "user_id long, g int, k int, v double")


@pytest.mark.parametrize("group", [(), ("g",)])
def test_ntile_matches_window(spark, group):
    df = _frame(spark)
    got = ntile(df, 5, [F.col("k").desc()], "t", group=group)
    w = Window.partitionBy(*group).orderBy(F.col("k").desc(), F.col("user_id"))
    exp = df.select("*", F.ntile(5).over(w).alias("t"))
    assert sorted(got.select("user_id", "t").collect()) == sorted(exp.select("user_id", "t").collect())


def test_ntiles_match_windows(spark):
    df = _frame(spark, n=333)
    got = ntiles(df, 5, [("k", True, "a"), ("v", False, "b")], group=("g",))
    w = Window.partitionBy("g")
    exp = df.select("*", F.ntile(5).over(w.orderBy(F.col("k").desc(), "user_id")).alias("a"),
                    F.ntile(5).over(w.orderBy("v", "user_id")).alias("b"))
    assert got.columns == exp.columns and sorted(got.collect()) == sorted(exp.collect())


def test_ntiles_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 5), (1, None, None), (2, 1, 7), (3, None, 9)], "user_id long, g int, k int")
    got = ntiles(df, 2, [("k", False, "t")], group=("g",))
    w = Window.partitionBy("g").orderBy("k", "user_id")
    exp = df.select("*", F.ntile(2).over(w).alias("t"))
    assert sorted(map(str, got.collect())) == sorted(map(str, exp.collect()))


@pytest.mark.parametrize("few, bins, group", [(20_000, 4096, ()), (30, 4096, ("g",))])
def test_selected_tiles_match_windows(spark, monkeypatch, few, bins, group):
    """Integers, decimals and dates with heavy ties, nulls, negative values and a hot key."""
    from churnlens.functions import selection
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BINS", bins)
    rnd = random.Random(4)
    rows = [(u * 7 - 300, rnd.choice([0, 0, 0, None, 2]), rnd.choice([None, 1, 1, 1, 1, -5, rnd.randrange(10**6)]),
             rnd.randrange(-50, 10**9), rnd.randrange(20_000)) for u in range(400)]
    df = spark.createDataFrame(rows, "user_id long, g int, k int, cents long, day int").selectExpr(
        "user_id", "g", "k", "CAST(cents / 100 AS DECIMAL(28,2)) AS money", "date_add(DATE'1990-01-01', day) AS day").repartition(5)
    got = ntiles(df, 5, [("k", True, "a"), ("money", False, "b"), ("day", True, "c")], group=group)
    w = Window.partitionBy(*group)
    exp = df.select("*", F.ntile(5).over(w.orderBy(F.col("k").desc(), "user_id")).alias("a"),
                    F.ntile(5).over(w.orderBy("money", "user_id")).alias("b"),
                    F.ntile(5).over(w.orderBy(F.col("day").desc(), "user_id")).alias("c"))
    assert got.columns == exp.columns and sorted(map(str, got.collect())) == sorted(map(str, exp.collect()))


def test_selection_sorts_no_rows_for_a_tile(spark):
    df = spark.range(50_000).selectExpr("id AS user_id", "CAST(id % 97 AS INT) AS k")
    plan = ntiles(df, 5, [("k", True, "a")])._jdf.queryExecution().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan and "SortMergeJoin" not in plan
    counts = {r.a: r["count"] for r in ntiles(df, 5, [("k", True, "a")]).groupBy("a").count().collect()}
    assert counts == {t: 10_000 for t in range(1, 6)}


def test_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "user_id long, k int")
    got = {r.user_id: r.t for r in ntile(df, 5, [F.col("k").asc()], "t").collect()}
    assert got == {1: 1, 2: 2, 3: 3}


def test_ties_broken_by_user_id(spark):
    df = spark.createDataFrame([(u, 4) for u in range(7, 0, -1)], "user_id long, k int")
    got = {r.user_id: r.t for r in ntile(df, 5, [F.col("k").asc()], "t").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 4, 7: 5}


def test_prefix_sum_and_ranks(spark):
    df = _frame(spark, n=400, keys=12)
    got = {(r.g, r.k): r.ps for r in prefix_sum(
        df.groupBy("g", "k").count(), [F.col("k").asc()], "count", "ps", group=("g",)).collect()}
    rows = df.collect()
    for (g, k), ps in got.items():
        assert ps == sum(1 for r in rows if r.g == g and r.k < k)
    ranks = {(r.g, r.k): r.avg_rank for r in average_ranks(df, "k", group=("g",)).collect()}
    for (g, k), rk in ranks.items():
        vals = sorted(r.k for r in rows if r.g == g)
        pos = [i + 1 for i, v in enumerate(vals) if v == k]
        assert rk == pytest.approx(sum(pos) / len(pos))


@pytest.mark.parametrize("n", [1, 2, 7, 10])
def test_exact_median(spark, n):
    vals = [float(x) for x in random.Random(n).choices(range(5), k=n)]
    df = spark.createDataFrame([(v,) for v in vals], "d double")
    assert exact_median(df, "d").first()["median"] == statistics.median(vals)


def test_hot_key_is_split_across_range_partitions(spark):
    """One key value holding a third of the rows still spreads over many range
    partitions, because the user id is part of the range key."""
    n = 3000
    rows = [(i, 0 if i % 3 == 0 else i) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id long, k long")
    parts = (df.repartitionByRange(8, F.col("k").asc(), F.col("user_id").asc())
             .groupBy(F.spark_partition_id().alias("p")).count().collect())
    sizes = [r["count"] for r in parts]
    assert len(sizes) == 8 and max(sizes) < 2 * n / 8
