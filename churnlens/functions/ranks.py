"""Ordered prefix sums, average (tie-aware) ranks and exact medians without a
global single-partition window.

Same technique as :mod:`ntile`: range-partition on the order (plus group) and sort.
A running sum is then carried through each partition's Arrow batches, so it needs no
further shuffle; the checkpoint fixes partition contents, and the partitions' totals
and their prefix offsets (#partitions + #groups rows) complete the sum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .ntile import in_order, join_counted, settled


def _running(batches):
    """Adds the partition's number and, for each weight ``_w0, _w1, ...``, its sum before each row."""
    pid, carry = TaskContext.get().partitionId(), {}
    for b in batches:
        names = [c for c in b.schema.names if c.startswith("_w") and c[2:].isdigit()]
        sums = []
        for c in names:
            w = b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(w) + carry.get(c, 0)
            sums.append(pa.array(upto - w))
            carry[c] = int(upto[-1]) if len(upto) else carry.get(c, 0)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(b.num_rows, pid, np.int64)), *sums],
            [*b.schema.names, "_pid", *[f"_in{c[2:]}" for c in names]])


def prefix_sums(df: DataFrame, order: Sequence[Column], weights: dict[str, str],
                group: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """For each output name of ``weights`` the sum of its integer column over the rows
    strictly before each row in ``order`` within ``group`` (``order`` must be a total
    order): one range order for all of them."""
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\0null")).alias(f"_g{i}") for i, g in enumerate(group)]
    by = [f"_g{i}" for i in range(len(group))]
    n = range(len(weights))
    src = df.select("*", *keys, *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"_w{i}")
                                  for i, c in enumerate(weights.values())])
    schema = StructType([*src.schema.fields, StructField("_pid", LongType()), *[StructField(f"_in{i}", LongType()) for i in n]])
    pos = settled(in_order(src, [F.col(g).asc() for g in group] + list(order), num_partitions)
                  .mapInArrow(_running, schema))
    totals = pos.groupBy("_pid", *by).agg(*[F.sum(f"_w{i}").alias(f"_tot{i}") for i in n],
                                          *[F.min(f"_in{i}").alias(f"_first{i}") for i in n])
    w_prefix = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *by, *[
        (F.coalesce(F.sum(f"_tot{i}").over(w_prefix), F.lit(0)) - F.col(f"_first{i}")).alias(f"_off{i}") for i in n])
    joined = join_counted(pos, offsets, ["_pid", *by])
    return joined.select(*df.columns, *[(F.col(f"_off{i}") + F.col(f"_in{i}")).alias(out) for i, out in enumerate(weights)])


def prefix_sum(df: DataFrame, order: Sequence[Column], weight: str, out: str,
               group: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """``prefix_sums`` of one column."""
    return prefix_sums(df, order, {out: weight}, group, num_partitions)


def average_ranks(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Per distinct value (within group): ``cnt`` and the average 1-based rank of
    its ties, ``avg_rank = (#smaller values) + (cnt + 1) / 2``.  Ranks are built
    on the distinct-value counts, so a value held by many rows is one row."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("cnt"))
    before = prefix_sum(counts, [F.col(value).asc()], "cnt", "_before", group)
    return before.select(*group, value, "cnt",
                         (F.col("_before") + (F.col("cnt") + 1) / 2.0).alias("avg_rank"))


def exact_median(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Exact median per group (mean of the two middle values for even counts)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("cnt"))
    before = prefix_sum(counts, [F.col(value).asc()], "cnt", "_before", group)
    if group:
        totals = counts.groupBy(*group).agg(F.sum("cnt").alias("_n"))
        b = join_counted(before, totals, list(group))
    else:
        b = before.select("*", counts.agg(F.sum("cnt")).scalar().alias("_n"))
    k1 = F.floor((F.col("_n") + 1) / 2)
    k2 = F.floor(F.col("_n") / 2) + 1
    covers = lambda k: (F.col("_before") < k) & (k <= F.col("_before") + F.col("cnt"))
    picked = b.select(*group, F.when(covers(k1), F.col(value)).alias("_v1"),
                      F.when(covers(k2), F.col(value)).alias("_v2"))
    agg = picked.groupBy(*group).agg(F.max("_v1").alias("_v1"), F.max("_v2").alias("_v2"))
    return agg.select(*group, ((F.col("_v1") + F.col("_v2")) / 2.0).alias("median"))
