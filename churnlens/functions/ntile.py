"""Exact NTILE / row number over a whole (or per-group) order without a
single-partition window.

``ntile(n) OVER (ORDER BY k)`` with no PARTITION BY plans an
``Exchange SinglePartition``: one task sorts every row.  Here the order is
computed the way a distributed sort does it:

1. Only the sort columns (group, key, tie) go through ``repartitionByRange`` and
   are sorted inside partitions, so range partition *i* holds a contiguous slice of
   the global order.  A hot key value is still split, because the tie column (user
   id) is part of the range.
2. ``checkpoint()`` to the reliable checkpoint folder.  Range boundaries come
   from sampling and could differ on a recomputation after an executor loss;
   the checkpoint fixes partition contents, so positions stay consistent.
3. Position inside a partition from ``monotonically_increasing_id`` (partition
   index in the upper 31 bits, row index in the lower 33), row counts per
   (partition, group) and their prefix sums.
4. ``row_number = offset + position``; NTILE follows from the row number and
   the group size with the same rule as SQL NTILE: the first ``N mod n`` tiles
   get one extra row.

The same path runs at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOW33 = (1 << 33) - 1
#: Rows (partitions + groups) up to which a table of offsets is broadcast.
OFFSETS_TO_BROADCAST = 200_000


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(small: DataFrame) -> DataFrame:
    """``small`` written and counted: to be broadcast where its rows are few, else joined by a shuffle."""
    small = settled(small)
    few = small.limit(OFFSETS_TO_BROADCAST + 1).count() <= OFFSETS_TO_BROADCAST
    return F.broadcast(small) if few else small


def join_counted(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with ``small``, which is broadcast once its rows were counted and
    are few, and joined by a shuffle otherwise."""
    return df.join(counted(small), on=on, how=how)


def ntile_from_rank(rn: Column, total: Column, n: int) -> Column:
    """SQL NTILE(n) of the 1-based row number ``rn`` among ``total`` rows."""
    q = F.floor(total / n).cast("long")
    r = (total - q * n).cast("long")
    big = r * (q + 1)  # rows held by the first r (larger) tiles
    first = F.floor((rn - 1) / (q + 1)) + 1
    rest = r + F.floor((rn - 1 - big) / F.nullif(q, F.lit(0))) + 1
    return F.when(rn <= big, first).otherwise(rest).cast("int")


def in_order(df: DataFrame, keys: Sequence[Column], num_partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys`` (not yet checkpointed)."""
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def global_row_number(df: DataFrame, order: Sequence[Column], out: str = "rn",
                      group: Sequence[str] = (), total_col: str | None = None,
                      num_partitions: int | None = None) -> DataFrame:
    """Add the exact 1-based row number of each row in ``order`` (within ``group``).

    ``order`` must be a total order (end it with a unique column).  Optionally
    adds the group size as ``total_col``.  All columns of ``df`` are sorted, so
    pass only what the order needs.
    """
    ranged = settled(in_order(df, [F.col(g).asc() for g in group] + list(order), num_partitions))
    mid = F.monotonically_increasing_id()
    pos = ranged.select("*", mid.alias("_mid")).select(
        "*", F.shiftright("_mid", 33).alias("_pid"),
        F.col("_mid").bitwiseAND(F.lit(_LOW33)).alias("_pos"))
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\0null")).alias(f"_g{i}") for i, g in enumerate(group)]
    pos = pos.select("*", *keys)
    by = [f"_g{i}" for i in range(len(group))]
    counts = pos.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_pos").alias("_first"))
    w_prefix = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*by)
    offsets = counts.select(
        "_pid", *by, "_first",
        F.coalesce(F.sum("_cnt").over(w_prefix), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(w_all).alias("_total"))
    joined = join_counted(pos, offsets, ["_pid", *by])
    out_cols = [(F.col("_off") + F.col("_pos") - F.col("_first") + 1).cast("long").alias(out)]
    if total_col:
        out_cols.append(F.col("_total").cast("long").alias(total_col))
    return joined.select(*df.columns, *out_cols)


def ntile(df: DataFrame, n: int, order: Sequence[Column], out: str,
          group: Sequence[str] = (), tie: str = "user_id",
          num_partitions: int | None = None) -> DataFrame:
    """``NTILE(n) OVER (PARTITION BY group ORDER BY order, tie)`` computed distributed.

    ``tie`` makes the order total, so the result does not depend on the
    physical row order (plain SQL NTILE over tied keys does).
    """
    ordered = global_row_number(df, list(order) + [F.col(tie).asc()], out="_rn",
                                group=group, total_col="_n", num_partitions=num_partitions)
    return ordered.select(*df.columns, ntile_from_rank(F.col("_rn"), F.col("_n"), n).alias(out))


def ntiles(df: DataFrame, n: int, specs: Sequence[tuple[str, bool, str]], group: Sequence[str] = (),
           tie: str = "user_id") -> DataFrame:
    """Several NTILEs over the same rows, one per (order column, descending, output
    name); ``tie`` is unique within a group.

    Integers, dates and decimals go by ``selection``, which counts and compares and
    sorts no rows.  For other types the input is checkpointed once, each order sorts only
    (group, column, tie), and the tiles come together in one aggregation and are joined back once.
    """
    from .selection import can_select, select_ntiles

    if can_select(df, [tie, *(c for c, _, _ in specs)]):
        return select_ntiles(df, n, specs, group, tie)
    base = settled(df)
    narrow = None
    for column, descending, name in specs:
        order = F.col(column).desc() if descending else F.col(column).asc()
        tiles = ntile(base.select(*group, tie, column), n, [order], name, group, tie).select(*group, tie, name)
        narrow = tiles if narrow is None else narrow.unionByName(tiles, allowMissingColumns=True)
    names = [name for _, _, name in specs]
    tiles = narrow.groupBy(*[F.col(k).alias(f"_{k}") for k in (*group, tie)]).agg(
        *[F.max(x).alias(x) for x in names])
    same = [base[k].eqNullSafe(tiles[f"_{k}"]) for k in (*group, tie)]
    return base.join(tiles, same).select(*[base[c] for c in base.columns], *[tiles[x] for x in names])
