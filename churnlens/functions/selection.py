"""Exact NTILE by selection: the few rows where tiles begin are found by counting, and
every row's tile follows from a comparison with them.

``ntile(n)`` over N rows has at most n - 1 places where a tile begins, at ranks that N alone
decides.  Each such rank is found by refining a histogram: the range of keys that holds
it is cut into ``BINS`` equal bins, the rows of each bin are counted, and the range shrinks to the
bin with the rank.  Where a range is a single key (a key that many rows share) the
refinement goes on over the tie column.  It stops where a range has at most ``FEW`` rows; those
rows are ranked.

No row is sorted or moved for its tile: a level shuffles at most ``BINS`` counts for each task,
group and column, what is ranked at the end is bounded by ``FEW`` rows for each place, and the
places (one row for each group) are broadcast once their number was checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegralType

from .ntile import join_counted, settled

#: Bins that a range is cut into, and rows of a range that are ranked instead.
BINS, FEW = 4096, 20_000
#: Stands for a null key: before all others where the order ascends (as in SQL), after them
#: where it descends.
_NULL = -(1 << 62)


def as_long(df: DataFrame, column: str, descending: bool) -> Column:
    """``column`` as a long in the same order (integers, dates and decimals; others fail)."""
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, DateType):
        value = F.unix_date(value).cast("long")
    elif isinstance(kind, DecimalType):
        value = (value * F.lit(10 ** kind.scale).cast(DecimalType(kind.scale + 1, 0))).cast(DecimalType(38, 0)).cast("long")
    elif isinstance(kind, IntegralType):
        value = value.cast("long")
    else:
        raise TypeError(f"{column}: no exact order as integers for {kind.simpleString()}")
    if descending:
        value = -value
    return F.coalesce(value, F.lit(-_NULL if descending else _NULL))


def can_select(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether the columns have an exact order as integers."""
    return all(isinstance(df.schema[c].dataType, (DateType, DecimalType, IntegralType)) for c in columns)


def _places(sizes: DataFrame, n: int) -> DataFrame:
    """A row for each tile but the first: ``tile`` and ``rank``, where it begins."""
    q, r = F.floor(F.col("_rows") / n), F.col("_rows") % n
    tile = F.explode(F.sequence(F.lit(2), F.lit(n)))
    return sizes.withColumn("_tile", tile) \
        .withColumn("_rank", ((F.col("_tile") - 1) * q + F.least(F.col("_tile") - 1, r) + 1).cast("long")) \
        .where(F.col("_rank") <= F.col("_rows"))


_RANGE = ["_k1", "_k2", "_u1", "_u2"]


def _refined(long: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """``places`` whose ranges hold more than FEW rows, with the bin of the range that holds
    the rank, and the rank within it."""
    ranges = places.select(*keys, *_RANGE).distinct()
    by_key = F.col("_k1") < F.col("_k2")
    x, lo, hi = (F.when(by_key, F.col(a)).otherwise(F.col(b)) for a, b in (("_k", "_u"), ("_k1", "_u1"), ("_k2", "_u2")))
    step = F.floor((hi - lo) / BINS).cast("long") + 1
    inside = join_counted(long, ranges, keys).where(
        F.when(by_key, F.col("_k").between(F.col("_k1"), F.col("_k2")))
        .otherwise((F.col("_k") == F.col("_k1")) & F.col("_u").between(F.col("_u1"), F.col("_u2"))))
    bins = inside.groupBy(*keys, *_RANGE, F.call_function("div", x - lo, step).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys, *_RANGE).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)     # BINS rows
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    found = places.drop("_rows").join(bins, [*keys, *_RANGE]).where(
        (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_n")))
    low = lo + F.col("_bin") * step
    high = F.least(hi, low + step - 1)
    return found.select(
        *keys, "_tile", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_n").alias("_rows"),
        F.when(by_key, low).otherwise(F.col("_k1")).alias("_k1"), F.when(by_key, high).otherwise(F.col("_k2")).alias("_k2"),
        F.when(by_key, F.col("_u1")).otherwise(low).alias("_u1"), F.when(by_key, F.col("_u2")).otherwise(high).alias("_u2"))


def tile_starts(long: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _tile, _k, _u): the row at each place's rank."""
    done = None
    while True:
        few = places.where(F.col("_rows") <= FEW)
        done = few if done is None else done.unionByName(few, allowMissingColumns=True)
        places = places.where(F.col("_rows") > FEW)
        if not places.take(1):
            break
        places = settled(_refined(long, places, keys))
    # places with the same range share its ranked rows
    ranges = done.groupBy(*keys, *_RANGE).agg(F.collect_list(F.struct("_rank", "_tile")).alias("_wanted"))
    x = join_counted(long, ranges, keys).where(
        F.col("_k").between(F.col("_k1"), F.col("_k2")) & ((F.col("_k1") < F.col("_k2")) | F.col("_u").between(F.col("_u1"), F.col("_u2"))))
    rank = F.row_number().over(Window.partitionBy(*keys, *_RANGE).orderBy("_k", "_u"))      # at most FEW rows
    x = x.withColumn("_at", rank).where(F.exists("_wanted", lambda w: w["_rank"] == F.col("_at")))
    return x.select(*keys, "_k", "_u", F.explode(F.filter("_wanted", lambda w: w["_rank"] == F.col("_at"))).alias("_w")) \
        .select(*keys, F.col("_w._tile").alias("_tile"), "_k", "_u")


def select_ntiles(df: DataFrame, n: int, specs: Sequence[tuple[str, bool, str]], group: Sequence[str],
                  tie: str) -> DataFrame:
    """``df`` with NTILE(n) for each (order column, descending, output name); ``tie`` makes the
    order total and is unique within a group."""
    base = settled(df)
    # a null group value is a group of its own; without groups all rows are one
    here = [F.coalesce(F.col(g).cast("string"), F.lit("\0null")) for g in group] or [F.lit("")]
    names = [f"_g{i}" for i in range(len(here))]
    wide = base.select("*", *[c.alias(x) for c, x in zip(here, names)], as_long(base, tie, False).alias("_u"),
                       *[as_long(base, c, d).alias(f"_k_{i}") for i, (c, d, _) in enumerate(specs)])
    kinds = ", ".join(f"{i}, _k_{i}" for i in range(len(specs)))
    long = wide.selectExpr(*names, "_u", f"stack({len(specs)}, {kinds}) AS (_of, _k)")
    keys = [*names, "_of"]
    bounds = wide.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows"), F.min("_u").alias("_u1"), F.max("_u").alias("_u2"),
                                      *[f(f"_k_{i}").alias(f"_{a}_{i}") for i in range(len(specs)) for a, f in (("lo", F.min), ("hi", F.max))])
    kinds = ", ".join(f"{i}, _lo_{i}, _hi_{i}" for i in range(len(specs)))
    sizes = bounds.selectExpr(*names, "_rows", "_u1", "_u2", f"stack({len(specs)}, {kinds}) AS (_of, _k1, _k2)")
    starts = tile_starts(long, settled(_places(sizes, n)), keys)
    # one row for each group: the key and the tie where each tile begins
    cells = [(i, t) for i in range(len(specs)) for t in range(2, n + 1)]
    table = starts.groupBy(*names).agg(*[
        F.max(F.when((F.col("_of") == i) & (F.col("_tile") == t), F.struct("_k", "_u"))).alias(f"_s_{i}_{t}") for i, t in cells])
    joined = join_counted(wide, table, names, "left")

    def tile(i: int) -> Column:
        k, u = F.col(f"_k_{i}"), F.col("_u")
        reached = [F.col(f"_s_{i}_{t}") for t in range(2, n + 1)]
        return sum((F.coalesce((k > s["_k"]) | ((k == s["_k"]) & (u >= s["_u"])), F.lit(False)).cast("int") for s in reached), F.lit(1))
    return joined.select(*df.columns, *[tile(i).alias(name) for i, (_, _, name) in enumerate(specs)])
