"""SimHash near-duplicate groups by tiled exact comparison (operator 2).

1. Each text gets a 64-bit fingerprint: the majority bit over its word shingles'
   XXH64 values.  Equal fingerprints are one node.
2. Nodes lie in *cells* by the population counts of their four 16-bit words.  Two
   fingerprints within ``radius`` bits have counts that differ by at most
   ``radius`` in all, so only cells that close can hold a link; every other pair of
   cells is skipped.  A cell of over ``SPLIT`` nodes is split by a hash, so a hot
   cell becomes many groups and a task holds one group and the tile it meets.
3. A group is compared in full, tile by tile, with exclusive-or and bit counts.
   Only a spanning forest of the links found leaves the task, so a large group of
   near copies never emits all its pairs.
4. The forests are joined to components by alternating large-star and small-star
   steps on Spark; every step is checkpointed to the shared folder.

The driver sees one number for each cell (17**4 at most), no fingerprint.

Cases: a null or empty text has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle of the whole sequence; repeated rows
share a component; a null doc_id stays null and names no component (null where a
component has no other id); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import NO_ID, doc_key, documents, each_text, partitions, settle, small_batches

#: Nodes of a cell above which it is split.
SPLIT = 8192
#: Rows and columns of one numpy comparison.
TILE = (512, 4096)
CELLS = 17 ** 4
_WEIGHT = np.array([17 ** 3, 17 ** 2, 17, 1])
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) < size:
        return [b" ".join(words)] if words else []
    text = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words)))
    starts = [0, *ends]
    return [text[starts[i] + i:ends[i + size - 1] + i + size - 1] for i in range(len(words) - size + 1)]


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit values."""
    if not len(hashes):
        return 0
    columns = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(raw: bytes, size: int = 3, seed: int = 42) -> int:
    grams = shingles(raw.lower().split(), size)
    return majority_bits(np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64, len(grams)))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, h, fp) for every row; h is the text's hash."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, size) for x in each_text(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array(fp.view(np.int64))], ["doc_id", "h", "fp"])
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text") \
        .mapInArrow(run, "doc_id long, h long, fp long")


def _cell() -> Column:
    """The number of a fingerprint's cell."""
    words = [F.bit_count(F.shiftrightunsigned("fp", 48 - 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    return sum((w * int(_WEIGHT[k]) for k, w in enumerate(words)), F.lit(0)).cast("int")


def near_cells(cell: int, radius: int) -> np.ndarray:
    """The numbers of all cells whose counts differ by at most ``radius`` in all and
    that come after the cell."""
    there = cell // _WEIGHT % 17 + _shifts(radius)
    return there[((there >= 0) & (there <= 16)).all(axis=1)] @ _WEIGHT


@functools.cache
def _shifts(radius: int) -> np.ndarray:
    span = range(-radius, radius + 1)
    return np.array([s for s in itertools.product(span, repeat=4)
                     if sum(map(abs, s)) <= radius and s > (0, 0, 0, 0)]).reshape(-1, 4)


def compare(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with a[i] and b[j] at most ``radius`` bits apart."""
    i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s in range(0, len(a), TILE[0]):
        for t in range(0, len(b), TILE[1]):
            x, y = np.nonzero(np.bitwise_count(a[s:s + TILE[0], None] ^ b[None, t:t + TILE[1]]) <= radius)
            i.append(x + s)
            j.append(y + t)
    return np.concatenate(i), np.concatenate(j)


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its local group) that join what (u, v) join."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    move = label != np.arange(len(nodes))
    return nodes[move], nodes[label[move]]


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): a spanning set of the links between distinct fingerprints."""
    spark = nodes.sparkSession
    n = partitions(spark)
    cells = nodes.select("fp", _cell().alias("cell"))
    held = np.zeros(CELLS, np.int64)
    for r in cells.groupBy("cell").count().collect():      # at most CELLS rows
        held[r["cell"]] = r["count"]
    splits = spark.sparkContext.broadcast(-(-held // SPLIT))

    def part(batches):
        for b in batches:
            cell, fp = (b.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "fp"))
            mixed = fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            p = (mixed % splits.value[cell].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("cell"), pa.array(p), b.column("fp")], ["cell", "part", "fp"])

    def deal(batches):
        """Each group once as host (kind 0) and once for each group that it meets."""
        for (cell, p), blobs in _runs(batches, ("cell", "part"), "fp"):
            blob = np.concatenate(blobs).tobytes()
            to = [(cell, p, 0)] + [(cell, q, 1) for q in range(p + 1, splits.value[cell])]
            to += [(int(c), q, 1) for c in near_cells(cell, radius) for q in range(splits.value[c])]
            for k in range(0, len(to), 256):
                at = to[k:k + 256]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x[i] for x in at], pa.int32()) for i in range(3)), pa.array([blob] * len(at))],
                    ["cell", "part", "kind", "blob"])

    def meet(batches):
        mine, guests, waiting = np.empty(0, np.uint64), [], 0

        def found():
            nonlocal guests, waiting
            other = np.concatenate(guests)
            guests, waiting = [], 0
            i, j = compare(mine, other, radius)
            u, v = spanning_forest(mine[i].view(np.int64), other[j].view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["a", "b"])

        for b in batches:
            for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist()):
                if kind == 0:
                    if guests:
                        yield found()
                    mine = np.frombuffer(blob, np.uint64)
                    if len(mine) > 1:
                        guests = [mine]
                        yield found()
                    continue
                guests.append(np.frombuffer(blob, np.uint64))
                waiting += len(guests[-1])
                if waiting >= TILE[1]:
                    yield found()
        if guests:
            yield found()

    grouped = cells.mapInArrow(part, "cell int, part int, fp long") \
        .repartition(n, "cell", "part").sortWithinPartitions("cell", "part")
    return grouped.mapInArrow(deal, "cell int, part int, kind int, blob binary") \
        .repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "kind") \
        .mapInArrow(meet, "a long, b long")


def _runs(batches, keys: tuple[str, str], value: str):
    """((key, key), [arrays]) for each run of equal keys in sorted batches."""
    now, arrays = None, []
    for b in batches:
        if not b.num_rows:
            continue
        k0, k1, v = (b.column(k).to_numpy(zero_copy_only=False) for k in (*keys, value))
        cuts = np.flatnonzero(np.r_[True, (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])])
        for s, e in zip(cuts, np.r_[cuts[1:], b.num_rows]):
            key = int(k0[s]), int(k1[s])
            if key != now:
                if arrays:
                    yield now, arrays
                now, arrays = key, []
            arrays.append(v[s:e].copy())
    if arrays:
        yield now, arrays


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link, by large-star and small-star steps.
    Each step is one shuffle of the links and is checkpointed; the loop ends when a
    step changes nothing."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = settle(both.where("a > b").distinct())

    def star(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(low, "u")

    while True:
        sym = e.select(F.col("a").alias("u"), F.col("b").alias("v")) \
            .union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(sym).withColumn("m", F.least("u", "m")).where("v > u") \
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.select(F.col("a").alias("u"), F.col("b").alias("v")).join(low, "u")
        nxt = settle(small.where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                     .union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        # the links form stars when every node has one link and no root is a node
        if nxt.groupBy("a").count().where("count > 1").isEmpty() and \
                nxt.join(nxt.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            return nxt.select(F.col("a").alias("node"), F.col("b").alias("root"))
        e = nxt


def _grouped(docs: DataFrame, size: int, radius: int) -> DataFrame:
    """(doc_id, h, fp, root, component_id) for every row."""
    rows = settle(fingerprints(docs, size))
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes, radius))
    ids = nodes.join(roots, nodes["fp"] == roots["node"], "left") \
        .select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    low = ids.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(ids.join(low, "root").drop("first_id"), "fp")


def simhash_groups(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    return _grouped(docs, size, radius).select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """One row of ``docs`` for each group: the smallest doc_id (null last), then the
    smallest fingerprint, then any one of equal texts."""
    first = _grouped(docs, size, radius).groupBy("root") \
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "h")).alias("x")) \
        .select(F.coalesce("x.doc_id", F.lit(NO_ID)).alias("id"), F.col("x.h").alias("h"))
    keyed = docs.select(F.struct("*").alias("row"), doc_key().alias("id"), F.xxhash64("text").alias("h"))
    again = Window.partitionBy("id", "h").orderBy(F.lit(0))
    return keyed.join(first, ["id", "h"], "left_semi").withColumn("n", F.row_number().over(again)) \
        .where("n = 1").select("row.*")


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    g = simhash_groups(documents(spark, sf_dir))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
