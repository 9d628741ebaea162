"""Verdicts on text units (lines, passages) that depend on all documents.

Four steps, used by line and by substring deduplication:

* ``summarise``: every scan task cuts its texts into units and sends, for each
  *block* of documents and each *shard* of the digests, packed records of the units'
  digests.  What repeats inside a block is summed up first.  The records are written once.
* ``heavy``: the digests that hold more records than a shard should.  Every chunk of a
  million records names its frequent digests (at least one in ``shards`` of the chunk), the
  counts are added up, and those with one in ``shards`` of all records are heavy: at most one
  for each shard, and any other digest has fewer than 2 / ``shards`` of the records and two a
  chunk.
* ``judge``: a heavy digest's records are summed up chunk by chunk, whatever their blocks, so
  a shard gets a few a chunk; the verdicts are one record for each heavy digest.  Of the
  other digests one task call a shard sees all records and answers each block that asked.
* ``apply``: texts and answers meet by block, the verdicts on heavy digests are broadcast
  (at most one for each shard).  A task streams its blocks: first a block's answers, then its
  texts one Arrow batch at a time.

A block is ``2 ** BLOCK_BITS`` consecutive ids: rows that share an id share a block.  Ids far
apart make blocks of one document, where nothing is summed up; heavy digests do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, each_text, partitions, scratch_path, small_batches

#: Bits of an id that count within its block.
BLOCK_BITS = 12
#: Records that a task holds before it sums them up or counts them.
HELD = 1_000_000
#: Shards for each shuffle partition.
SHARDS = 4
#: Bytes of a row group of written records, which a reader holds at once.
ROW_GROUP = 8 << 20


def _block():
    return F.shiftright(doc_key(), BLOCK_BITS)


def _shards(spark) -> int:
    return SHARDS * partitions(spark)


def _pack(shard: np.ndarray, block: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """One row for each run of equal (shard, block)."""
    at = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (block[1:] != block[:-1])][:len(shard)])
    end = np.r_[at[1:], len(shard)][:len(at)]
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[at].astype(np.int32)), pa.array(block[at].astype(np.int64)),
         pa.array((end - at).astype(np.int32)),
         pa.array([records[x:y].tobytes() for x, y in zip(at, end)], pa.binary())],
        ["shard", "block", "n", "payload"])


_PACKED = "shard int, block long, n int, payload binary"


def summarise(docs: DataFrame, units: Callable[[int, bytes], np.ndarray | None],
              shrink: Callable[[np.ndarray], np.ndarray], dtype: np.dtype) -> DataFrame:
    """(shard, block, n, payload), written to the shared folder.  ``units(doc, text)`` gives
    records of ``dtype`` with the fields hi, lo (a digest) and doc; ``shrink`` sums up the
    records of one block, sorted by digest and then document."""
    spark = docs.sparkSession
    shards = _shards(spark)

    def send(held: list[np.ndarray]):
        r = np.concatenate(held)
        block = r["doc"] >> BLOCK_BITS
        order = np.lexsort((r["doc"], r["lo"], r["hi"], block))
        r, block = r[order], block[order]
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for s, e in zip(cuts, np.r_[cuts[1:], len(r)]):
            part = shrink(r[s:e])
            shard = (part["hi"] % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            yield _pack(shard[by], np.full(len(part), block[s], np.int64), part[by])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for doc, text in zip(b.column("doc").to_pylist(), each_text(b.column("text"))):
                r = units(doc, text)
                if r is not None and len(r):
                    held.append(r)
                    size += len(r)
            if size >= HELD:
                yield from send(held)
                held, size = [], 0
        if size:
            yield from send(held)

    path = scratch_path(spark, "records")
    small_batches(docs).select(doc_key().alias("doc"), "text").mapInArrow(run, _PACKED) \
        .write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(_PACKED).parquet(path)


def _records(batch: pa.RecordBatch, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("payload").to_pylist()), dtype)


def _chunks(batches: Iterable[pa.RecordBatch], dtype: np.dtype,
            keep: Callable[[np.ndarray], np.ndarray] = lambda r: r) -> Iterator[np.ndarray]:
    """What ``keep`` leaves of the records, about HELD at a time."""
    held, size = [], 0
    for b in batches:
        held.append(keep(_records(b, dtype)))
        size += len(held[-1])
        if size >= HELD:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _among(hi: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """True where ``hi`` is in the sorted, not empty ``hot``."""
    return hot[np.minimum(np.searchsorted(hot, hi), len(hot) - 1)] == hi


def heavy(summary: DataFrame, dtype: np.dtype) -> np.ndarray:
    """The first halves of the heavy digests, sorted; at most one for each shard."""
    shards = _shards(summary.sparkSession)

    def frequent(batches):
        for r in _chunks(batches, dtype):
            hi = np.sort(r["hi"])
            at = np.flatnonzero(np.r_[True, hi[1:] != hi[:-1]])
            size = np.diff(np.r_[at, len(hi)])
            often = size >= max(2, len(hi) / shards)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hi[at[often]].view(np.int64)), pa.array(size[often].astype(np.int64))], ["hi", "n"])

    total = summary.agg(F.sum("n")).first()[0] or 0
    rows = small_batches(summary).select("payload").mapInArrow(frequent, "hi long, n long") \
        .groupBy("hi").agg(F.sum("n").alias("n")).where(F.col("n") >= total / shards).select("hi").collect()
    return np.sort(np.array([r["hi"] for r in rows], np.int64).view(np.uint64))


def _without(summary: DataFrame, hot: np.ndarray, dtype: np.dtype) -> DataFrame:
    def run(batches):
        for b in batches:
            r = _records(b, dtype)
            stay = ~_among(r["hi"], hot)
            if stay.all():
                yield b
                continue
            row = np.repeat(np.arange(len(b)), b.column("n").to_numpy())[stay]
            yield _pack(b.column("shard").to_numpy()[row], b.column("block").to_numpy()[row], r[stay])
    return summary.mapInArrow(run, _PACKED)


def _of_heavy(summary: DataFrame, hot: np.ndarray, shrink, dtype: np.dtype) -> DataFrame:
    """The records of the heavy digests, summed up chunk by chunk, all in block 0."""
    shards = _shards(summary.sparkSession)

    def run(batches):
        for r in _chunks(batches, dtype, lambda r: r[_among(r["hi"], hot)]):
            r = shrink(r[np.lexsort((r["doc"], r["lo"], r["hi"]))])
            shard = (r["hi"] % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            yield _pack(shard[by], np.zeros(len(r), np.int64), r[by])
    return summary.mapInArrow(run, _PACKED)


class Answers(NamedTuple):
    """``by_block``: (block, payload) rows; ``everywhere``: payload on the heavy digests."""
    by_block: DataFrame
    everywhere: bytes


def judge(summary: DataFrame, shrink: Callable[[np.ndarray], np.ndarray],
          verdicts: Callable[[np.ndarray, np.ndarray], Iterable[tuple[int, bytes]]], dtype: np.dtype) -> Answers:
    """Answers from ``verdicts(records, blocks)``, called once a shard for the heavy digests
    and once for the others; ``shrink`` also sums up what it has summed up before."""
    def run(table: pa.Table) -> pa.Table:
        payload = table.column("payload").to_pylist()
        records = np.frombuffer(b"".join(payload), dtype)
        blocks = np.repeat(table.column("block").to_numpy(), table.column("n").to_numpy())
        out = list(verdicts(records, blocks))
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()),
                         "payload": pa.array([p for _, p in out], pa.binary())})

    def judged(df: DataFrame) -> DataFrame:
        return df.groupBy("shard").applyInArrow(run, "block long, payload binary")

    hot, found = heavy(summary, dtype), b""
    if len(hot):
        found = b"".join(bytes(r["payload"]) for r in judged(_of_heavy(summary, hot, shrink, dtype)).collect())
        summary = _without(summary, hot, dtype)
    return Answers(judged(summary), found)


def by_block(blocks: np.ndarray, records: np.ndarray) -> Iterable[tuple[int, bytes]]:
    """Records packed for each block."""
    order = np.argsort(blocks, kind="stable")
    blocks, records = blocks[order], records[order]
    cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else []
    for s, e in zip(cuts, np.r_[cuts[1:], len(blocks)] if len(blocks) else []):
        yield int(blocks[s]), records[s:e].tobytes()


class Known:
    """The answers of one block over those that hold everywhere."""

    def __init__(self, everywhere: dict):
        self.everywhere, self.block = everywhere, {}

    def __bool__(self) -> bool:
        return bool(self.everywhere or self.block)

    def get(self, digest: bytes, default=None):
        found = self.block.get(digest)
        return self.everywhere.get(digest, default) if found is None else found


def apply(docs: DataFrame, answers: Answers, rewrite: Callable[[int, bytes, Known], tuple],
          load: Callable[[bytes], dict], fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """One row for every row of ``docs``: doc (the id's key) and ``fields`` from
    ``rewrite(doc, text, answers)``; ``load`` reads a payload into a dict."""
    everywhere = docs.sparkSession.sparkContext.broadcast(answers.everywhere)

    def run(batches):
        block, known = None, Known(load(everywhere.value))
        for b in batches:
            out: list[list] = [[] for _ in range(len(fields) + 1)]
            for at, doc, text, payload in zip(b.column("block").to_pylist(), b.column("doc").to_pylist(),
                                              each_text(b.column("text")), b.column("payload").to_pylist()):
                if at != block:
                    block, known.block = at, {}
                if payload is not None:
                    known.block.update(load(payload))
                    continue
                for column, value in zip(out, (doc, *rewrite(doc, text, known))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), *(pa.array(c, kind) for c, (_, kind) in zip(out[1:], fields))],
                ["doc", *(name for name, _ in fields)])

    n = partitions(docs.sparkSession)
    texts = docs.select(_block().alias("block"), F.lit(1).alias("kind"), doc_key().alias("doc"), "text",
                        F.lit(None).cast("binary").alias("payload"))
    first = answers.by_block.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("doc"),
                           F.lit(None).cast("string").alias("text"), "payload")
    return first.unionByName(texts).repartition(n, "block").sortWithinPartitions("block", "kind") \
        .mapInArrow(run, f"doc long, {schema}")
