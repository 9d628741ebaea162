"""Benchmark decontamination (operator 8).

For every benchmark item of n words, windows of n words slide over the texts.  A window
is a multiset of ``SHINGLE``-word shingles, its SimHash of 128 bits the majority bit over
their hashes.  The items' fingerprints of one size are cut into four 32-bit blocks, each with a
sorted table of its values: a window within ``radius`` bits of an item agrees with it up to a
quarter of the radius in at least one block (pigeonhole), so a search of each table finds every
item within the radius.  At the default radius of 39 a table passes 1 % of random values, the
four of them 4 %; the whole fingerprint lets about one in 100,000 of all pairs through.  What
it finds is verified by the exact weighted-shingle similarity (the sum of the smaller
counts over the sum of the larger), ``threshold`` or more.

A window that shares no shingle with any item has similarity 0 and gets no fingerprint;
that is the only windows left out.  A window of similarity 0.8 (20 bits apart on average) lies
4.6 standard deviations inside the radius.  Windows meet tables a tile at a time, as lists of
index pairs, so memory does not grow with the product of text and items.

The items are a query set: they go to the tasks in blocks of about ``ITEM_BYTES`` of text,
each one broadcast, however many there are.

Words are lower-cased (A-Z) and lose ASCII punctuation at both ends; words of nothing else
do not count.  Cases: a null or empty text, or an item without words, matches nothing; an
item of fewer words than a shingle is one shingle of the whole sequence; a text shorter
than the item is one window; repeated rows match alike; a null item_id stays null.
"""

from __future__ import annotations

import functools
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import documents, each_text, small_batches

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 39
ITEM_BYTES = 2 << 20
#: Bits of a fingerprint, and blocks that it is cut into.
BITS, BLOCKS = 128, 4
#: Windows whose fingerprints are held at once, and pairs of a tile.
RUN, TILE = 8192, 1 << 20
#: Words whose hashes a task remembers.
CACHE = 200_000

_PUNCTUATION = string.punctuation.encode()
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 20) - 1)
_HITS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class _Words(dict):
    """word -> 64-bit hash of the word without punctuation at its ends; 0 for none."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        bare = word.strip(_PUNCTUATION)
        h = self[word] = (xxh64_intdigest(bare) or 1) if bare else 0
        return h


_WORDS = _Words()


def word_hashes(raw: bytes) -> np.ndarray:
    words = raw.lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` words."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ words[k:k + n]) * _ODD
        h ^= h >> np.uint64(29)
    return h


def _bits(h: np.ndarray) -> np.ndarray:
    """Rows of BITS values +1 or -1: the hash, and the hash mixed once more."""
    more = (h ^ h >> np.uint64(32)) * _ODD
    more = (more ^ more >> np.uint64(29)) * _ODD
    both = np.stack([h, more ^ more >> np.uint64(32)], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def window_fingerprints(h: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The SimHash of the ``length`` shingles from each start, as rows of BLOCKS words."""
    sums = np.zeros((len(h) + 1, BITS), np.int32)
    np.cumsum(_bits(h), axis=0, dtype=np.int32, out=sums[1:])
    return np.packbits(sums[starts + length] > sums[starts], axis=1).view(np.uint32)


class HammingBlocks:
    """Finds all fingerprints within ``radius`` bits by sorted tables of their blocks."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        #: Bits that may differ within each block: one more in every block is over the radius.
        self.within = [(radius + BLOCKS - b) // BLOCKS - 1 for b in range(BLOCKS)]
        self.tables = [self._table(prints[:, b]) for b in range(BLOCKS)]

    @staticmethod
    def _table(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted values, where each one's members begin (and the end), the members."""
        members = np.argsort(block, kind="stable")
        values, begin = np.unique(block[members], return_index=True)
        return values, np.r_[begin, len(block)], members

    def candidates(self, windows: np.ndarray):
        """(block, windows, items): index pairs that agree in a block, by tiles."""
        for b, (values, begin, members) in enumerate(self.tables):
            if self.within[b] < 0:
                continue
            mine, first = np.unique(windows[:, b], return_inverse=True)
            order = np.argsort(first, kind="stable")
            start = np.searchsorted(first[order], np.arange(len(mine) + 1))
            wide = min(len(values), 4096)
            high = max(1, TILE // wide)
            for y in range(0, len(mine), high):
                for x in range(0, len(values), wide):
                    apart = np.bitwise_count(mine[y:y + high, None] ^ values[None, x:x + wide])
                    r, c = np.nonzero(apart <= self.within[b])
                    for w, i in _expand(r + y, c + x, start, order, begin, members):
                        yield b, w, i

    def find(self, windows: np.ndarray):
        """(window, item) index pairs within the radius, by tiles, each pair once: from the
        first block in which it agrees."""
        for b, w, i in self.candidates(windows):
            apart = np.bitwise_count(windows[w] ^ self.prints[i])
            close = apart.sum(axis=1) <= self.radius
            close &= ~(apart[:, :b] <= self.within[:b]).any(axis=1)
            if close.any():
                yield w[close], i[close]


def _expand(r, c, start, order, begin, members):
    """The pairs of rows behind pairs of values, about TILE at a time."""
    times = (start[r + 1] - start[r]) * (begin[c + 1] - begin[c])
    part = (np.cumsum(times) - 1) // TILE
    for s, e in _runs(part):
        if e == s + 1 and times[s] > TILE:      # one value of very many windows or items
            for w in order[start[r[s]]:start[r[s] + 1]]:
                held = members[begin[c[s]]:begin[c[s] + 1]]
                for x in range(0, len(held), TILE):
                    yield np.full(len(held[x:x + TILE]), w), held[x:x + TILE]
            continue
        n = times[s:e]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        items = np.repeat(begin[c[s:e] + 1] - begin[c[s:e]], n)
        yield (order[np.repeat(start[r[s:e]], n) + at // items], members[np.repeat(begin[c[s:e]], n) + at % items])


def _runs(a: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    if not len(a):
        return []
    cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)]))


class Items:
    """One block of benchmark items, ready to be looked for; kept as arrays, a few times
    the size of the block's text."""

    def __init__(self, rows: list[tuple[int | None, bytes]], threshold: float, radius: int):
        self.threshold, self.radius = threshold, radius
        self.ids: list[int | None] = []
        self.hashes: list[np.ndarray] = []
        by_size: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item_id, raw in rows:
            words = word_hashes(raw)
            words = words[words > 0]
            if not len(words):
                continue
            size = min(SHINGLE, len(words))
            by_size[size, len(words)].append(len(self.ids))
            self.ids.append(item_id)
            self.hashes.append(shingle_hashes(words, size))
        self.members = dict(by_size)
        self.index = {key: HammingBlocks(np.concatenate([
            window_fingerprints(self.hashes[k], np.array([0]), len(self.hashes[k])) for k in ks]), radius)
            for key, ks in self.members.items()}
        #: shingle size -> (sorted shingle hashes, the window size of an item that holds each, a bit table)
        self.holders = {}
        for size in {s for s, _ in self.members}:
            h, n = (np.concatenate(x) for x in zip(*(
                (self.hashes[k], np.full(len(self.hashes[k]), words)) for (s, words), ks in self.members.items()
                if s == size for k in ks)))
            order = np.lexsort((n, h))
            h, n = h[order], n[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (n[1:] != n[:-1])]
            maybe = np.zeros(1 << 20, bool)
            maybe[h & _LOW] = True
            self.holders[size] = h[new], n[new], maybe

    def search(self, raw: bytes) -> list[dict]:
        """The best window for each item found in the text."""
        all_words = word_hashes(raw)
        words = all_words[all_words > 0]
        best: dict[int, tuple[float, int, int]] = {}
        for size, (held, sizes, maybe) in self.holders.items():
            h = shingle_hashes(words, size)
            at = np.flatnonzero(maybe[h & _LOW])
            first, last = np.searchsorted(held, h[at], "left"), np.searchsorted(held, h[at], "right")
            times = last - first
            place = np.repeat(at, times)
            n = sizes[np.repeat(first, times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)]
            for k in np.unique(n).tolist():
                self._windows(h, size, k, place[n == k], best)
        if not best:
            return []
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        spans = [s for s, w in zip(spans, all_words.tolist()) if w]
        return [{"item_id": self.ids[k], "similarity": s,
                 "start": len(raw[:spans[a][0]].decode()), "end": len(raw[:spans[b - 1][1]].decode())}
                for k, (s, a, b) in sorted(best.items())]

    def _windows(self, h, size, n, places, best):
        length = min(n - size + 1, len(h))                  # shingles of a window
        last = len(h) - length
        near = np.zeros(last + 2, np.int64)
        np.add.at(near, np.clip(places - length + 1, 0, last), 1)
        np.add.at(near, np.clip(places, 0, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        for x, y in _runs(starts // RUN):
            self._run(h, size, n, length, starts[x:y], best)

    def _run(self, h, size, n, length, starts, best):
        low = int(starts[0])
        part = h[low:int(starts[-1]) + length]
        members = self.members[size, n]
        for w, i in self.index[size, n].find(window_fingerprints(part, starts - low, length)):
            order = np.lexsort((w, i))
            w, i = w[order], i[order]
            for x, y in _runs(i):
                item = members[int(i[x])]
                mine = self.hashes[item]
                inside = np.r_[0, np.cumsum(np.isin(part, mine))]
                at = starts[w[x:y]]
                most = inside[at - low + length] - inside[at - low]
                maybe = at[most >= self.threshold * (length + len(mine) - most)]
                count = Counter(mine.tolist()) if len(maybe) else None
                for s in maybe.tolist():
                    both = sum((Counter(h[s:s + length].tolist()) & count).values())
                    found = both / (length + len(mine) - both)
                    old = best.get(item)
                    if found >= self.threshold and (old is None or (found, -s) > (old[0], -old[1])):
                        best[item] = found, s, s + length + size - 1


def item_blocks(benchmark: DataFrame) -> list[int]:
    """The numbers of the blocks of about ITEM_BYTES that the items are dealt to."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return list(range(-(-size // ITEM_BYTES)))


def contamination(benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD,
                  radius: int = RADIUS) -> Column:
    """array<struct<item_id, similarity, start, end>>: the items found in a text, each
    with its best window (code points of the text)."""
    sc = small_batches(benchmark).sparkSession.sparkContext
    blocks = item_blocks(benchmark)
    out = F.array().cast(_HITS)
    block = F.pmod(F.xxhash64("text"), F.lit(max(1, len(blocks))))
    for b in blocks:
        rows = [(r["item_id"], r["text"].encode()) for r in
                benchmark.where(F.col("text").isNotNull() & (block == b)).select("item_id", "text").collect()]
        out = F.concat(out, _searcher(sc.broadcast((rows, threshold, radius)))(text))
    return out


@functools.lru_cache(maxsize=16)
def _loaded(shared) -> Items:
    return Items(*shared.value)


def _searcher(shared):
    @F.arrow_udf(_HITS)
    def search(text: pa.Array) -> pa.Array:
        items = _loaded(shared)
        return pa.array([items.search(x) for x in each_text(text)], pa.list_(pa.struct(
            [("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])))
    return search


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    return docs.where(F.size(contamination(benchmark, **options)) == 0)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row for each item found in a document."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    d = documents(spark, sf_dir).select("doc_id", contamination(benchmark).alias("hits"))
    return d.where(F.size("hits") > 0).select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
