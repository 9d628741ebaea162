"""How far the sources of a language differ in their terms (operator 13).

*Kept terms* are found by iceberg prefix refinement.  Level by level (8, 16, 32, ... bytes)
a scan of the texts counts, for each language, the documents of every byte prefix whose
parent prefix was kept; prefixes in too few documents are discarded, and with them all
their terms.  A term no longer than the level's bytes is complete: its documents are
counted exactly and its occurrences by source come with it, so each term is counted at
one level.  The kept prefixes of a level reach the next scan as a bit filter of fixed size
(``prefilter``): a prefix that passes it by chance is discarded a level later.

Rows that share a doc_id are one document (the null id is one as well).  Ids that several
rows have are found first; their documents are counted by id, all others as they come.

*Divergence*: every group (language, source) and every language gives a kept term
p = 1 + floor(10^9 (count + 1) / (N + V)).  The ``term`` part compares a group with its language.  The
``pair`` part sums floor((p - q)^2 / q) over all kept terms for two sources: terms are dealt
to tasks by hash, and a task adds up whole tiles of terms x sources, so the shuffle carries
one partial sum for each pair and task.

Cases: null text, lang and source are ''; an empty table gives no rows; a language without
kept terms gives pairs of value 0; a group without terms takes part in the pairs.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from . import prefilter
from .common import doc_key, documents, each_text, join_small, partitions, settle, small_batches

#: Bytes of the first level; each further level has twice as many.
FIRST_LEVEL = 8
#: Different terms that a scan task holds before it sends their counts.
HELD = 500_000
#: Words whose numbers it holds before it adds them up.
WORDS = 1_000_000
#: Cells (terms x sources) of a tile, and sources on one side of a tile.
TILE, SIDE = 1_000_000, 256
#: Counts of (term, source) in a task's bucket of terms: more where a bucket gives more sums of pairs, up to TILE.
BUCKET = 100_000
SCALE = 1_000_000_000

#: A-Z lower-cased; bytes of other ASCII characters become spaces.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _slot(lang: str, prefix: bytes) -> int:
    return xxhash.xxh3_64_intdigest(prefix, xxhash.xxh3_64_intdigest(lang.encode())) & ((1 << prefilter.BITS) - 1)


class _Keys(dict):
    """Term -> the number of its key, which ``number`` gives to a new term."""

    def __init__(self, number):
        self.number = number

    def __missing__(self, term: bytes) -> int:
        self[term] = at = self.number(term)
        return at


class _Held:
    """What a scan task has counted of one level: occurrences and documents of
    (group, key, repeated id), summed up as numbers of the task's own."""

    def __init__(self, length: int, parent: int, bits: np.ndarray | None):
        self.length, self.parent, self.bits = length, parent, bits
        self.find = re.compile(rb"[^ ]{%d,}" % (parent + 1)).findall if parent else bytes.split
        self.key_of: dict[str, _Keys] = {}      # by language; discarded terms have the key 0
        self.number: dict[tuple[str, bytes, bool], int] = {}
        self.keys: list[tuple[str, bytes, bool]] = [("", b"", False)]
        self.groups: dict[tuple[str, str, int | None], int] = {}
        self.texts: list[tuple[int, np.ndarray]] = []
        self.cells: list[np.ndarray] = []
        self.words = self.size = 0

    def _key(self, lang: str, term: bytes) -> int:
        """The number of the term's key at this level."""
        if self.parent:
            if len(term) <= self.parent:
                return 0
            slot = _slot(lang, term[:self.parent])
            if not self.bits[slot >> 3] >> (slot & 7) & 1:
                return 0
        key = (lang, term[:self.length], len(term) > self.length)
        at = self.number.setdefault(key, len(self.keys))
        if at == len(self.keys):
            self.keys.append(key)
        return at

    def add(self, lang: str, source: str, doc: int | None, text: bytes) -> None:
        """``doc``: the id if other rows may have it too."""
        known = self.key_of.get(lang)
        if known is None:
            known = self.key_of[lang] = _Keys(functools.partial(self._key, lang))
        words = self.find(text.translate(_TO_TERMS))
        group = self.groups.setdefault((lang, source, doc), len(self.groups))
        self.texts.append((group, np.fromiter(map(known.__getitem__, words), np.int64, len(words))))
        self.words += len(words)
        if self.words > WORDS:
            self.add_up()

    def add_up(self) -> None:
        """Texts to cells: group and key, occurrences, documents."""
        if not self.texts:
            return
        group = np.array([g for g, _ in self.texts])
        text = np.repeat(np.arange(len(group)), [len(k) for _, k in self.texts])
        key = np.concatenate([k for _, k in self.texts])
        pair, n = np.unique((text[key > 0] << 32) | key[key > 0], return_counts=True)
        self.cells.append(np.stack([(group[pair >> 32] << 32) | (pair & 0xFFFFFFFF), n, np.ones(len(pair), np.int64)]))
        self.size += len(pair)
        self.texts, self.words = [], 0
        if self.size > 4 * WORDS:
            self.cells = [self.summed()]
            self.size = self.cells[0].shape[1]

    def summed(self) -> np.ndarray:
        cells, counts, documents_ = np.concatenate([np.zeros((3, 0), np.int64), *self.cells], axis=1)
        order = np.argsort(cells, kind="stable")
        cells, first = cells[order], np.flatnonzero(np.r_[True, np.diff(cells[order]) != 0][:len(order)])
        return np.stack([cells[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in (counts, documents_))])

    def full(self) -> bool:
        return len(self.keys) + len(self.groups) > HELD or sum(map(len, self.key_of.values())) > 2 * HELD or self.size > 4 * WORDS

    def rows(self) -> pa.RecordBatch:
        """The partial counts, and nothing held after."""
        self.add_up()
        cells, n, d = self.summed()
        group, key = cells >> 32, cells & 0xFFFFFFFF
        groups = pa.array([g[1] for g in self.groups], pa.string()), pa.array([g[2] for g in self.groups], pa.int64())
        lang, name, open_ = (pa.array([k[i] for k in self.keys], t)
                             for i, t in enumerate((pa.string(), pa.binary(), pa.bool_())))
        is_open = np.array([k[2] for k in self.keys])[key]
        ids = groups[1].take(group)
        out = pa.RecordBatch.from_arrays(
            [lang.take(key), groups[0].take(group), name.take(key), open_.take(key), pa.array(np.where(is_open, 0, n)),
             pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), d, 0)), ids],
            ["lang", "source", "key", "open", "n", "documents", "id"])
        self.__init__(self.length, self.parent, self.bits)
        return out


class _Numbers(dict):
    """Value -> its number, from 1."""

    def __missing__(self, value: int) -> int:
        self[value] = at = len(self) + 1
        return at


class _HeldFirst(_Held):
    """The first level, whose keys have at most 8 bytes: words are cut and keyed as arrays of
    integers, and only the different keys of a few MB of text are numbered one by one."""

    def __init__(self, length: int, parent: int, bits: np.ndarray | None):
        super().__init__(length, parent, bits)
        self.complete, self.longer = _Numbers(), _Numbers()     # by the key's bytes as an integer, zeros after them

    def add(self, lang: str, source: str, doc: int | None, text: bytes) -> None:
        self.texts.append((self.groups.setdefault((lang, source, doc), len(self.groups)), text.translate(_TO_TERMS)))
        self.words += len(text)
        if self.words > 4 * WORDS:
            self.add_up()

    def add_up(self) -> None:
        if not self.texts:
            return
        group = np.array([g for g, _ in self.texts])
        begin = np.cumsum([1] + [len(t) + 1 for _, t in self.texts])
        raw = b" " + b" ".join([t for _, t in self.texts]) + b" " * 8
        self.texts, self.words = [], 0
        word = np.frombuffer(raw, np.uint8) != 32
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        start, size = edge[::2], edge[1::2] - edge[::2]
        eight = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))[start].astype(np.uint64)
        cut = (64 - 8 * np.minimum(size, self.length)).astype(np.uint64)
        value, key = eight >> cut << cut, np.empty(len(start), np.int64)
        for numbers, sign, at in ((self.complete, 1, size <= self.length), (self.longer, -1, size > self.length)):
            different, where = np.unique(value[at], return_inverse=True)
            key[at] = sign * np.fromiter(map(numbers.__getitem__, different.tolist()), np.int64, len(different))[where]
        text = np.searchsorted(begin, start, "right") - 1
        pair, n = np.unique((text << 32) | (key + (1 << 31)), return_counts=True)
        self.cells.append(np.stack([(group[pair >> 32] << 32) | (pair & 0xFFFFFFFF), n, np.ones(len(pair), np.int64)]))
        self.size += len(pair)
        if self.size > 4 * WORDS:
            self.cells = [self.summed()]
            self.size = self.cells[0].shape[1]

    def full(self) -> bool:
        return len(self.complete) + len(self.longer) + len(self.groups) > HELD or self.size > 4 * WORDS

    def rows(self) -> pa.RecordBatch:
        self.add_up()
        cells, n, d = self.summed()
        group, key = cells >> 32, (cells & 0xFFFFFFFF) - (1 << 31)
        langs, sources, ids = (pa.array([g[i] for g in self.groups], t).take(group)
                               for i, t in enumerate((pa.string(), pa.string(), pa.int64())))
        # the complete keys by number, then the longer ones
        values = np.array([*self.complete, *self.longer], ">u8").view("S8").tolist()
        name = pa.array(values, pa.binary()).take(np.where(key > 0, key, len(self.complete) - key) - 1)
        out = pa.RecordBatch.from_arrays(
            [langs, sources, name, pa.array(key < 0), pa.array(np.where(key < 0, 0, n)),
             pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), d, 0)), ids],
            ["lang", "source", "key", "open", "n", "documents", "id"])
        self.__init__(self.length, self.parent, self.bits)
        return out


def _level(rows: DataFrame, length: int, parent: int, kept, repeated, threshold: int) -> DataFrame:
    """(lang, source, key, open, n, total, first) of the keys in ``threshold`` documents or
    more; ``total`` is the language's n, and ``first`` marks one row of each key.

    The terms with more than ``parent`` bytes whose first ``parent`` bytes pass the
    filter ``kept`` are counted.  A term of at most ``length`` bytes is a key of its own; of a longer one its
    first ``length`` bytes are (``open``).  Documents whose id other rows may have, by the
    filter ``repeated``, are counted by id."""
    def run(batches: Iterable[pa.RecordBatch]):
        held = (_Held if parent or length > 8 else _HeldFirst)(length, parent, None if kept is None else kept.value)
        again = None if repeated is None else repeated.value
        for b in batches:
            docs_ = b.column("doc")
            own = [None] * b.num_rows
            if again is not None:
                at = b.column("slot").to_numpy()
                own = [d if r else None for d, r in zip(docs_.to_pylist(), prefilter.has(again, at).tolist())]
            for doc, lang, source, text in zip(own, b.column("lang").to_pylist(), b.column("source").to_pylist(),
                                               each_text(b.column("text"))):
                held.add(lang, source, doc, text)
                if held.full():
                    yield held.rows()
        yield held.rows()
    schema = "lang string, source string, key binary, open boolean, n long, documents long, id long"
    # one shuffle: by language and key, which is enough for all that follows
    t = rows.mapInArrow(run, schema).repartition(partitions(rows.sparkSession), "lang", "key")
    if repeated is not None:
        first = F.row_number().over(Window.partitionBy("lang", "key", "open", "id").orderBy("source")) == 1
        t = t.withColumn("documents", F.when(F.col("id").isNull(), F.col("documents")).otherwise(first.cast("long")))
    t = t.groupBy("lang", "key", "open", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    key = Window.partitionBy("lang", "key", "open")             # a row for each source
    t = t.select("*", F.sum("documents").over(key).alias("everywhere"), F.sum("n").over(key).alias("total"),
                 (F.row_number().over(key.orderBy("source")) == 1).alias("first"))
    return t.where(F.col("everywhere") >= threshold).select("lang", "source", "key", "open", "n", "total", "first")


def _id_slot() -> Column:
    return F.pmod(F.xxhash64("doc"), F.lit(1 << prefilter.BITS))


def _prefix_slots(level: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            slots = [_slot(lang, key) for lang, key in zip(b.column("lang").to_pylist(), b.column("key").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64())], ["slot"])
    return level.where("open").select("lang", "key").mapInArrow(run, "slot long")


def kept_terms(docs: DataFrame, threshold: int = 3) -> DataFrame:
    """(lang, source, term, n, total, first): occurrences, by source and in all, of the
    terms that at least ``threshold`` documents of a language hold, for each source where a
    term occurs; ``first`` marks one row of each term."""
    spark = docs.sparkSession
    rows = small_batches(docs).select(doc_key().alias("doc"), "text", F.coalesce("lang", F.lit("")).alias("lang"),
                                      F.coalesce("source", F.lit("")).alias("source")).withColumn("slot", _id_slot())
    repeated = prefilter.bitmap(rows.groupBy("doc", "slot").count().where("count > 1").select("slot"))
    repeated = spark.sparkContext.broadcast(repeated) if repeated.any() else None       # 2 ** BITS bits
    found, length, parent, kept = [], FIRST_LEVEL, 0, None
    while True:
        level = settle(_level(rows, length, parent, kept, repeated, threshold))
        found.append(level.where("NOT open").select("lang", "source", F.col("key").cast("string").alias("term"),
                                                       "n", "total", "first"))
        bits = prefilter.bitmap(_prefix_slots(level))
        if not bits.any():
            break
        kept = spark.sparkContext.broadcast(bits)
        parent, length = length, 2 * length
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_WIDE = DecimalType(38, 0)


def _div(a: Column, b: Column) -> Column:
    """The whole part of a / b for non-negative numbers, as a long."""
    return F.call_function("div", a, b)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (total + terms)), exact for counts of 19 digits: in longs
    where the product fits one."""
    small = _div(F.lit(SCALE) * (count + 1), total + terms)
    large = _div(F.lit(SCALE).cast(_WIDE) * (count + 1).cast(DecimalType(20, 0)), (total + terms).cast(_WIDE))
    return F.lit(1) + F.when(count < 9 * 10 ** 9, small).otherwise(large)


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most 10^9 + 1, so the square fits a long."""
    return _div((p - q) * (p - q), q)


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each (lang, source) of ``docs``: N and first share (of count 0) of the
    group, N and V of its language, its number within the language and the language's sources."""
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sizes = settle(kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count_if("first").alias("firsts"),
                                                      F.count(F.lit(1)).alias("cells")))
    langs = sizes.groupBy("lang").agg(F.sum("firsts").alias("terms"), F.sum("words").alias("lang_words"),
                                      F.sum("cells").alias("lang_cells"))
    g = named.join(sizes.drop("firsts", "cells"), ["lang", "source"], "left").join(langs, "lang", "left") \
        .na.fill(0, ["words", "terms", "lang_words", "lang_cells"])
    by_name = Window.partitionBy("lang").orderBy("source")             # a row for each source
    return settle(g.withColumn("number", F.row_number().over(by_name) - 1)
                  .withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang")))
                  .withColumn("least", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("words"), F.col("terms")))))


def _cells(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, term, number, sources, buckets, p, q): the shares of a group and of its
    language, for every term that the group has."""
    size = F.greatest(F.lit(BUCKET), F.least(F.lit(TILE), F.col("sources") * F.col("sources")))
    small = groups.withColumn("buckets", F.ceil(F.col("lang_cells") / size)) \
        .withColumn("of", F.struct("lang", "source")).drop("lang", "source")
    t = join_small(kept.withColumn("of", F.struct("lang", "source")), small, "of", F.xxhash64("term"))
    return t.select("lang", "source", "term", "number", "sources", "buckets",
                    _share(F.col("n"), F.col("words"), F.col("terms")).alias("p"),
                    _share(F.col("total"), F.col("lang_words"), F.col("terms")).alias("q"))


def term_divergence(cells: DataFrame, most: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms in which a group exceeds its language."""
    p, q = F.col("p"), F.col("q")
    t = cells.where(p > q).select("lang", "source", F.col("term").alias("item"), _distance(p, q).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return t.withColumn("rank", rank).where(F.col("rank") <= most)


def _tiles(key: tuple, sides: pa.Table, cells: pa.Table) -> pa.Table:
    """Sums over the terms of one bucket, for the sources of one side against all."""
    lang, _, side = (k.as_py() for k in key)
    least = np.zeros(sides.num_rows, np.int64)
    least[sides.column("number").to_numpy()] = sides.column("least").fill_null(0).to_numpy()
    sources = len(least)
    rows = range(SIDE * side, min(sources, SIDE * (side + 1)))
    sums = np.zeros((len(rows), sources), np.int64)
    if cells.num_rows:
        code = cells.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(code, kind="stable")
        code, number, p = code[order], cells.column("number").to_numpy()[order], cells.column("p").to_numpy()[order]
        step = max(1, TILE // sources)
        for first in range(0, int(code[-1]) + 1, step):
            s, e = np.searchsorted(code, [first, first + step])
            tile = np.tile(least, (int(code[e - 1]) - first + 1, 1))
            tile[code[s:e] - first, number[s:e]] = p[s:e]
            for k, a in enumerate(rows):
                d = tile[:, a:a + 1] - tile
                sums[k] += (d * d // tile).sum(axis=0)
    a, b = np.repeat(np.arange(rows.start, rows.stop), sources), np.tile(np.arange(sources), len(rows))
    other = a != b
    return pa.table({"lang": pa.array([lang] * int(other.sum()), pa.string()), "a": a[other].astype(np.int64),
                     "b": b[other].astype(np.int64), "value": sums.ravel()[other]})


def pair_divergence(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language."""
    sides = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / SIDE)))
    size = F.greatest(F.lit(BUCKET), F.least(F.lit(TILE), F.col("sources") * F.col("sources")))
    buckets = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("lang_cells") / size), F.lit(1)) - 1))
    left = groups.select("lang", "number", "least", "sources", buckets.alias("bucket")) \
        .select("lang", "bucket", sides.alias("side"), "number", "least").toDF("of", "deal", "row", "number", "least")
    right = cells.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets"))) \
        .select("lang", "bucket", sides.alias("side"), "term", "number", "p")
    sums = left.groupBy("of", "deal", "row").cogroup(right.groupBy("lang", "bucket", "side")).applyInArrow(_tiles, "lang string, a long, b long, value long") \
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select(F.col("lang").alias("l"), F.col("number").cast("long").alias("n"), "source")
    out = sums.join(names, (F.col("lang") == F.col("l")) & (F.col("a") == F.col("n"))).drop("l", "n") \
        .join(names.withColumnRenamed("source", "item"), (F.col("lang") == F.col("l")) & (F.col("b") == F.col("n")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return out.select("lang", "source", "item", "value").withColumn("rank", rank)


def source_audit(docs: DataFrame, threshold: int = 3, most: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    kept = kept_terms(docs, threshold)
    groups = _groups(docs, kept)
    cells = settle(_cells(kept, groups))
    parts = [pair_divergence(cells, groups).withColumn("part", F.lit("pair")),
             term_divergence(cells, most).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_source_audit(spark, sf_dir: str) -> DataFrame:
    return source_audit(documents(spark, sf_dir))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
           FROM (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents)),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term
         HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS nl FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
cnt AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, source, term),
dense AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0)::HUGEINT AS n,
            sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS words, l.v, l.nl
          FROM grp g JOIN kept k USING (lang) JOIN langs l USING (lang)
          LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (words + v) AS p,
        1 + (1000000000::HUGEINT * (total + 1)) // (nl + v) AS q FROM dense),
pair AS (SELECT a.lang, a.source, b.source AS item,
           (SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
            WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
         FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
out AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pair
        UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM out)
WHERE part = 'pair' OR rank <= 200
"""
