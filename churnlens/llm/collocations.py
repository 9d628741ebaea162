"""Phrase collocations (operator 12).

Counts are exact and held in counting quotient filters (``quotient_filter``):

* ``_tokens``: scan tasks cut texts into pieces and words and write, for each *segment* of about two million
  words, the words as numbers of the segment's own, and the segment's words with their counts.
* ``_lexicon``: word counts are added up by language; words found ``least`` times or more are
  numbered.  A phrase that holds any other word is too rare to be a candidate.
* ``_numbering``: each segment gets the numbers of its own words by a join, so no
  dictionary is sent to every task.
* ``_filters``: a segment packs its phrases of two and three numbered words, permutes them,
  and sends a filter to each shard.  A phrase that every document holds is one entry for each segment.
* ``_phrases``: a shard merges its filters as they come and gives back the phrases found
  ``least`` times or more.

The parts of a candidate are at least as frequent as itself, so every count that a score
needs is in the lexicon or among the candidates.  Scores are decimals of 38 digits: exact for
counts of up to 13 digits.

Cases: a null or empty text has no words; a null lang is ``und`` (and one with the lang
``und``); rows that share a doc_id all count; an empty table gives no rows; a lang without
candidates gives none.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from . import quotient_filter as qf
from .common import documents, each_text, partitions, scratch_path, settle, small_batches

#: Words after which a segment ends, and different words.
SEGMENT_WORDS, SEGMENT_LEXICON = 2_000_000, 600_000
#: Phrase entries that a shard is meant to hold (before equal ones are added up).
SHARD_ENTRIES = 2_000_000

#: A-Z lower-cased; tabs become spaces, the ends of pieces line feeds.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b
               for b in range(256))


def _tokens(docs: DataFrame, path: str) -> None:
    """Writes (segment, lang, word, local, n) for the words of each segment and
    (segment, tokens) for its texts: local numbers, 0 between pieces."""
    schema = pa.schema([("segment", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("local", pa.int32()),
                        ("n", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]):
        segment = TaskContext.get().partitionId() << 32
        known: dict[str, dict[bytes, int]] = {}
        stream: list[np.ndarray] = []
        size = words = 0

        def send():
            tokens = np.concatenate(stream)
            counts = np.bincount(tokens, minlength=words + 1)
            rows = [(lang, word, k) for lang, own in known.items() for word, k in own.items() if k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), segment)), pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[2] for r in rows], pa.int32()),
                 pa.array(counts[[r[2] for r in rows]] if rows else [], pa.int64()), pa.nulls(len(rows), pa.binary())], schema=schema)
            yield pa.RecordBatch.from_pylist([{"segment": segment, "tokens": tokens.tobytes()}], schema)
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), each_text(b.column("text"))):
                own = known.setdefault(lang, {b"\n": 0})
                found = [w for w in text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ") if w]
                for w in set(found).difference(own):
                    words += 1
                    own[w] = words
                stream.append(np.fromiter(map(own.__getitem__, found), np.int32, len(found)))
                stream.append(np.zeros(1, np.int32))
                size += len(found)
                if size >= SEGMENT_WORDS or words >= SEGMENT_LEXICON:
                    yield from send()
                    segment, known, stream, size, words = segment + 1, {}, [], 0, 0
        if stream:
            yield from send()
    small_batches(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text") \
        .mapInArrow(run, "segment long, lang string, word string, local int, n long, tokens binary") \
        .write.option("compression", "zstd").parquet(path)


def _numbered(words: DataFrame) -> DataFrame:
    """``words``, written once, with ``id``: 1, 2, ... without gaps."""
    held = settle(words).withColumn("_at", F.monotonically_increasing_id())
    held = held.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)         # a row for each partition
    offsets = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return held.join(offsets, "_part").withColumn("id", F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_at", "_before")


def _numbering(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(segment, local, id) of the words that the lexicon numbers."""
    known = lexicon.select(F.col("lang").alias("_lang"), F.col("word").alias("_word"), "id")
    return words.join(known, (F.col("lang") == F.col("_lang")) & (F.col("word") == F.col("_word"))) \
        .select("segment", "local", "id")


def _filters(streams: DataFrame, numbering: DataFrame, bits: int, shard_bits: int) -> DataFrame:
    """(shard, filter): the phrases of two and three numbered words of each segment."""
    def run(texts: pa.Table, numbers: pa.Table) -> pa.Table:
        shards, filters = [], []
        for raw in texts.column("tokens").to_pylist():
            tokens = np.frombuffer(raw, np.int32)
            number = np.zeros(int(tokens.max()) + 1, np.int64)
            number[numbers.column("local").to_numpy()] = numbers.column("id").to_numpy()
            ids = number[tokens]
            two = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            three = two[:-1][two[1:] == two[:-1] + 1]
            found = []
            for at, width in ((two, 2), (three, 3)):
                grams = np.zeros((len(at), 3), np.int64)
                for k in range(width):
                    grams[:, k] = ids[at + k]
                found.append(qf.summed(*qf.permute(*qf.pack(grams, bits), bits), np.ones(len(at), np.int64)))
            left, right, counts = qf.summed(*map(np.concatenate, zip(*found)))
            if not len(left):
                continue
            shard = (left >> np.uint64(qf.half_bits(bits) - shard_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            for s, e in zip(cuts, np.r_[cuts[1:], len(shard)]):
                shards.append(int(shard[s]))
                filters.append(qf.encode(left[s:e], right[s:e], counts[s:e], bits, shard_bits))
        return pa.table({"shard": pa.array(shards, pa.int64()), "filter": pa.array(filters, pa.binary())})
    return streams.toDF("of", "tokens").groupBy("of").cogroup(numbering.groupBy("segment")).applyInArrow(run, "shard long, filter binary")


def _phrases(filters: DataFrame, bits: int, shard_bits: int, least: int) -> DataFrame:
    """(w1, w2, w3, a): phrases found ``least`` times or more; w3 is 0 for two words."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("w3", pa.int64()), ("a", pa.int64())])

    def kept(merger: qf.Merger):
        left, right, counts = merger.settle()
        frequent = counts >= least
        words = qf.unpack(*qf.restore(left[frequent], right[frequent], bits), bits)
        return pa.RecordBatch.from_arrays([*(pa.array(words[:, k]) for k in range(3)), pa.array(counts[frequent])], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]):
        merger, at = None, None
        for b in batches:
            for shard, raw in zip(b.column("shard").to_pylist(), b.column("filter")):
                if shard != at:
                    if merger:
                        yield kept(merger)
                    merger, at = qf.Merger(bits, shard_bits, shard), shard
                merger.add(raw.as_py())
        if merger:
            yield kept(merger)
    return filters.repartition(partitions(filters.sparkSession), "shard").sortWithinPartitions("shard") \
        .mapInArrow(run, "w1 long, w2 long, w3 long, a long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right))"""
    wide = DecimalType(13, 0)
    a, left, right = (c.cast(wide) for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast(DecimalType(7, 0)) * a * a, left * right)


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, covered: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's best phrases of two and three
    words found ``least`` times or more, without those that occur in a longer candidate
    in ``covered`` of 100 places or more."""
    spark = docs.sparkSession
    path = scratch_path(spark, "segments")
    _tokens(docs, path)
    parts = spark.read.parquet(path)
    words, streams = parts.where("tokens IS NULL").drop("tokens"), parts.where("tokens IS NOT NULL").select("segment", "tokens")
    counts = settle(words.groupBy("lang", "word").agg(F.sum("n").alias("f")))
    sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    lexicon = settle(_numbered(counts.where(F.col("f") >= least)))
    shape = lexicon.agg(F.coalesce(F.max("id"), F.lit(0)).alias("ids"), F.coalesce(F.sum("f"), F.lit(0)).alias("words")).first()
    bits = max(2, int(shape["ids"]).bit_length())
    if bits > 42:
        raise ValueError("a phrase of three words does not fit 126 bits")
    # each numbered word begins at most two phrases
    shard_bits = min(max(2 * int(shape["words"]) // SHARD_ENTRIES, 2 * partitions(spark)).bit_length(), qf.half_bits(bits) - 1)
    filters = _filters(streams, _numbering(words, lexicon), bits, shard_bits)
    phrases = settle(_phrases(filters, bits, shard_bits, least))

    def word(k: int) -> DataFrame:
        return lexicon.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"), F.col("lang").alias(f"lang{k}"))
    two, three = phrases.where("w3 = 0").drop("w3"), phrases.where("w3 > 0")
    longer = three.groupBy("w1", "w2").agg(F.max("a").alias("m")).unionByName(
        three.groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("m"))) \
        .groupBy("w1", "w2").agg(F.max("m").alias("m"))
    a = F.col("a")
    best2 = two.join(longer, ["w1", "w2"], "left").where(F.col("m").isNull() | (F.col("m") * 100 < a * covered)) \
        .join(word(1), "w1").join(word(2), "w2") \
        .select(F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2").alias("phrase"), "a",
                F.col("f1").alias("l"), F.col("f2").alias("r"), _score(a, F.col("f1"), F.col("f2")).alias("score"))
    first = two.select("w1", "w2", F.col("a").alias("f12"))
    last = two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    cut1, cut2 = _score(a, F.col("f1"), F.col("f23")), _score(a, F.col("f12"), F.col("f3"))
    best3 = three.join(first, ["w1", "w2"]).join(last, ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3") \
        .withColumn("s1", cut1).withColumn("s2", cut2) \
        .select(F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
                F.when(F.col("s1") <= F.col("s2"), F.col("f1")).otherwise(F.col("f12")).alias("l"),
                F.when(F.col("s1") <= F.col("s2"), F.col("f23")).otherwise(F.col("f3")).alias("r"),
                F.least("s1", "s2").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = best2.unionByName(best3).withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)
    return top.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
g AS (SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i])) AS g, 1 AS k FROM ws
      UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM ws
      UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM ws),
f AS (SELECT lang, g, k, count(*)::HUGEINT AS f FROM g GROUP BY lang, g, k),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cuts AS (SELECT c.lang, c.g, c.k, c.f AS a, cut,
           array_to_string(string_split(c.g, ' ')[:cut], ' ') AS x, array_to_string(string_split(c.g, ' ')[cut + 1:], ' ') AS y
         FROM f c, (VALUES (1), (2)) v(cut) WHERE c.f >= 10 AND c.k > cut),
s AS (SELECT cuts.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f * r.f) AS score
      FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = x JOIN f r ON r.lang = cuts.lang AND r.g = y),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
longer AS (SELECT lang, part, max(a) AS m FROM (
    SELECT lang, a, array_to_string(string_split(g, ' ')[:2], ' ') AS part FROM best WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(string_split(g, ' ')[2:], ' ') FROM best WHERE k = 3) GROUP BY lang, part),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.part = best.g
         WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score
FROM (SELECT kept.lang, kept.g AS phrase, a, l, r, n.n, score,
        row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, kept.g) AS rank FROM kept JOIN n ON n.lang = kept.lang)
WHERE rank <= 2000
"""
