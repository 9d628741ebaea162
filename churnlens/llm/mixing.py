"""Mixing sources to target weights (operator 5).

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
``budget`` times all words; a target stops at ``max_repeat`` times its source's size
and what is left over is shared again by weight.  The end state needs one number, the
words for each unit of weight, found over the sources sorted by size for each weight.

Quotas: a source has its words, ``max_repeat`` times over, in blocks of ``block`` words; the
last block may be shorter, and a source of a few words is one short block.  Sainte-Lague
gives blocks to sources by their highest quotients (target in blocks of the source's
mean size) / (2k - 1), never more than a source has: what it cannot hold is given again to the others.
The same rule gives a source's blocks to its shards.  Only the quotients near the
divisor are listed (at most twice as many as there are parties), for the rest rounding
already decides.

Blocks: a shard lays its documents out in a seeded order, ``max_repeat`` times over,
and cuts that into blocks.  A seeded affine permutation numbers the blocks of each
pass over the shard, and the shard's quota takes the lowest numbers, pass by pass.  No
block is listed: a document works out which of its words fall into taken blocks.

A source is cut into shards of about ``shard_words`` words by a hash of the id, so a
source that holds a third of all rows is spread over as many tasks as its size needs.

Cases: a null text has size 0 and gives nothing; a null source is a source of its own,
the last; rows that share a doc_id are taken each for itself, in the order of their
sizes; a null doc_id comes first in its shard; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE, doc_key, documents, each_text, join_small, settle, small_batches

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
_P = 2147483647


def _hash(key: Column, seed: int) -> Column:
    """A seeded 31-bit hash in plain integer arithmetic (SQL gives the same)."""
    x = F.pmod(key, F.lit(_P))
    for k in (48271, 69621, 39373):
        x = F.pmod(x * F.lit(k) + F.lit(seed % _P), F.lit(_P))
    return x


def source_targets(sizes: DataFrame, budget: float, max_repeat: int, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size) -> plus rank, weight and target."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sizes.withColumn("rank", F.row_number().over(by_name).cast("long") - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", w).withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    # sources fill up in the order of cap / weight; if all up to here are full, the rest share the remainder
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    total, all_w = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    s = s.withColumn("level", (F.lit(budget) * total - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
                     / (all_w - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))))
    fits = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    target = F.when(fits.isNull(), F.col("cap").cast("double")) \
        .otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * fits))
    return s.withColumn("target", target).select("source", "source_size", "rank", "target")


def sainte_lague(parties: DataFrame, within: list[str], weight: str, order: str, seats: Column) -> DataFrame:
    """Adds ``quota``: ``seats`` (constant for each ``within``) given to the parties by
    the highest quotients weight / (2k - 1); ties go by ``order``."""
    g = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    p = parties.withColumn("_all", F.sum(weight).over(g)).withColumn("_n", F.count(F.lit(1)).over(g)) \
        .withColumn("_seats", seats.cast("long"))

    def rounded(seats_at: Column) -> Column:
        return F.floor(F.col(weight) * seats_at / F.col("_all") + F.lit(0.5))
    sure = F.when((F.col("_all") > 0) & (F.col("_seats") > F.col("_n")), rounded(F.col("_seats") - F.col("_n"))) \
        .otherwise(F.lit(0))
    most = F.when(F.col("_all") > 0, rounded(F.col("_seats") + F.col("_n")) + 1).otherwise(F.lit(0))
    p = p.withColumn("_sure", sure.cast("long")).withColumn("_most", most.cast("long"))
    p = p.withColumn("_open", F.col("_seats") - F.sum("_sure").over(g))
    key = [*within, order]
    near = p.where("_most > _sure").select(*key, weight, "_open", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k"))
    rank = F.row_number().over(Window.partitionBy(*within, F.lit(0)).orderBy(
        (F.col(weight) / (2 * F.col("_k") - 1)).desc(), order, "_k"))
    won = near.withColumn("_r", rank).where("_r <= _open").groupBy(*key).agg(F.count(F.lit(1)).alias("_won"))
    return p.join(won, key, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))) \
        .drop("_all", "_n", "_seats", "_sure", "_most", "_open", "_won")


def capped_seats(parties: DataFrame, weight: str, order: str, cap: str) -> DataFrame:
    """Adds ``quota``: as many seats as the weights sum to, by the highest quotients, at most
    ``cap`` (not less than the weight) a party.  A party that would get more keeps its cap, and the
    rest is given among the others, which can only add to what they have."""
    left, full, open_ = int(parties.agg(F.round(F.coalesce(F.sum(weight), F.lit(0.0)))).first()[0]), None, parties
    while True:
        given = settle(sainte_lague(open_, [], weight, order, F.lit(left)))
        over = given.where(F.col("quota") > F.col(cap))
        cut = over.agg(F.sum(cap)).first()[0]
        if cut is None:
            return given if full is None else full.unionByName(given)
        kept = over.withColumn("quota", F.col(cap).cast("long"))
        full = kept if full is None else full.unionByName(kept)
        open_, left = given.where(F.col("quota") <= F.col(cap)).drop("quota"), left - int(cut)


def mix_sources(docs: DataFrame, seed: int = 17, block: int = 64, shard_words: int = 1_000_000,
                budget: float = 1.5, max_repeat: int = 2, weights: tuple[int, ...] = WEIGHTS,
                keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (of it the columns ``keep``, or all) in the struct ``row``, with size, source_size, target,
    taken and ``pieces``: array<struct<pass, from, to>>, the words of the text that
    the mix takes in each pass over the corpus (from inclusive, to exclusive)."""
    d = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col("source").alias("source"),
                    F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                    doc_key().alias("id"))
    d = d.withColumn("order", _hash(F.col("id"), seed))
    sizes = settle(d.groupBy("source").agg(F.sum("size").alias("source_size")))
    s = source_targets(sizes, budget, max_repeat, weights)
    most = F.lit(max_repeat) * F.col("source_size")
    s = s.withColumn("most", F.ceil(most / block))
    s = s.withColumn("share", F.coalesce(F.try_divide(F.col("target") * F.col("most"), most.cast("double")), F.lit(0.0)))
    s = capped_seats(settle(s), "share", "rank", "most").drop("most", "share")
    s = settle(s.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)))
               .withColumnRenamed("quota", "source_quota"))
    d = join_small(d, s, "source", F.col("id"))
    d = d.withColumn("shard", F.pmod(_hash(F.col("id"), seed + 1), F.col("shards")))

    parts = settle(d.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("seats")))
    parts = parts.withColumn("blocks", F.floor(F.col("words") / block)) \
        .withColumn("all_blocks", F.ceil(F.lit(max_repeat) * F.col("words") / block))
    # no shard gets more than its blocks, as the seats are no more than the weights
    parts = sainte_lague(parts, ["rank"], "all_blocks", "shard", F.col("seats")).drop("seats")
    parts = settle(parts.withColumn("part", F.col("rank") * 1_000_000_007 + F.col("shard")).drop("rank", "shard"))

    place = Window.partitionBy("rank", "shard").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum("size").over(place), F.lit(0)))
    d = d.withColumn("part", F.col("rank") * 1_000_000_007 + F.col("shard"))
    d = join_small(d, parts, "part", F.col("id"))

    def taken(number: Column) -> Column:
        """Whether the block of that number is in the quota: the whole blocks of the
        first pass come first in seeded order, then those that begin later."""
        first, later = F.col("blocks"), F.col("all_blocks") - F.col("blocks")
        place = F.when(number < first, F.pmod(number * 1_000_003 + F.col("part") + seed, F.greatest(first, F.lit(1)))) \
            .otherwise(first + F.pmod((number - first) * 1_000_003 + F.col("part") + seed, F.greatest(later, F.lit(1))))
        return (number < F.col("all_blocks")) & (place < F.col("quota"))

    def piece(p: int) -> Column:
        at = F.col("start") + F.lit(p) * F.col("words")
        last = F.floor((at + F.col("size") - 1) / block)
        return F.when(F.col("size") > 0, F.transform(
            F.filter(F.sequence(F.floor(at / block), last), taken),
            lambda b: F.struct(F.lit(p).alias("pass"), F.greatest(b * block - at, F.lit(0)).alias("from"),
                               F.least((b + 1) * block - at, F.col("size")).alias("to"))))

    none = F.array().cast("array<struct<pass:int,from:long,to:long>>")
    pieces = F.concat(*[F.coalesce(piece(p), none) for p in range(max_repeat)])
    d = d.withColumn("pieces", pieces)
    words = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return d.select("row", "size", "source_size", "target", words.alias("taken"), "pieces")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: for each document and pass one row
    that holds the words taken, from the first to the last of each run as they stand
    in the text (a text taken whole stays as it is); n_chars follows the text."""
    schema = docs.schema

    def cut(batches):
        for b in batches:
            row, sizes, pieces = b.column("row"), b.column("size").to_pylist(), b.column("pieces").to_pylist()
            columns = {f.name: row.field(k) for k, f in enumerate(row.type)}
            at, texts, held = [], [], 0
            for k, raw in enumerate(each_text(columns["text"])):
                for text in _cut(raw, sizes[k], pieces[k]):
                    at.append(k)
                    texts.append(text)
                    held += len(text)
                if held >= PIECE or k == b.num_rows - 1:
                    made = {"text": texts, "n_chars": [len(x) for x in texts]}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(made[c], a.type) if c in made else a.take(pa.array(at, pa.int64()))
                         for c, a in columns.items()], list(columns))
                    at, texts, held = [], [], 0

    return mix_sources(small_batches(docs), **options).where("taken > 0").select("row", "size", "pieces").mapInArrow(cut, schema)


def _cut(raw: bytes, size: int, pieces: list[dict]) -> list[str]:
    """The text of each pass."""
    by_pass: dict[int, list[list[int]]] = {}
    for p in pieces:
        runs = by_pass.setdefault(p["pass"], [])
        if runs and runs[-1][1] == p["from"]:
            runs[-1][1] = p["to"]
        else:
            runs.append([p["from"], p["to"]])
    out, at = [], None
    for runs in by_pass.values():
        if runs == [[0, size]]:
            out.append(raw.decode())
            continue
        at = at or [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        out.append(b"\n".join(raw[at[s][0]:at[e - 1][1]] for s, e in runs).decode())
    return out


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


def _hash_sql(x: str, seed: int) -> str:
    for k in (48271, 69621, 39373):
        x = f"((({x}) % {_P} * {k} + {seed}) % {_P})"
    return x


OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
             {_hash_sql("doc_id", 17)} AS ord, {_hash_sql("doc_id", 18)} AS h2 FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rk FROM d GROUP BY source),
s1 AS (SELECT *, CAST([5, 2, 1][rk % 3 + 1] AS BIGINT) AS w, 2 * source_size AS cap FROM s0),
s2 AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER below, 0)::DOUBLE)
           / ((sum(w) OVER ()) - coalesce(sum(w) OVER below, 0))::DOUBLE AS lev
       FROM s1 WINDOW below AS (ORDER BY cap::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(CASE WHEN lev <= cap::DOUBLE / w THEN lev END) OVER () AS fits FROM s2),
s4 AS (SELECT source, source_size, rk, least(cap::DOUBLE, w * fits) AS target FROM s3),
s4b AS (SELECT *, CASE WHEN most > 0 THEN target * most / (2 * source_size)::DOUBLE ELSE 0 END AS share
        FROM (SELECT *, (2 * source_size + 63) // 64 AS most FROM s4)),
quo AS (SELECT rk, row_number() OVER (ORDER BY share / (2 * k - 1) DESC, rk, k) AS r,
          (SELECT CAST(round(sum(share)) AS BIGINT) FROM s4b) AS seats
        FROM (SELECT rk, share, unnest(range(1, most + 1)) AS k FROM s4b)),
s5 AS (SELECT s4.*, CAST(ceil(greatest(source_size / 1000000.0, 0.0000001)) AS BIGINT) AS shards,
         (SELECT count(*) FROM quo WHERE quo.rk = s4.rk AND r <= seats) AS quota FROM s4),
e AS (SELECT d.*, rk, source_size, target, quota, h2 % shards AS shard FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
p0 AS (SELECT rk, shard, CAST(sum(size) AS BIGINT) AS words, any_value(quota) AS quota FROM e GROUP BY rk, shard),
pq AS (SELECT rk, shard, row_number() OVER (PARTITION BY rk ORDER BY most::DOUBLE / (2 * k - 1) DESC, shard, k) AS r, quota
       FROM (SELECT rk, shard, (2 * words + 63) // 64 AS most, quota, unnest(range(1, (2 * words + 63) // 64 + 1)) AS k FROM p0)),
p AS (SELECT rk, shard, words, words // 64 AS blocks, (2 * words + 63) // 64 AS all_blocks,
        (SELECT count(*) FROM pq WHERE pq.rk = p0.rk AND pq.shard = p0.shard AND r <= pq.quota) AS quota FROM p0),
f AS (SELECT e.doc_id, e.size, e.source_size, e.target, e.rk * 1000000007 + e.shard AS part, p.words, p.blocks, p.all_blocks, p.quota,
        CAST(coalesce(sum(e.size) OVER (PARTITION BY e.rk, e.shard ORDER BY e.ord, e.doc_id, e.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st,
        row_number() OVER () AS r
      FROM e JOIN p ON e.rk = p.rk AND e.shard = p.shard),
b AS (SELECT *, unnest(range(pos // 64, (pos + size - 1) // 64 + 1)) AS b
      FROM (SELECT *, st + pass * words AS pos FROM f, (VALUES (0), (1)) v(pass) WHERE size > 0)),
t AS (SELECT r, sum(least((b + 1) * 64 - pos, size) - greatest(b * 64 - pos, 0)) AS taken FROM b
      WHERE b < all_blocks AND CASE WHEN b < blocks THEN (b * 1000003 + part + 17) % greatest(blocks, 1)
            ELSE blocks + ((b - blocks) * 1000003 + part + 17) % greatest(all_blocks - blocks, 1) END < quota GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM f LEFT JOIN t USING (r)
"""
