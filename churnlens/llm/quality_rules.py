"""Host-level quality rules (operator 7).

Each document is measured once; documents that break a rule are counted by
host (the ``source`` column); every host's failure rate is shrunk by a beta
prior fitted to all hosts, and the host's verdict goes back to its documents.

Cases: a null or empty text has no words and fails; a null source is a host of
its own; repeated rows count as rows; an empty table gives an empty result;
with one host, or hosts that do not differ, the prior is the overall rate
with the weight ``default_weight``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, each_text, join_small, small_batches

#: Fixed by the contract: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURES = T.StructType([T.StructField(k, T.LongType()) for k in MEASURES])


def _code_points(raw: bytes) -> int:
    a = np.frombuffer(raw, np.uint8)
    return int(np.count_nonzero((a & 0xC0) != 0x80))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    size = len(index) + 1
    pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
    _, at, times = np.unique(pair[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    again = times[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def measure(raw: bytes) -> dict:
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return {
        "n_words": len(words),
        "word_chars": _code_points(b"".join(words)),
        "n_symbols": int(_IS_SYMBOL[np.frombuffer(raw, np.uint8)].sum()),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
    }


@F.arrow_udf(_MEASURES)
def _measured(text: pa.Array) -> pa.Array:
    return pa.array([measure(x) for x in each_text(text)], pa.struct([(k, pa.int64()) for k in MEASURES]))


def base_failed(m: Column, min_words: int, max_repeat_pct: int) -> Column:
    return (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_pct * m["n_words"])


def host_verdicts(failures: DataFrame, max_host_rate: float, default_weight: float) -> DataFrame:
    """(host, n, failed) -> (host, rate, host_ok).  The prior's mean is the failure
    rate of all rows, and its weight comes from the spread of the hosts' rates
    (method of moments); it is fitted by one aggregation over the hosts."""
    f = failures.withColumn("p", F.col("failed") / F.col("n"))
    prior = f.agg(F.sum("failed").alias("x"), F.sum("n").alias("t"), F.var_samp("p").alias("v"),
                  F.avg(1 / F.col("n")).alias("r"))
    mean = F.col("x") / F.col("t")
    noise = mean * (1 - mean) * F.col("r")
    spread = F.greatest(F.col("v") - noise, F.lit(0.0))
    weight = F.when(spread > 0, F.greatest(mean * (1 - mean) / spread - 1, F.lit(0.0))).otherwise(
        F.lit(default_weight))
    prior = prior.select(mean.alias("m"), F.least(F.coalesce(weight, F.lit(default_weight)),
                                                  F.lit(1e9)).alias("w"))
    both = prior.select(F.struct("m", "w").alias("prior"))
    rate = (F.col("failed") + F.col("prior.m") * F.col("prior.w")) / (F.col("n") + F.col("prior.w"))
    return f.withColumn("prior", both.scalar()).select(
        "host", rate.alias("host_rate"), (rate <= max_host_rate).alias("host_ok"))


def quality_rules(docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat_pct: int = 50,
                  max_host_rate: float = 0.5, default_weight: float = 10.0) -> DataFrame:
    """Every row of ``docs`` with the struct column ``_quality`` (which replaces one of
    that name): the measures, ``base_failed``, ``host_rate`` (shrunk) and ``kept``."""
    m = small_batches(docs).select(F.struct("*").alias("row"), F.col(host).alias("host"), _measured(F.col("text")).alias("m"))
    m = m.withColumn("bad", base_failed(F.col("m"), min_words, max_repeat_pct))
    hosts = m.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("failed"))
    j = join_small(m, host_verdicts(hosts, max_host_rate, default_weight), "host", F.xxhash64("row.text"))
    q = F.struct("m.*", F.col("bad").alias("base_failed"), "host_rate",
                 (~F.col("bad") & F.col("host_ok")).alias("kept"))
    return j.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "_quality"], q.alias("_quality"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "text", "source")
    return quality_rules(d).select(
        "doc_id", *[f"_quality.{c}" for c in (*MEASURES, "base_failed", "kept")])


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
gg AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM gg, (VALUES (0), (1), (2)) t(k) GROUP BY r),
m AS (SELECT d.r, d.doc_id, d.source, CAST(len(w.w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(w.l) - len(list_distinct(w.l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS x FROM b GROUP BY source),
p0 AS (SELECT sum(x) / sum(n) AS m, var_samp(x / n) AS v, avg(1.0 / n) AS r FROM h),
p AS (SELECT m, CASE WHEN v - m * (1 - m) * r > 0
        THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * r) - 1, 0.0), 1e9) ELSE 10.0 END AS w FROM p0),
ok AS (SELECT source, (x + m * w) / (n + w) <= 0.5 AS ok FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND ok) AS kept
FROM b JOIN ok ON b.source IS NOT DISTINCT FROM ok.source
"""
