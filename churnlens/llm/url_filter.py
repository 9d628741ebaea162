"""URL filter: path rules, then gradient-boosted trees on lexical features (operator 3).

Rules decide first.  They also label URLs: a URL under a rule is an example of its
verdict, and the trees learn from a bounded sample of those (``SAMPLE`` of each verdict
by the smallest hashes) to judge the URLs that no rule fits.  Features: lengths, path
depth, digit ratio, character entropy, counts of parameters, hyphens and host labels,
and the smoothed block rates of the host's two suffixes and of the first path segment, each
kept for ``BUCKETS`` hash buckets, so the statistics have a fixed size.  They are counted
over all labelled URLs.

Cases: a null URL, or one without ``://``, has an empty host and path and goes to the
trees; an empty table gives an empty result; with labels of one verdict only (or none)
every other URL gets that verdict (or ``allow``); repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh32_intdigest

from .common import settle

#: Fixed by the contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Labelled URLs of each verdict that the trees learn from.
SAMPLE = 10_000
#: Hash buckets of each of the three rates.
BUCKETS = 1024
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """(row, url, host, path): the input row as a struct, and the parts of its URL."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, u.substr(F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)
    after = F.col("rest").substr(F.length(host) + 1, F.length("rest"))
    return pages.select(F.struct("*").alias("row"), u.alias("url"), rest.alias("rest")).select(
        "row", "url", F.translate(host, _ASCII_UPPER, _ASCII_LOWER).alias("host"),
        F.regexp_extract(after, r"(?s)^([^?#]*)", 1).alias("path"))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) \
            & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _bucket(kind: str, value: str) -> int:
    return xxh32_intdigest(f"{kind}:{value}".encode()) % BUCKETS


def url_parts(host: str, path: str) -> tuple[str, str, str]:
    """(host without its first label, its last label, the first path segment)."""
    return host.partition(".")[2] or host, host.rpartition(".")[2], path[1:].partition("/")[0]


def lexical(url: str, host: str, path: str) -> list[float]:
    n = len(url)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values()) if n else 0.0
    query = url.partition("?")[2].partition("#")[0]
    return [n, len(host), len(path), sum(1 for p in path.split("/") if p),
            sum(c.isdigit() for c in url) / n if n else 0.0, entropy,
            len([p for p in query.split("&") if p]), url.count("-"), host.count(".") + 1 if host else 0]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _buckets(host: pa.Array, path: pa.Array) -> pa.Array:
    return pa.array([[_bucket(k, v) for k, v in zip("hst", url_parts(h, p))]
                     for h, p in zip(host.to_pylist(), path.to_pylist())], pa.list_(pa.int32()))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _lexical(url: pa.Array, host: pa.Array, path: pa.Array) -> pa.Array:
    return pa.array([lexical(*x) for x in zip(url.to_pylist(), host.to_pylist(), path.to_pylist())],
                    pa.list_(pa.float64()))


class Rates:
    """Smoothed block rates of the labelled URLs by fold, statistic and bucket: 2 x 3 x
    BUCKETS numbers.  A labelled URL's features come from the other fold, so its own
    label is not among them; another URL's come from both."""

    def __init__(self, counts: DataFrame, prior_weight: float = 5.0):
        self.n, self.bad = np.zeros((2, 3, BUCKETS)), np.zeros((2, 3, BUCKETS))
        for r in counts.collect():                       # at most 2 x 3 x BUCKETS rows
            self.n[r["fold"], r["kind"], r["bucket"]] = r["n"]
            self.bad[r["fold"], r["kind"], r["bucket"]] = r["bad"]
        self.labelled, self.blocked = self.n[:, 0].sum(), self.bad[:, 0].sum()
        prior = self.blocked / self.labelled if self.labelled else 0.5
        n = np.stack([self.n[1], self.n[0], self.n.sum(axis=0)])
        bad = np.stack([self.bad[1], self.bad[0], self.bad.sum(axis=0)])
        self.table = (bad + prior_weight * prior) / (n + prior_weight)

    def column(self) -> Column:
        table = self.table

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def rates(buckets: pa.Array, fold: pa.Array) -> pa.Array:
            return pa.array([table[f, (0, 1, 2), at].tolist() for at, f in zip(buckets.to_pylist(), fold.to_pylist())],
                            pa.list_(pa.float64()))
        return rates("buckets", F.when(F.col("label").isNull(), F.lit(2)).otherwise(_fold()))


def _fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")


def block_scores(urls: DataFrame, seed: int = 7) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: block) to (url, host, path, label, ...), where
    label is 1 (block), 0 (allow) or null."""
    b = urls.withColumn("buckets", _buckets("host", "path"))
    counts = b.where("label is not null").select("label", _fold().alias("fold"), F.posexplode("buckets").alias("kind", "bucket")) \
        .groupBy("fold", "kind", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))
    rates = Rates(settle(counts))
    if rates.blocked in (0, rates.labelled):
        return urls.withColumn("score", F.lit(float(rates.blocked > 0)))
    f = b.withColumn("values", F.concat(_lexical("url", "host", "path"), rates.column()))
    order = F.xxhash64("url")
    known = urls.where("label is not null").select("url", "host", "path", "label")
    train = known.where("label = 1").orderBy(order, "url").limit(SAMPLE) \
        .union(known.where("label = 0").orderBy(order, "url").limit(SAMPLE))
    train = train.withColumn("buckets", _buckets("host", "path"))
    train = settle(train.withColumn("values", F.concat(_lexical("url", "host", "path"), rates.column()))
                   .select(array_to_vector("values").alias("features"), F.col("label").cast("double").alias("label")).coalesce(1))
    model = GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.3, seed=seed, maxBins=32).fit(train)
    scored = model.transform(f.withColumn("features", array_to_vector("values")))
    return scored.withColumn("score", vector_to_array("probability")[1]) \
        .select(*urls.columns, "score")


def url_filter(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Every row of ``pages`` in the struct ``row``, with host, path, rule, verdict and
    score (null where a rule decides)."""
    rule, said = rule_columns(rules)
    u = with_host_and_path(pages).withColumn("rule", rule).withColumn("said", said)
    u = u.withColumn("label", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    s = block_scores(u)
    verdict = F.coalesce("said", F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return s.select("row", "host", "path", "rule", verdict.alias("verdict"),
                    F.when(F.col("said").isNull(), F.col("score")).alias("score"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages).select("row.page_id", "host", "path", "rule", "verdict")
