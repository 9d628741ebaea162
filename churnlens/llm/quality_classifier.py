"""Quality classifier: hashed word n-gram logistic regression (operator 4).

Features are hashed to ``2 ** BITS`` columns: word unigrams and bigrams, and unigrams and
bigrams of the words' shapes (letter case, digits and marks, runs written once), where a
word that repeats the one before it has a mark of its own.  A feature's value is its count over
the square root of the number of words.

Training follows the regularised leader (FTRL-proximal).  The sample is bounded: the
``SAMPLE`` labelled documents outside the held-out fold with the smallest id hashes.  Each
of ``SHARDS`` tasks runs FTRL over its part of the sample for ``EPOCHS`` rounds, and the
weights are averaged.  A score is the sparse dot product with the averaged weights.

Cases: a null or empty text has the bias alone; a null label is no label; labels that
disagree for one doc_id count as 0; a null doc_id is never learned from; without labels
every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh32_intdigest

from .common import documents, each_text, held_out, small_batches

BITS = 18
SAMPLE, SHARDS, EPOCHS = 16_000, 8, 3
#: FTRL-proximal: step size, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.05, 0.1
#: Words whose hashes a task remembers.
CACHE = 200_000

_MASK = np.uint64((1 << BITS) - 1)
_MARKS = re.compile(rb"[A-Z]+|[a-z\x80-\xff]+|[0-9]+|(.)\1*", re.DOTALL)


def _shape(word: bytes) -> bytes:
    def one(m):
        c = m.group()[:1]
        return b"X" if c.isupper() else b"x" if c.islower() or c >= b"\x80" else b"0" if c.isdigit() else c
    return _MARKS.sub(one, word)


class _Hashes(dict):
    """word -> hash of the word (high half) and of its shape (low half)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxh32_intdigest(word) << 32 | xxh32_intdigest(_shape(word), 1)
        return h


_HASHES = _Hashes()
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _pairs(h: np.ndarray, salt: int) -> np.ndarray:
    return (h[:-1] * _PAIR ^ (h[1:] + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)


def features(raw: bytes) -> tuple[np.ndarray, float]:
    """Columns (one for each occurrence) and the value of an occurrence."""
    words = raw.split()
    if not words:
        return np.empty(0, np.int64), 0.0
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    word, shape = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
    shape = shape.copy()
    shape[1:][word[1:] == word[:-1]] ^= np.uint64(0x55555555)
    out = np.concatenate([word, shape, _pairs(word, 1), _pairs(shape, 2)]) & _MASK
    return out.astype(np.int64), len(words) ** -0.5


def ftrl(rows: list[tuple[np.ndarray, float, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) after ``epochs`` rounds over (columns, value, label)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = [(np.append(i, size - 1), np.append(x, 1.0), y) for i, x, y in map(_counted, rows)]
    for _ in range(epochs):
        for i, x, y in rows:
            w = _weights(z[i], n[i])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return _weights(z, n).astype(np.float32)


def _counted(row):
    columns, value, label = row
    i, count = np.unique(columns, return_counts=True)
    return i, count * value, label


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray | None:
    """Averaged weights, or None where there is nothing to learn from."""
    sample = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()) \
        .groupBy("doc_id").agg(F.min(label).alias("y")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id") \
        .select("text", F.col("y").cast("int").alias("y"), F.xxhash64("doc_id", F.lit("order")).alias("at"),
                F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS)).cast("int").alias("shard"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        w = ftrl([(*features(x), y) for x, y in zip(each_text(table.column("text").combine_chunks()), table.column("y").to_pylist())])
        return pa.table({"weights": pa.array([w.tobytes()], pa.binary()), "shard": table.column("shard")[:1].cast(pa.int32())})
    fitted = rows.groupBy("shard").applyInArrow(fit, "weights binary, shard int").collect()   # SHARDS rows of fixed size
    if not fitted:
        return None
    return np.mean([np.frombuffer(r["weights"], np.float32) for r in sorted(fitted, key=lambda r: r["shard"])], axis=0)


def score(raw: bytes, weights: np.ndarray) -> float:
    columns, value = features(raw)
    s = float(weights[columns].sum(dtype=np.float64)) * value + float(weights[-1])
    return 1 / (1 + np.exp(-min(max(s, -30.0), 30.0)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Every row of ``docs`` in the struct ``row``, with held_out, score and predicted."""
    weights = train(small_batches(docs), labels)
    rows = docs.select(F.struct("*").alias("row"), held_out().alias("held_out"), F.col("text"))
    if weights is None:
        rows = rows.withColumn("score", F.lit(0.5))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(weights)      # 1 MB, whatever the corpus

        @F.arrow_udf(T.DoubleType())
        def scored(text: pa.Array) -> pa.Array:
            return pa.array([score(x, shared.value) for x in each_text(text)], pa.float64())
        rows = rows.withColumn("score", scored("text"))
    return rows.select("row", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(documents(spark, sf_dir).select("doc_id", "text"), labels) \
        .select("row.doc_id", "held_out", "score", "predicted")
