"""Language identification with spans (operator 10).

Model: counts of the byte trigrams of words, by language, in ``2 ** BITS`` hash buckets,
and the scripts in which a language writes; both from a bounded sample (about ``SAMPLE``
documents of each known language outside the held-out fold, those with the smallest id
hashes, counted in ``SHARDS`` tasks), so a rare language is learned however many documents
the others have.

Prediction: the script ranges of a word's letters narrow the languages (all stay where none
writes in that script); a word's score in a language is the log-probability of its
trigrams; Viterbi with a switching penalty then labels the words, so mixed text falls into
spans.  The document's language is the one with most letters, the score its share of them.
All texts of a chunk go through Viterbi together, one word position at a time.

Cases: a null text, or one without a letter, is ``und`` with score 0; without anything to
learn from every document is ``und``; a null doc_id is never learned from; ties go to the
language first in code-point order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, each_text, held_out, small_batches

BITS, SAMPLE, SHARDS = 16, 16_000, 8
#: Log-probability that changing the language within a text costs.
SWITCH = 12.0
#: Bytes of text that go through Viterbi together.
CHUNK = 4 << 20

#: Scripts as ranges of a UTF-8 letter's first byte (fixed by Unicode's blocks).
SCRIPTS = (
    (0x41, 0x5A), (0x61, 0x7A),        # Latin, ASCII
    (0xC3, 0xC9),                      # Latin with marks
    (0xCE, 0xCF),                      # Greek
    (0xD0, 0xD3),                      # Cyrillic
    (0xD6, 0xD7),                      # Hebrew
    (0xD8, 0xDB),                      # Arabic
    (0xE0, 0xE0),                      # Indic and Thai
    (0xE3, 0xE3),                      # Kana
    (0xE4, 0xE9),                      # Han
    (0xEA, 0xED),                      # Hangul
)
_SCRIPT = np.zeros(256, np.uint16)
for _bit, (_low, _high) in enumerate([(0x41, 0x7A), *SCRIPTS[3:]]):
    _SCRIPT[_low:_high + 1] = 1 << _bit
_SCRIPT[0x5B:0x61] = 0
_SCRIPT[0xC3:0xCA] = 1                                   # one Latin script with and without marks

_LETTER = np.zeros(256, bool)                            # ASCII letters and all bytes of other characters
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Words:
    """The words of a text: runs of letters, lower-cased, as positions in its bytes."""

    def __init__(self, raw: bytes):
        a = np.frombuffer(raw, np.uint8)
        letter = _LETTER[a]
        edge = np.diff(np.r_[False, letter, False].astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        low = _LOWER[a]
        accent = np.zeros(len(a), bool)
        accent[1:] = (a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] <= 0x9E) & (a[1:] != 0x97)
        low[accent] += 32
        low[~letter] = 32
        wide = np.r_[np.uint32(32), low.astype(np.uint32), np.uint32(32)]
        gram = wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA6B) ^ wide[2:] * np.uint32(0xC2B2AE35)
        self.gram = (gram ^ gram >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)
        self.letter = letter
        self.script = np.bitwise_or.reduceat(_SCRIPT[a], self.start) if len(self.start) else np.empty(0, np.uint16)
        # the last byte before the next word belongs to the gap, so cut the sums at each word's end
        self.size = self.end - self.start

    def sums(self, table: np.ndarray) -> np.ndarray:
        """The sum of ``table`` over the trigrams of each word."""
        if not len(self.start):
            return np.empty(0, table.dtype)
        values = np.where(self.letter, table[self.gram], table.dtype.type(0))
        return np.add.reduceat(values, self.start)


def learn(docs: DataFrame) -> dict | None:
    """languages, log-probabilities (language, bucket) and script masks."""
    known = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    # each language has its own share of the ids, all of them where there are few; HLL counts
    # do not depend on how rows are dealt, so neither does the sample
    order = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    bound = docs.where(known).groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.01).alias("ids")) \
        .select("lang", (F.least(F.lit(1.0), SAMPLE / F.col("ids")) * 2.0 ** 63).alias("bound"))
    rows = docs.where(known).select("doc_id", "lang", "text").join(F.broadcast(bound), "lang").where(order <= F.col("bound")) \
        .select("doc_id", "lang", "text").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)))

    def count(table: pa.Table) -> pa.Table:
        counts, scripts = np.zeros(1 << BITS, np.int64), np.zeros(16, np.int64)
        for raw in each_text(table.column("text").combine_chunks()):
            w = Words(raw)
            counts += np.bincount(w.gram[w.letter], minlength=1 << BITS)
            for bit in range(16):
                scripts[bit] += int(((w.script >> bit) & 1).sum())
        return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([counts.tobytes()], pa.binary()),
                         "scripts": pa.array([scripts.tobytes()], pa.binary())})
    # rows of fixed size, SHARDS for a language at most
    found = rows.groupBy("lang", "shard").applyInArrow(count, "lang string, counts binary, scripts binary").collect()
    if not found:
        return None
    langs = sorted({r["lang"] for r in found}, key=lambda x: x.encode())
    counts = np.zeros((len(langs), 1 << BITS))
    scripts = np.zeros((len(langs), 16))
    for r in found:
        counts[langs.index(r["lang"])] += np.frombuffer(r["counts"], np.int64)
        scripts[langs.index(r["lang"])] += np.frombuffer(r["scripts"], np.int64)
    logp = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS)))
    writes = scripts >= 0.01 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    masks = (writes * (1 << np.arange(16))).sum(axis=1).astype(np.uint16)
    return {"langs": langs, "logp": logp.astype(np.float32), "masks": masks}


def word_scores(words: Words, model: dict) -> np.ndarray:
    """(word, language) log-probabilities; a language without the word's script is out."""
    logp, masks = model["logp"], model["masks"]
    out = np.stack([words.sums(row) for row in logp], axis=1)
    fits = (words.script[:, None] & ~masks[None, :]) == 0
    fits |= ~fits.any(axis=1, keepdims=True)
    return np.where(fits, out, out.min(axis=1, keepdims=True) - np.float32(1e4))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of texts that lie end to end in ``scores`` (word, language)."""
    offsets = np.r_[0, np.cumsum(lengths)[:-1]]
    order = np.argsort(-lengths, kind="stable")
    offsets, lengths = offsets[order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")     # texts longer than t
    came = np.empty(scores.shape, np.int16)
    labels = np.empty(len(scores), np.int16)
    v = np.zeros((len(lengths), scores.shape[1]))
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(steps):
        n = active[t]
        at = offsets[:n] + t
        if t:
            best = v[:n].argmax(axis=1)
            jump = v[np.arange(n), best][:, None] - switch
            stay = v[:n] >= jump
            came[at] = np.where(stay, own, best[:, None])
            v[:n] = np.where(stay, v[:n], jump)
        v[:n] += scores[at]
    label = v.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = offsets[:n] + t
        labels[at] = label[:n]
        if t:
            label[:n] = came[at, label[:n]]
    return labels


def label_texts(raws: Iterable[bytes], model: dict, switch: float = SWITCH) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans in code points) of each text."""
    out, held, size = [], [], 0
    for raw in raws:
        held.append(raw)
        size += len(raw)
        if size >= CHUNK:
            out += _label_chunk(held, model, switch)
            held, size = [], 0
    return out + _label_chunk(held, model, switch)


def _label_chunk(raws, model, switch):
    words = [Words(r) if _has_letter(r) else None for r in raws]
    scored = [w for w in words if w]
    lengths = np.array([len(w.start) for w in scored], np.int64)
    scores = np.concatenate([word_scores(w, model) for w in scored]) if scored else np.empty((0, len(model["langs"])))
    labels = viterbi(scores, lengths, switch)
    out, at = [], 0
    for raw, w in zip(raws, words):
        if w is None:
            out.append(("und", 0.0, []))
            continue
        own = labels[at:at + len(w.start)]
        at += len(w.start)
        letters = np.bincount(own, weights=w.size, minlength=len(model["langs"]))
        best = int(letters.argmax())
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ends = np.r_[cuts[1:], len(own)] - 1
        points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
        spans = [{"start": int(points[w.start[s]]), "end": int(points[w.end[e]]), "lang": model["langs"][own[s]]}
                 for s, e in zip(cuts, ends)]
        out.append((model["langs"][best], float(letters[best] / letters.sum()), spans))
    return out


def _has_letter(raw: bytes) -> bool:
    if raw.isascii():
        return any(map(_ASCII_LETTERS.__contains__, raw))
    return any(map(str.isalpha, raw.decode()))


_ASCII_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_OUT = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])))])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(docs: DataFrame, switch: float = SWITCH) -> DataFrame:
    """Every row of ``docs`` in the struct ``row``, with held_out, lang_pred, score and
    spans (array<struct<start, end, lang>> in code points of the text)."""
    model = learn(small_batches(docs))
    rows = docs.select(F.struct("*").alias("row"), held_out().alias("held_out"), F.col("text"))
    if model is None:
        none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                        F.array().cast(_OUT["spans"].dataType).alias("spans"))
        return rows.select("row", "held_out", none.alias("x")).select("row", "held_out", "x.*")
    # a row of 2 ** BITS numbers for each language in the sample
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_OUT)
    def labelled(text: pa.Array) -> pa.Array:
        found = label_texts(each_text(text), shared.value, switch)
        lang, score, spans = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                           pa.array(spans, _SPANS)], ["lang_pred", "score", "spans"])
    return rows.select("row", "held_out", labelled("text").alias("x")).select("row", "held_out", "x.*")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    d = identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return d.select("row.doc_id", "held_out", "lang_pred", "score")
