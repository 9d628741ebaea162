"""Removal of repeated passages by hashing short units of text (operator 9).

A text is cut at line ends and after the marks that end a clause or a sentence (a mark with
another less than ``UNIT_WORDS`` words before it does not count).  Between these, a text is
cut at content-defined words: of every ``WINDOW`` places in a row, that with the smallest
hash of the two words around it, so no unit has more than ``WINDOW`` words.  Whether a place
is a cut depends on the words near it alone: two copies of a passage have the same cuts but
for ``WINDOW + UNIT_WORDS - 1`` words at its start and ``WINDOW`` at its end, whatever stands
around them, and of 51 words at least 25 are in units that both have.

Words are normalised (A-Z lower-cased, white space made single spaces).  Each unit is hashed
to 128 bits together with the ``REACH - 1`` units after it, because a unit alone can be a
phrase that many texts use.  Digests are grouped over all documents; the first occurrence by
(doc_id, position) stays, every other is a repeat of all its units.  Repeated units that
follow each other make a passage; a passage of ``min_words`` words or more is removed.

The words at a passage's ends that share a unit with other text are not part of it, so
``min_words`` lies well under the length of the passages that are to be found.

Cases: a null or empty text has no repeats; a null doc_id ranks before all others; rows that
share a doc_id are one document: its first occurrences stay in each of the rows; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import NO_ID, documents, from_key
from .exchange import Known, apply, by_block, judge, summarise

UNIT_WORDS, MIN_WORDS, WINDOW, REACH = 5, 25, 11, 3
RECORD = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("n", "<u4")])

_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\v\f\r")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".!?,;:")] = True
_BYTE = np.random.default_rng(9).integers(1, 1 << 63, 256).astype(np.uint64)
_BYTE[32] = 0          # the space after a word is no part of it
_ODD, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(1 << 63)
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()),
                            ("first_doc_id", pa.int64())]))


def _cuts(text: np.ndarray, start: np.ndarray, end: np.ndarray, after_line: np.ndarray) -> np.ndarray:
    """The words before which a text is cut, without the first; ``text`` is normalised,
    ``after_line`` tells which words but the first follow a line end."""
    n = len(start)
    mark = after_line | _MARK[text[end[:-1] - 1]]                 # of the place before word k + 1
    near = np.cumsum(np.r_[np.zeros(UNIT_WORDS, np.int64), 1, mark])   # the text's start counts as a mark
    cut = after_line | mark & (near[UNIT_WORDS:-1] == near[1:n])
    if n > WINDOW:
        place = np.arange(len(text)) - np.repeat(start, np.diff(np.r_[start, len(text)]))
        word = np.add.reduceat(_BYTE[text] * (2 * place + 1).astype(np.uint64), start)
        pair = (word[:-1] * _ODD ^ (word[1:] >> np.uint64(29)) + word[1:]) * _ODD
        rank = (pair ^ pair >> np.uint64(32)) * _ODD >> np.uint64(1)
        rank = np.where(cut, rank, rank | _LAST)                  # marks go before other places
        windows = np.lib.stride_tricks.sliding_window_view(rank, WINDOW)
        least = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
        cut[_thinned(least, rank[least])] = True
    return np.flatnonzero(cut) + 1


def _thinned(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """``at`` without the places that a loop of few words repeats within a window: there
    each unit has as many rounds as fit, and all units are equal."""
    if not len(at) or not (rank[1:] == rank[:-1]).any():
        return at
    at, rank, keep, last = at.tolist(), rank.tolist(), [], 0
    for k, x in enumerate(at):
        ties = 0 < k < len(at) - 1 and rank[k - 1] == rank[k] == rank[k + 1]
        if not ties or at[k + 1] - last > WINDOW:
            keep.append(x)
            last = x
    return np.array(keep, np.int64)


def units(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit, in bytes of the text; the digest is that
    of the unit and the REACH - 1 units after it."""
    text = b" ".join(raw.lower().split())
    if not text:
        return []
    a, flat = np.frombuffer(raw, np.uint8), np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, _BLANK[a], True]))
    start, end = edge[::2], edge[1::2]
    space = np.flatnonzero(flat == 32)
    low, high = np.r_[0, space + 1], np.r_[space, len(flat)]
    line = np.flatnonzero(a == 10)
    after_line = np.searchsorted(line, start[1:]) > np.searchsorted(line, end[:-1])
    first = np.r_[0, _cuts(flat, low, high, after_line)]
    last = np.r_[first[1:], len(start)] - 1
    reach = last[np.minimum(np.arange(len(first)) + REACH - 1, len(first) - 1)]
    digests = [xxh3_128_digest(text[x:y]) for x, y in zip(low[first].tolist(), high[reach].tolist())]
    return list(zip(start[first].tolist(), end[last].tolist(), (last - first + 1).tolist(), digests))


def repeated_spans(doc: int, raw: bytes, first: Known | dict, min_words: int) -> list[tuple[int, int, int, int]]:
    """(start, end, words, first document) of the passages to remove, in bytes."""
    out, run, ahead, source = [], None, 0, None
    for pos, (start, end, words, digest) in enumerate(units(raw)):
        seen = first.get(digest)
        if seen is not None and seen != (doc, pos):
            ahead, source = REACH, seen[0]
        if ahead:
            run = (run[0], end, run[2] + words, run[3]) if run else (start, end, words, source)
            ahead -= 1
        elif run:
            out.append(run)
            run = None
    if run:
        out.append(run)
    return [r for r in out if r[2] >= min_words]


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, spans) for every row of ``docs``: what stays of the text, and the
    passages removed as array<struct<start, end, n_words, first_doc_id>>, in code points
    of the original text."""
    def digests(doc: int, raw: bytes) -> np.ndarray | None:
        found = units(raw)
        if not found:
            return None
        r = np.empty(len(found), RECORD)
        words = np.frombuffer(b"".join(u[3] for u in found), "<u8")
        r["hi"], r["lo"], r["doc"], r["pos"], r["n"] = words[::2], words[1::2], doc, np.arange(len(found)), 1
        return r

    def starts(r: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, (r["hi"][1:] != r["hi"][:-1]) | (r["lo"][1:] != r["lo"][:-1])])

    def shrink(r: np.ndarray) -> np.ndarray:
        """The first occurrence in the block, and how many there are."""
        r = r[np.lexsort((r["pos"], r["doc"], r["lo"], r["hi"]))]
        at = starts(r)
        out = r[at].copy()
        out["n"] = np.add.reduceat(r["n"], at)
        return out

    def verdicts(r: np.ndarray, blocks: np.ndarray):
        order = np.lexsort((r["pos"], r["doc"], r["lo"], r["hi"]))
        r, blocks = r[order], blocks[order]
        at = starts(r)
        size = np.diff(np.r_[at, len(r)])
        first = np.repeat(at, size)
        again = np.repeat(np.add.reduceat(r["n"].astype(np.int64), at) > 1, size)
        answer = r[first[again]]
        return by_block(blocks[again], answer)

    def load(payload: bytes) -> dict:
        r = np.frombuffer(payload, RECORD)
        return {payload[i:i + 16]: seen for i, seen in zip(range(0, len(payload), RECORD.itemsize),
                                                           zip(r["doc"].tolist(), r["pos"].tolist()))}

    def rewrite(doc: int, raw: bytes, first: Known) -> tuple:
        spans = repeated_spans(doc, raw, first, min_words) if first else []
        if not spans:
            return raw, []
        keep, at, points, out = [], 0, 0, []
        for start, end, words, seen in spans:
            keep.append(raw[at:start])
            points += len(raw[at:start].decode())
            length = len(raw[start:end].decode())
            out.append({"start": points, "end": points + length, "n_words": words,
                        "first_doc_id": None if seen == NO_ID else seen})
            points += length
            at = end
        return b"".join([*keep, raw[at:]]), out

    answers = judge(summarise(docs, digests, shrink, RECORD), shrink, verdicts, RECORD)
    out = apply(docs, answers, rewrite, load, [("raw", pa.binary()), ("spans", _SPAN)],
                "raw binary, spans array<struct<start:long,end:long,n_words:long,first_doc_id:long>>")
    return out.select(from_key("doc").alias("doc_id"), F.decode("raw", "UTF-8").alias("text"), "spans")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each passage removed."""
    d = substring_dedup(documents(spark, sf_dir)).where(F.size("spans") > 0)
    return d.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
