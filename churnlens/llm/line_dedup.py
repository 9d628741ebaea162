"""Line deduplication over a sharded minimal perfect hash (operator 1).

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z
lower-cased.  Keys of ``min_chars`` code points or more are hashed to 128 bits.  Each
shard of the hashes builds a minimal perfect hash over its distinct line hashes; the
slot of a hash indexes an array of 16-bit fingerprints, an array of document counts
(which stop at ``min_docs``: more is not asked) and an array of the largest doc_id.
The documents' line hashes, packed by block, probe these arrays; no line is joined.  Hashes
that a large share of all records hold are summed up apart from the blocks (``exchange.py``).
A key found in ``min_docs`` documents stays only in the largest doc_id that holds it.

Cases: a null or empty text is one empty line; repeated rows of a doc_id are one
document for the counts and each gets its own result; a null doc_id counts as one
document below all others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import documents, from_key
from .exchange import Known, apply, by_block, judge, summarise
from .line_index import PerfectHash

RECORD = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("doc", "<i8")])


def _changes(r: np.ndarray, *fields: str) -> np.ndarray:
    """True where a record differs in these fields from the one before it."""
    out = np.zeros(len(r), bool)
    out[:1] = True
    for f in fields:
        out[1:] |= r[f][1:] != r[f][:-1]
    return out


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def line_digests(raw: bytes, min_chars: int) -> list[bytes | None]:
    """The digest of each line's key; None where the key is too short."""
    keys = (line.strip().lower() for line in raw.split(b"\n"))
    return [xxh3_128_digest(k) if _long_enough(k, min_chars) else None for k in keys]


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for every row of ``docs``."""
    def units(doc: int, raw: bytes) -> np.ndarray | None:
        found = {d for d in line_digests(raw, min_chars) if d}
        if not found:
            return None
        r = np.empty(len(found), RECORD)
        words = np.frombuffer(b"".join(found), "<u8")
        r["hi"], r["lo"], r["doc"] = words[::2], words[1::2], doc
        return r

    def shrink(r: np.ndarray) -> np.ndarray:
        """Of each digest's documents the first ``min_docs`` and the last."""
        new = _changes(r, "hi", "lo")
        apart = new | _changes(r, "doc")
        r, new = r[apart], new[apart]
        start = np.flatnonzero(new)
        rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        return r[(rank < min_docs) | np.r_[new[1:], True]]

    def verdicts(r: np.ndarray, blocks: np.ndarray):
        order = np.lexsort((r["doc"], r["lo"], r["hi"]))
        s = r[order]
        new = _changes(s, "hi", "lo")
        start = np.flatnonzero(new)
        docs_of = np.add.reduceat((new | _changes(s, "doc")).astype(np.int64), start)
        keys = s[start]
        index = PerfectHash(keys["hi"], keys["lo"])
        slot = index.slots(keys["hi"], keys["lo"])
        prints = np.zeros(len(keys), np.uint16)
        counts = np.zeros(len(keys), np.uint8 if min_docs < 256 else np.int64)
        last = np.zeros(len(keys), np.int64)
        prints[slot] = (keys["hi"] >> np.uint64(48)).astype(np.uint16)
        counts[slot] = np.minimum(docs_of, min_docs)
        last[slot] = s["doc"][np.r_[start[1:], len(s)] - 1]
        at = index.slots(r["hi"], r["lo"])
        hot = (counts[at] >= min_docs) & (prints[at] == (r["hi"] >> np.uint64(48)).astype(np.uint16))
        answer = r[hot].copy()
        answer["doc"] = last[at[hot]]
        blocks = blocks[hot]
        order = np.lexsort((answer["lo"], answer["hi"], blocks))
        answer, blocks = answer[order], blocks[order]
        once = _changes(answer, "hi", "lo") | np.r_[True, blocks[1:] != blocks[:-1]][:len(blocks)]
        return by_block(blocks[once], answer[once])

    def load(payload: bytes) -> dict:
        return {payload[i:i + 16]: int.from_bytes(payload[i + 16:i + 24], "little", signed=True)
                for i in range(0, len(payload), RECORD.itemsize)}

    def rewrite(doc: int, raw: bytes, last: Known) -> tuple:
        lines = raw.split(b"\n")
        if not last:
            return len(lines), 0, raw
        keep = [d is None or last.get(d, doc) == doc for d in line_digests(raw, min_chars)]
        if all(keep):
            return len(lines), 0, raw
        return len(lines), len(lines) - sum(keep), b"\n".join(x for x, k in zip(lines, keep) if k)

    answers = judge(summarise(docs, units, shrink, RECORD), shrink, verdicts, RECORD)
    out = apply(docs, answers, rewrite, load,
                [("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("raw", pa.binary())],
                "n_lines long, n_dropped long, raw binary")
    return out.select(from_key("doc").alias("doc_id"), "n_lines", "n_dropped", F.decode("raw", "UTF-8").alias("text"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT r, doc_id, i, l[i] AS line FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
hot AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40
        GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, (hot.k IS NOT NULL AND k.doc_id <> hot.last) AS gone FROM k LEFT JOIN hot ON k.k = hot.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
