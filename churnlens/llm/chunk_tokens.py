"""Byte-level BPE by content-defined chunks (operator 11).

A rolling hash of 32 bytes cuts texts into chunks (512 bytes on average), so equal
passages give equal chunks wherever they stand.  A chunk that several documents hold is
encoded once, for all of them.

* ``_seen``: scan tasks send chunk digests, summed up per task; a digest that two rows hold
  is *shared*.  The shared digests become a bit filter of fixed size (``prefilter``).
* ``_requests``: a second scan sends the text of chunks that pass the filter, once a task,
  and which group of documents asks for which chunk, once a group and task.
* ``_answers``: the task that owns a digest encodes its chunk once and answers each group
  that asked.  A chunk that all documents hold is one answer for each group.
* ``_bodies``: a third scan encodes, where the text lies, what no shared chunk gives, and
  puts references in place of the rest.  Bodies and answers meet by group.

Joins are repaired as follows.  A white space byte before a character that is certainly no
white space is an *agreement point*: the tokenizer starts a new piece there whatever
stands on either side, so any two encodings agree there.  A shared chunk gives the ids from its
first to its last such point.  The window over a join runs from the last point of the
chunk before to the first of the chunk after, grows over chunks that are too short to
have two points or are not shared, and is encoded anew.

Cases: a null or empty text has no ids; rows that share a doc_id stay rows of their own;
a null doc_id stays null; the string of a special token is that token, as in the
library; a text without any agreement point is encoded whole.  Chunks have no largest
size: a long run of one byte is one chunk.
"""

from __future__ import annotations

import array
import functools
import hashlib
import os
import string
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefilter
from .common import doc_key, documents, each_text, from_key, partitions, small_batches

#: A chunk ends where this many high bits of the rolling hash are zero.
CHUNK_BITS = 9
#: Groups of documents for each shuffle partition.
GROUPS = 4
#: Digests that a scan task holds before it sends them, and pieces whose ids it remembers.
HELD, CACHE = 1_000_000, 400_000

_GEAR = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 32, 256, np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: First bytes of characters that are no white space and begin no special token: the lead bytes of
#: the characters U+0085, U+00A0, U+1680, U+2000 to U+205F and U+3000 are left out whole.
_START = np.zeros(256, bool)
_START[33:127] = _START[0xC3:0xF5] = True
_START[[ord("<"), 0xE1, 0xE2, 0xE3]] = False


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Marks before which a piece ends if a letter is there: not the apostrophe of contractions.
_MARK = np.zeros(256, bool)
_MARK[[b for b in string.punctuation.encode() if b not in b"'<"]] = True


def agreement_points(raw: np.ndarray) -> np.ndarray:
    return np.flatnonzero(_SPACE[raw[:-1]] & _START[raw[1:]])


def piece_starts(raw: np.ndarray) -> np.ndarray:
    """Agreement points, and marks after a letter, where a piece ends just as surely in a
    text without special tokens."""
    here = _SPACE[raw[:-1]] & _START[raw[1:]]
    here[1:] |= _LETTER[raw[:-2]] & _MARK[raw[1:-1]]
    if _LETTER[raw[-2]] and _MARK[raw[-1]]:
        return np.append(np.flatnonzero(here), len(raw) - 1)
    return np.flatnonzero(here)


def chunk_ends(raw: np.ndarray) -> np.ndarray:
    """Where the chunks of a text end: before a byte that starts a character, where the
    rolling hash of the 32 bytes up to it says so; the last end is the text's."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):       # after each, h covers twice as many bytes
        h[step:] += h[:-step] << np.uint32(step)
    # the low bits depend on the last few bytes only, so the highest decide
    cut = h < np.uint32(1 << (32 - CHUNK_BITS))
    at = np.flatnonzero(cut[:-1] & (raw[1:] & 0xC0 != 0x80)) + 1
    return np.append(at, len(raw))


def chunks(text: bytes) -> list[tuple[bytes, int, int, int]]:
    """(digest, start, first agreement point, last agreement point) of each chunk that has
    two points; positions are the text's."""
    if len(text) < 4:
        return []
    raw = np.frombuffer(text, np.uint8)
    ends, points = chunk_ends(raw), agreement_points(raw)
    starts = np.r_[0, ends[:-1]]
    low, high = np.searchsorted(points, starts), np.searchsorted(points, ends - 1)
    out = []
    for s, e, a, b in zip(starts.tolist(), ends.tolist(), low.tolist(), high.tolist()):
        if b - a >= 2:
            out.append((hashlib.blake2b(text[s:e], digest_size=16).digest(), s, int(points[a]), int(points[b - 1])))
    return out


def _slot(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "little") & ((1 << prefilter.BITS) - 1)


#: The tokenizer's alphabet stands for bytes: a printable byte for itself, the others in
#: order from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


@functools.cache
def _tokenizer(tokenizer_file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file)
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """Ids of texts as bytes.  A text is cut where pieces surely begin, and a piece's ids are
    remembered for the task.  A Latin word goes straight to the tokenizer's merges.  A text
    that holds the string of a special token goes through the whole tokenizer."""

    def __init__(self, tokenizer_file: str):
        self.tokenizer = _tokenizer(tokenizer_file)
        self.merge = self.tokenizer.model.tokenize
        self.code, self.dtype = ("H", np.uint16) if self.tokenizer.get_vocab_size() < 65536 else ("I", np.uint32)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()

    @staticmethod
    def _latin(piece: bytes) -> bool:
        word = piece[1:] if piece[:1] == b" " else piece
        if word.isascii():
            return word.isalpha()
        text = word.decode()
        return text.isalpha() and max(text) < "\u0250"

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        cut = []
        for text in texts:
            if any(s in text for s in self.special):
                cut.append([text])
                continue
            at = [0, *(piece_starts(np.frombuffer(text, np.uint8)).tolist() if len(text) > 1 else []), len(text)]
            cut.append([text[a:b] for a, b in zip(at, at[1:]) if a < b])
        others = []
        for piece in set().union(*cut).difference(self.known):
            if self._latin(piece):
                self.known[piece] = self._bytes([t.id for t in self.merge(piece.decode("latin-1").translate(_ALPHABET))])
            else:
                others.append(piece)
        for k in range(0, len(others), 4096):
            some = others[k:k + 4096]
            made = self.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)
            self.known.update(zip(some, (self._bytes(e.ids) for e in made)))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]


@functools.cache
def _byte_table(tokenizer_file: str) -> list[bytes]:
    """The bytes of each id."""
    byte_of = {chr(c): b for b, c in _ALPHABET.items()}
    t = _tokenizer(tokenizer_file)
    names = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
    return [bytes(byte_of[c] for c in n) if all(c in byte_of for c in n) else n.encode() for n in names]


def decode(ids: np.ndarray, tokenizer_file: str) -> str:
    """The text of a run of ids, special tokens included."""
    return b"".join(map(_byte_table(tokenizer_file).__getitem__, ids.tolist())).decode("utf-8", "replace")


def _rows(docs: DataFrame) -> DataFrame:
    """group, doc, text: rows go to groups by a hash of the id and the text."""
    groups = GROUPS * partitions(docs.sparkSession)
    return small_batches(docs).select(
        F.pmod(F.xxhash64(doc_key(), "text"), F.lit(groups)).cast("int").alias("group"), doc_key().alias("doc"), "text")


def _seen(rows: DataFrame) -> np.ndarray:
    """The filter of the digests that two rows or more hold."""
    def run(batches):
        held: dict[bytes, int] = {}

        def send():
            return pa.RecordBatch.from_arrays(
                [pa.array([_slot(d) for d in held], pa.int64()), pa.array(list(held), pa.binary()),
                 pa.array(list(held.values()), pa.int64())], ["slot", "digest", "n"])
        for b in batches:
            for text in each_text(b.column("text")):
                for d in {c[0] for c in chunks(text)}:
                    held[d] = held.get(d, 0) + 1
            if len(held) > HELD:
                yield send()
                held = {}
        yield send()
    counts = rows.select("text").mapInArrow(run, "slot long, digest binary, n long")
    return prefilter.bitmap(counts.groupBy("slot", "digest").agg(F.sum("n").alias("n")).where("n > 1").select("slot"))


def _shared(text: bytes, bits: np.ndarray) -> list[tuple[bytes, int, int, int]]:
    found = chunks(text)
    if not found:
        return []
    passed = prefilter.has(bits, np.array([_slot(c[0]) for c in found], np.int64))
    return [c for c, ok in zip(found, passed.tolist()) if ok]


def _requests(rows: DataFrame, shared) -> DataFrame:
    """(digest, group, core): a core (the chunk's text from its first to its last agreement
    point, with no group) once a task, and the groups that ask for the digest."""
    def run(batches):
        sent: set[bytes] = set()
        asked: set[tuple[bytes, int]] = set()
        for b in batches:
            out = []
            for group, text in zip(b.column("group").to_pylist(), each_text(b.column("text"))):
                for d, _, first, last in _shared(text, shared.value):
                    if d not in sent:
                        sent.add(d)
                        out.append((d, None, text[first:last]))
                    if (d, group) not in asked:
                        asked.add((d, group))
                        out.append((d, group, None))
            if len(sent) + len(asked) > HELD:
                sent, asked = set(), set()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.binary()))],
                ["digest", "group", "core"])
    return rows.select("group", "text").mapInArrow(run, "digest binary, group int, core binary")


def _answers(requests: DataFrame, tokenizer_file: str) -> DataFrame:
    """(group, digest, ids): each digest's core is encoded once, in the task that owns it."""
    def run(batches):
        encode, digest, ids, group = Encoder(tokenizer_file), None, b"", None
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("digest", "group", "core"))))
            fresh, last = [], digest
            for d, _, core in rows:         # cores come before the groups of their digest
                if d != last:
                    fresh.append((d, core))
                    last = d
            made = dict(zip((d for d, _ in fresh), encode([c for _, c in fresh])))
            out = []
            for d, g, _ in rows:
                if d != digest:
                    digest, ids, group = d, made[d], None
                if g is not None and g != group:
                    group = g
                    out.append((g, d, ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                ["group", "digest", "ids"])
    return requests.repartition(partitions(requests.sparkSession), "digest") \
        .sortWithinPartitions("digest", F.col("group").asc_nulls_first()) \
        .mapInArrow(run, "group int, digest binary, ids binary")


def _bodies(rows: DataFrame, shared, tokenizer_file: str) -> DataFrame:
    """(group, doc, ids, at, refs): the ids of what no shared chunk gives, and where, in
    bytes of ids, the chunks of the digests ``refs`` come in."""
    def run(batches):
        encode = Encoder(tokenizer_file)
        for b in batches:
            group, doc = b.column("group"), b.column("doc")
            at, refs, windows, cuts = [], [], [], [0]
            for text in each_text(b.column("text")):
                here, start = [], 0
                for d, _, first, last in _shared(text, shared.value):
                    windows.append(text[start:first])
                    here.append(d)
                    start = last
                windows.append(text[start:])
                cuts.append(len(windows))
                refs.append(b"".join(here))
            made = encode(windows)
            ids = []
            for x, y in zip(cuts, cuts[1:]):
                parts = made[x:y]
                at.append(np.cumsum([len(p) for p in parts[:-1]]).tolist())
                ids.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [group, doc, pa.array(ids, pa.binary()), pa.array(at, pa.list_(pa.int64())), pa.array(refs, pa.binary())],
                ["group", "doc", "ids", "at", "refs"])
    return rows.mapInArrow(run, "group int, doc long, ids binary, at array<long>, refs binary")


def _assembled(docs: DataFrame, tokenizer_file: str, of: Callable[[bytes, type], tuple],
               fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """doc_id and ``of(ids, dtype)`` of every row of ``docs``."""
    rows = _rows(docs)
    shared = docs.sparkSession.sparkContext.broadcast(_seen(rows))      # 2 ** BITS bits
    answers = _answers(_requests(rows, shared), tokenizer_file).select(
        "group", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("doc"), "ids",
        F.lit(None).cast("array<long>").alias("at"), F.col("digest").alias("refs"))
    bodies = _bodies(rows, shared, tokenizer_file).select("group", F.lit(1).alias("kind"), "doc", "ids", "at", "refs")

    def run(batches):
        dtype, group, known = Encoder(tokenizer_file).dtype, None, {}
        for b in batches:
            out: list[list] = [[] for _ in range(len(fields) + 1)]
            for g, kind, doc, ids, at, refs in zip(*(b.column(c).to_pylist() for c in
                                                     ("group", "kind", "doc", "ids", "at", "refs"))):
                if g != group:
                    group, known = g, {}
                if kind == 0:
                    known[refs] = ids
                    continue
                if at:
                    parts, start = [], 0
                    for k, p in enumerate(at):
                        parts += ids[start:p], known[refs[16 * k:16 * k + 16]]
                        start = p
                    ids = b"".join([*parts, ids[start:]])
                for column, value in zip(out, (doc, *of(ids, dtype))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(out[1:], fields))],
                ["doc", *(n for n, _ in fields)])
    return answers.unionByName(bodies).repartition(partitions(docs.sparkSession), "group") \
        .sortWithinPartitions("group", "kind").mapInArrow(run, f"doc long, {schema}") \
        .select(from_key("doc").alias("doc_id"), *(n for n, _ in fields))


def encode_documents(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs``."""
    return _assembled(docs, tokenizer_file, lambda ids, t: (np.frombuffer(ids, t).astype(np.int32),),
                      [("ids", pa.list_(pa.int32()))], "ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, text) from the rows of ``encode_documents``."""
    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            texts = [decode(np.array(i or [], np.int64), tokenizer_file) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text they decode to."""
    def of(ids: bytes, dtype) -> tuple:
        numbers = np.frombuffer(ids, dtype)
        return (len(numbers), hashlib.sha256(",".join(map(str, numbers.tolist())).encode()).hexdigest(),
                hashlib.sha256(decode(numbers, tokenizer_file).encode()).hexdigest())
    return _assembled(docs, tokenizer_file, of,
                      [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())],
                      "n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op11_chunk_tokens(spark, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), tokenizer_path())
