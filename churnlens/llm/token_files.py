"""Token-ID files with a shared zstandard dictionary (operator 6).

A text becomes token ids and an end id, serialized as little-endian unsigned 32-bit
integers.  A zstandard dictionary is trained on the serialized ids of a bounded sample
(``SAMPLE`` documents with the smallest id hashes); every document is then a zstandard
frame of its own under that dictionary, so one short document can be read without its
neighbours.

The files, under one folder, are Parquet so that any store that Spark writes to holds them:

* ``dictionary``: one row, its sha256 and its bytes;
* ``packs``: rows in ascending doc_id order, by (part, base): the frames of some
  documents end to end, with the doc_ids, the frames' byte offsets (one more than
  documents), the token counts, the pack's first token within its part and the
  dictionary's hash;
* ``parts``: the first token of each part.

Texts are encoded where they are scanned and only compressed ids are shuffled.

Cases: a null or empty text is the end id alone; rows that share a doc_id follow each
other in the order of their frames; a null doc_id comes first; an empty table gives
empty files, under an empty dictionary (where the sample is too small or too uniform to
train one, the dictionary is the sample's own bytes).
"""

from __future__ import annotations

import array
import functools
import hashlib
import string
import unicodedata
import zlib
from collections.abc import Iterable

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_key, documents, each_text, from_key, partitions, scratch_path, small_batches

#: Documents that the dictionary is trained on, and its size in bytes.
SAMPLE, DICTIONARY = 1000, 65536
#: Bytes of frames and documents after which a pack ends.
PACK_BYTES, PACK_DOCS = 1 << 20, 4096
#: Words whose ids a task remembers.
CACHE = 400_000
LEVEL = 3


#: The byte-level alphabet of the tokenizer: a printable byte stands for itself, the
#: others for the characters from 256 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b if b in _PRINTABLE else 256 + k for k, b in
             enumerate(sorted(range(256), key=lambda b: (b in _PRINTABLE, b)))}
_PUNCTUATION = string.punctuation.encode()


class Encoder:
    """Token ids of whole texts as bytes.

    The tokenizer never joins what white space parts, lower-cases, and parts letters from
    marks.  So a text is looked up word by word, each word is encoded once, and a word that
    is Latin letters followed by marks goes as letters straight to the tokenizer's merges.
    Other words, and texts that may hold a special token, go through the whole tokenizer.
    The ids of known words are the task's: they go when it ends."""

    def __init__(self, tokenizer_file: str, end_id: int):
        self.tokenizer = _tokenizer(tokenizer_file)
        self.merge = self.tokenizer.model.tokenize
        self.end = array.array("I", [end_id]).tobytes()
        self.known: dict[bytes, bytes] = {}

    def _whole(self, raw: bytes) -> bytes:
        return array.array("I", self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        """The ids of a word whose ASCII letters are lower-cased."""
        letters = word.rstrip(_PUNCTUATION)
        if not (letters.isalpha() or self._latin(letters)):
            return self._whole(word)
        ids = self.known.get(letters)
        if ids is None:
            text = letters.decode("latin-1").translate(_ALPHABET)
            ids = self.known[letters] = array.array("I", [t.id for t in self.merge(text)]).tobytes()
        return ids if letters == word else ids + self._part(word[len(letters):])

    @staticmethod
    def _latin(word: bytes) -> bool:
        text = word.decode()
        return text.isalpha() and max(text) < "\u0250" and text == text.lower() and unicodedata.is_normalized("NFC", text)

    def _part(self, word: bytes) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.known[word] = self._word(word)
        return ids

    def __call__(self, raws: list[bytes]) -> list[bytes]:
        out = []
        for raw in raws:
            if b"<|" in raw:
                out.append(self._whole(raw) + self.end)
                continue
            if len(self.known) > CACHE:
                self.known.clear()
            words, known = raw.lower().split(), self.known
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            out.append(b"".join([known[w] for w in words]) + self.end)
        return out


@functools.cache
def _tokenizer(tokenizer_file: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_file)


def _chunks(raws: Iterable[bytes], limit: int = 4 << 20):
    """Runs of texts of about ``limit`` bytes."""
    held, size = [], 0
    for r in raws:
        held.append(r)
        size += len(r)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def train_dictionary(docs: DataFrame, tokenizer_file: str, end_id: int) -> bytes:
    """A dictionary from at most ``SAMPLE`` documents, each cut after 64 KB of ids."""
    def ids(batches):
        encode = Encoder(tokenizer_file, end_id)
        for b in batches:
            for raws in _chunks(each_text(b.column("text"))):
                yield pa.RecordBatch.from_arrays([pa.array([x[:65536] for x in encode(raws)], pa.binary())], ["ids"])
    keys = docs.select(doc_key().alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    rows = docs.select(doc_key().alias("k"), "text").join(F.broadcast(keys), "k", "left_semi") \
        .orderBy(F.xxhash64("k"), F.xxhash64("text")).limit(SAMPLE) \
        .select("text").mapInArrow(ids, "ids binary").collect()
    samples = [bytes(r["ids"]) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


def _dictionary(raw: bytes, level: int | None = None) -> zstandard.ZstdCompressionDict | None:
    """The dictionary, digested once for compression where a level is given."""
    if not raw:
        return None
    d = zstandard.ZstdCompressionDict(raw)
    if level is not None:
        d.precompute_compress(level=level)
    return d


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2) -> None:
    """Encode every row of ``docs`` and write the files into the folder ``path``."""
    spark = small_batches(docs).sparkSession
    raw_dict = train_dictionary(docs, tokenizer_file, end_id)
    digest = hashlib.sha256(raw_dict).hexdigest()
    spark.createDataFrame([(digest, raw_dict)], "sha256 string, dictionary binary").coalesce(1) \
        .write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(raw_dict)      # at most DICTIONARY bytes

    def encode(batches):
        to_ids = Encoder(tokenizer_file, end_id)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value, LEVEL))
        for b in batches:
            doc, at = b.column("doc"), 0
            for raws in _chunks(each_text(b.column("text"))):
                ids = to_ids(raws)
                yield pa.RecordBatch.from_arrays(
                    [doc[at:at + len(raws)], pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([pack.compress(x) for x in ids], pa.binary())], ["doc", "n_tokens", "frame"])
                at += len(raws)

    def packs(batches):
        part, base = TaskContext.get().partitionId(), 0
        docs_, sizes, frames, held = [], [], [], 0

        def row():
            offsets = [0]
            for f in frames:
                offsets.append(offsets[-1] + len(f))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([base], pa.int64()), pa.array([docs_], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                 pa.array([b"".join(frames)], pa.binary()), pa.array([digest])],
                ["part", "base", "doc_ids", "n_tokens", "offsets", "frames", "dictionary"])
        for b in batches:
            for doc, n, frame in zip(*(b.column(c).to_pylist() for c in ("doc", "n_tokens", "frame"))):
                docs_.append(doc)
                sizes.append(n)
                frames.append(frame)
                held += len(frame)
                if held >= PACK_BYTES or len(docs_) >= PACK_DOCS:
                    yield row()
                    base += sum(sizes)
                    docs_, sizes, frames, held = [], [], [], 0
        if docs_:
            yield row()

    # written once, as choosing the ranges and dealing the rows both read it
    frames = f"{path}/_frames"
    docs.select(doc_key().alias("doc"), "text").mapInArrow(encode, "doc long, n_tokens long, frame binary") \
        .write.parquet(frames)
    spark.read.parquet(frames).repartitionByRange(partitions(spark), "doc").sortWithinPartitions("doc", "frame") \
        .mapInArrow(packs, "part int, base long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, "
                           "frames binary, dictionary string").write.parquet(f"{path}/packs")
    ends = spark.read.parquet(f"{path}/packs").groupBy("part").agg(
        F.max(F.col("base") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row a part
    ends.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_token"), "n") \
        .coalesce(1).write.parquet(f"{path}/parts")


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, object]:
    """The packs with ``first_token`` and the dictionary, whose hash is checked."""
    held = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(held["dictionary"]).hexdigest() != held["sha256"]:
        raise ValueError("the dictionary does not have the hash that its file states")
    parts = spark.read.parquet(f"{path}/parts").select("part", "first_token")
    packs = spark.read.parquet(f"{path}/packs").where(F.col("dictionary") == held["sha256"])
    return packs.join(F.broadcast(parts), "part"), spark.sparkContext.broadcast(bytes(held["dictionary"]))


def _read(packs: DataFrame, shared, only: int | None, fields: str, of) -> DataFrame:
    def run(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value))
        for b in batches:
            for first, base, docs, sizes, offsets, frames in zip(*(b.column(c).to_pylist() for c in (
                    "first_token", "base", "doc_ids", "n_tokens", "offsets", "frames"))):
                start, out = first + base, []
                for k, (doc, n) in enumerate(zip(docs, sizes)):
                    if only is None or doc == only:
                        out.append({"doc": doc, "start": start, "n_tokens": n}
                                   | of(unpack.decompress(frames[offsets[k]:offsets[k + 1]])))
                    start += n
                if out:
                    yield pa.RecordBatch.from_pylist(out, _ARROW[fields])
    return packs.mapInArrow(run, f"doc long, start long, n_tokens long, {fields}") \
        .withColumn("doc", from_key("doc")).withColumnRenamed("doc", "doc_id")


_HEAD = [("doc", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]
_ARROW = {"tokens array<long>": pa.schema([*_HEAD, ("tokens", pa.list_(pa.int64()))]),
          "ids_crc32 long": pa.schema([*_HEAD, ("ids_crc32", pa.int64())])}


def read_tokens(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) from the files; of one document alone where an
    id is given: only packs that list it are opened, and only its frame is unpacked."""
    packs, shared = _opened(spark, path)
    if doc_id is not None:
        packs = packs.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    return _read(packs, shared, doc_id, "tokens array<long>",
                 lambda ids: {"tokens": array.array("I", ids).tolist()})


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    packs, shared = _opened(spark, path)
    return _read(packs, shared, None, "ids_crc32 long", lambda ids: {"ids_crc32": zlib.crc32(ids)})


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def token_digests(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and read their digests back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path())
    return read_digests(docs.sparkSession, path)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))
