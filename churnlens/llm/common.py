"""Pieces shared by the corpus operators.

Words are runs of ``[^\\x20\\x09-\\x0D]``; ``bytes.split()`` cuts at exactly those
bytes, so tasks work on the UTF-8 bytes of a text.  Inputs are read by column
name, so further columns of any name are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Stands for a null doc_id inside the operators: below every other id.
NO_ID = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of an Arrow batch between the JVM and Python, and of text copied out of it at a time.
PIECE = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches by PIECE (a smaller bound stays): texts can be
    long, and a task holds a batch several times over in the JVM and in Python."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH).rstrip("b")
    if now.isdigit() and int(now) > PIECE:
        conf.set(_BATCH, f"{PIECE}b")
    return df


def each_text(column: pa.Array):
    """The UTF-8 bytes of each text; null is empty.  Texts are copied out of a large batch
    piece by piece."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    piece = (np.cumsum(sizes) - sizes) // PIECE
    cuts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(column) else []
    for s, e in zip(cuts, np.r_[cuts[1:], len(column)] if len(column) else []):
        for b in column.slice(s, e - s).cast(pa.binary()).to_pylist():
            yield b or b""
    pa.default_memory_pool().release_unused()


def doc_key(name: str = "doc_id") -> Column:
    """doc_id as a long that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def from_key(name: str = "doc_id") -> Column:
    """The inverse of ``doc_key``."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(name: str = "doc_id") -> Column:
    """True for the fold that no model may learn from (crc32 of the id mod 4 is 2).
    A null id is in no fold: not held out, and never learned from."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 4 == 2, F.lit(False))


def join_small(df: DataFrame, small: DataFrame, key: str, salt: Column,
               max_rows: int = 20_000, salts: int = 32) -> DataFrame:
    """Left join of ``df`` with one row per key.  ``small`` is broadcast after its
    rows were counted (at most ``max_rows``); beyond that it is joined on the key
    and a salt, so a key with a third of all rows is spread over ``salts`` tasks.
    A null key matches the null row."""
    small = settle(small).withColumnRenamed(key, "_key")
    if small.limit(max_rows + 1).count() <= max_rows:
        return df.join(F.broadcast(small), df[key].eqNullSafe(F.col("_key")), "left").drop("_key")
    spread = small.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    df = df.withColumn("_t", F.pmod(salt, F.lit(salts)).cast("int"))
    return df.join(spread, df[key].eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_s")), "left") \
        .drop("_key", "_s", "_t")
