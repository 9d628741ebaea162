"""A filter of fixed size that says which keys may be in a set.

The set can be as large as the corpus; the filter is ``2 ** BITS`` bits (8 MB) whatever
the set's size, so it can be sent to every task.  A key's bit is set if the key is in the
set, so no member is missed; other keys may pass too, and the operators count exactly what
passes.  A fuller filter costs work and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26
#: Bits of one of Spark's bitmaps.
_BITMAP = 32768


def bitmap(slots: DataFrame) -> np.ndarray:
    """The bits of the long column ``slot`` (0 to 2 ** BITS - 1) as bytes, least
    significant first.  At most 2 ** BITS / 32,768 rows of 4 KB reach the driver."""
    place = F.col("slot") + 1        # Spark numbers bitmaps of positive values from 1
    rows = slots.groupBy(F.bitmap_bucket_number(place).alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * (_BITMAP // 8)
        out[at:at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the bit of each slot is set."""
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
