"""A fixed-size set summary that is small enough to send to every task.

The bitmap has ``2 ** BITS`` bits, or as many as asked for, whatever the number of values, so its size is proven.
It only lets values pass: a fuller bitmap passes more that a later join drops again,
it never loses one.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

BITS = 26


def send_bitmap(values: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """Bitmap of the top bits of a column of 64-bit hashes, at most 8 MB in all unless more ``bits`` are asked for."""
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = (
        values.select((F.shiftright(place, 15)).cast("int").alias("bucket"), place.bitwiseAND(F.lit(32767)).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    )
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for row in rows:
        bitmap[row.bucket * 4096:(row.bucket + 1) * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return values.sparkSession.sparkContext.broadcast(bitmap)


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.uint64) >> np.uint64(64 - len(bitmap).bit_length() + 1 - 3)
    byte = bitmap[(place >> np.uint64(3)).astype(np.int64)]
    return (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
