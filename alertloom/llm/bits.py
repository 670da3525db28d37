"""A bit filter of 64-bit hashes: it lets pass all hashes it was made from, and few others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sixteen bits a value, from 2^20 to 2^28 bits (128 kB to 32 MB): one made of more than some 30 million values lets more pass, which only costs time.
LEAST, MOST = 20, 28
_HIGH = 32


def build(hashes: DataFrame) -> np.ndarray:
    """Two bits for each value of the column ``hash`` (long); at most 2^(MOST - 6) pairs of numbers reach the driver."""
    size = min(MOST, max(LEAST, (16 * hashes.count()).bit_length()))
    places = F.array(*(F.shiftrightunsigned("hash", s).bitwiseAND(F.lit((1 << size) - 1)) for s in (0, _HIGH)))
    words = hashes.select(F.explode(places).alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
    made = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("value")).toArrow()
    out = np.zeros(1 << (size - 6), np.int64)
    out[made.column("word").to_numpy()] = made.column("value").to_numpy()
    return out.view(np.uint8)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (uint64) may be in the filter."""
    mask = np.uint64(8 * len(bits) - 1)
    ok = np.ones(len(hashes), bool)
    for s in (0, _HIGH):
        at = (hashes >> np.uint64(s)) & mask
        ok &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return ok


def holds(bits: np.ndarray, value: int) -> bool:
    """``passes`` of one hash."""
    mask = 8 * len(bits) - 1
    return all((int(bits[(p := (value >> s) & mask) >> 3]) >> (p & 7)) & 1 for s in (0, _HIGH))
