"""A set of 64-bit hashes as one bit array of fixed size, for thinning out rows ahead of an
exact step. It has no false negatives, and its size does not depend on the data: a crowded
array only lets more rows through."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import materialise

BITS = 27               # the array has 2^27 bits, 16 MiB
CHUNK = 18              # and is put together from rows of 2^18 bits


def slots(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def held(array: np.ndarray, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return marked(array, slots(hashes, bits))


def marked(array: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (array[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def collected(rows: DataFrame, bits: int = BITS) -> np.ndarray:
    """The array with the bits that `rows` (slot long) names; at most 2^bits / 8 bytes
    reach the driver, however many rows there are."""
    chunk = min(CHUNK, bits)

    def pack(key, table):
        ones = np.zeros(2 ** chunk, dtype=bool)
        ones[table["slot"].to_numpy() & (2 ** chunk - 1)] = True
        packed = np.packbits(ones, bitorder="little").tobytes()
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()),
                         "bits": pa.array([packed], pa.binary())})

    made = materialise(rows.select("slot").distinct()
                       .groupBy(F.shiftright("slot", chunk).alias("chunk"))
                       .applyInArrow(pack, "chunk long, bits binary"))
    out = np.zeros(2 ** bits // 8, dtype=np.uint8)
    step = 2 ** chunk // 8
    for row in made.toLocalIterator():
        out[row["chunk"] * step:(row["chunk"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return out
