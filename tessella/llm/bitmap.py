"""A bitmap of fixed size over 64-bit keys: most keys outside a set are told at once, whatever the corpus.

A full bitmap tells nothing and costs only the work it would have saved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm import textkit as tk

BITS = 1 << 23


def bitmap(keys: DataFrame) -> np.ndarray:
    """One megabyte with a bit set for each value of the only column (long)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BITS // 8, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) % np.uint64(BITS)
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["map"])

    known = np.zeros(BITS // 8, np.uint8)
    for r in keys.coalesce(8).mapInArrow(tk.freeing(mark), "map binary").collect():  # eight maps at most
        known |= np.frombuffer(r["map"], np.uint8)
    return known


def may_hold(known: np.ndarray, key: int) -> bool:
    at = (key % (1 << 64)) % BITS
    return bool((known[at >> 3] >> (at & 7)) & 1)
