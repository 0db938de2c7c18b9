"""A set filter of fixed size over the ids of a DataFrame.

The filter never grows with the data, so it can be broadcast whatever the number of ids: too
many ids only make it let more rows through, which a later exact join removes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import splitmix

#: 2**24 bits: 2 MB.
LOG_BITS = 24
_HASHES = 3


def _bits(ids: np.ndarray, log_bits: int) -> np.ndarray:
    h = splitmix(ids.astype(np.uint64))
    with np.errstate(over="ignore"):
        return np.stack([splitmix(h + np.uint64(i)) >> np.uint64(64 - log_bits) for i in range(_HASHES)])


def build(ids: DataFrame, column: str, log_bits: int = LOG_BITS) -> np.ndarray:
    """The filter's words, from all ids: 64-bit words are or-ed before and after the shuffle."""

    def to_words(batches):
        for batch in batches:
            b = np.unique(_bits(np.asarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64), log_bits))
            if not len(b):
                continue
            at = (b >> np.uint64(6)).astype(np.int64)
            bit = np.left_shift(np.uint64(1), b & np.uint64(63))
            first = np.flatnonzero(np.append(True, np.diff(at) != 0))
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64))], ["at", "bits"])

    rows = ids.select(F.col(column).cast("long").alias("id")).where("id is not null").mapInArrow(to_words, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(1 << (log_bits - 6), np.uint64)
    table = rows.toArrow()  # at most 2**(log_bits - 6) rows
    if table.num_rows:
        words[table["at"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return words


def test(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the set; none that is in it is refused."""
    log_bits = len(words).bit_length() - 1 + 6
    ok = np.ones(len(ids), bool)
    for b in _bits(ids, log_bits):
        ok &= (words[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1
    return ok
