"""Which 64-bit keys occur more than once: packed, collapsed and counted by bucket.

Keys go to buckets by their top bits; in a bucket, 31 more bits stand for the key. Equal keys
of a task are collapsed before the shuffle (to two, if there are several), so that a key that
a third of all rows has is few entries. A bucket answers with its own region of a filter of
fixed size. The filter may let other keys through, but no repeated one is refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import splitmix

#: Bits of the filter: 8 MB, whatever the input.
LOG_FILTER = 26
#: Keys held before they are sorted and sent on.
FLUSH = 1 << 20

_REST = np.uint64(31)
_HASHES = 3


def power_of_two(x: float, low: int, high: int) -> int:
    return min(max(1 << max(int(x) - 1, 0).bit_length(), low), high)


def input_bytes(df: DataFrame, text_col: str = "text") -> float:
    """Bytes of the files that a table reads; of a table without files, those of its texts.

    Only speed may depend on it.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(float(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if size < 1 << 60:  # Spark's own stand-in for an unknown size is above
        return size
    return float(df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def short_keys(keys: np.ndarray, log_buckets: int) -> np.ndarray:
    """The bits of bucket and rest of 64-bit keys."""
    return keys >> (np.uint64(64 - log_buckets) - _REST)


class Sender:
    """Collects short keys, each with a flag, and packs them by bucket.

    A flagged key only counts as repeated if an unflagged one equals it.
    """

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, flags: np.ndarray | None = None) -> bool:
        """Whether it is time to flush."""
        v = keys << np.uint64(1)
        self.held.append(v if flags is None else v | flags.astype(np.uint64))
        self.size += len(keys)
        return self.size >= FLUSH

    def flush(self) -> pa.RecordBatch:
        v = np.sort(np.concatenate(self.held))
        self.held, self.size = [], 0
        key = v >> np.uint64(1)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.diff(np.append(first, len(v))) > 1
        # One of each key, an unflagged one if there is any, and one more where there were several.
        out = np.sort(np.concatenate((v[first], v[first][several] | np.uint64(1))))
        bucket = (out >> (_REST + np.uint64(1))).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        low = out.astype(np.uint32)
        payload = [low[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(low)])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(payload, pa.binary())], ["bucket", "payload"])


SENT = "bucket long, payload binary"


def _region_bits(keys: np.ndarray, log_region: int) -> np.ndarray:
    h = splitmix(keys.astype(np.uint64))
    return np.stack([(h >> np.uint64(20 * i)) & np.uint64((1 << log_region) - 1) for i in range(_HASHES)])


def _region(bits: np.ndarray, log_region: int) -> bytes:
    flags = np.zeros(1 << log_region, np.uint8)
    flags[bits.ravel().astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _find_hits(log_region: int):
    def find(key: tuple, table: pa.Table) -> pa.Table:
        v = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in table["payload"].to_pylist()]))
        rest = v >> np.uint32(1)
        first = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
        hit = (np.diff(np.append(first, len(v))) > 1) & (v[first] & np.uint32(1) == 0)
        bits = _region_bits(rest[first][hit], log_region)
        return pa.table({"bucket": [key[0].as_py()], "region": pa.array([_region(bits, log_region) if bits.size else b""], pa.binary())})

    return find


def collect(sent: DataFrame, n_buckets: int) -> np.ndarray:
    """The filter's bits, bucket by bucket, from all packed keys (``SENT``)."""
    log_region = max(LOG_FILTER - (n_buckets.bit_length() - 1), 6)
    table = sent.groupBy("bucket").applyInArrow(_find_hits(log_region), "bucket long, region binary").where("length(region) > 0").toArrow()
    out = np.zeros((n_buckets, (1 << log_region) // 8), np.uint8)
    for b, region in zip(table["bucket"].to_pylist(), table["region"].to_pylist()):
        out[b] = np.frombuffer(region, np.uint8)
    return out


class Tally:
    """Collects short keys and packs them by bucket, each once with how often it came (255 at most)."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> bool:
        """Whether it is time to flush."""
        self.held.append(keys)
        self.size += len(keys)
        return self.size >= FLUSH

    def flush(self) -> pa.RecordBatch:
        v, n = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        bucket = (v >> _REST).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        low, n = (v & np.uint64((1 << 31) - 1)).astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
        ends = [*cuts[1:].tolist(), len(v)]
        payload, counts = ([x[a:b].tobytes() for a, b in zip(cuts.tolist(), ends)] for x in (low, n))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(payload, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "payload", "counts"])


TALLIED = "bucket long, payload binary, counts binary"


def tally(sent: DataFrame, n_buckets: int, often: int) -> tuple[np.ndarray, np.ndarray]:
    """Two filters, bucket by bucket, from all packed keys (``TALLIED``): of those that came more
    than once, and of those that came more than ``often`` times (255 at most)."""
    log_region = max(LOG_FILTER - (n_buckets.bit_length() - 1), 6)

    def find(key: tuple, table: pa.Table) -> pa.Table:
        rest = np.concatenate([np.frombuffer(x, np.uint32) for x in table["payload"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in table["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(rest)
        rest, n = rest[order], n[order]
        first = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
        total, rest = np.add.reduceat(n, first), rest[first]
        regions = [_region_bits(rest[total > least], log_region) for least in (1, often)]
        return pa.table({"bucket": [key[0].as_py()], **{k: pa.array([_region(b, log_region) if b.size else b""], pa.binary()) for k, b in zip(("twice", "often"), regions)}})

    table = sent.groupBy("bucket").applyInArrow(find, "bucket long, twice binary, often binary").where("length(twice) > 0").toArrow()
    out = tuple(np.zeros((n_buckets, (1 << log_region) // 8), np.uint8) for _ in range(2))
    for filter_, name in zip(out, ("twice", "often")):
        for b, region in zip(table["bucket"].to_pylist(), table[name].to_pylist()):
            if region:
                filter_[b] = np.frombuffer(region, np.uint8)
    return out


def is_hit(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    log_region = (filter_.shape[1] * 8).bit_length() - 1
    bucket = (keys >> _REST).astype(np.int64)
    flat = filter_.ravel()
    ok = np.ones(len(keys), bool)
    for bits in _region_bits(keys & np.uint64((1 << 31) - 1), log_region):
        at = bucket * filter_.shape[1] + (bits >> np.uint64(3)).astype(np.int64)
        ok &= (flat[at] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok
