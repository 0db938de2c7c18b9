"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks; the fingerprint of a chunk is its value as a polynomial over four
prime fields, and the fingerprint of a whole text is combined from those of its chunks:
``f(xy) = f(x) * B**len(y) + f(y)``. Chunks can thus be hashed anywhere and in any order.
Texts with equal fingerprint and length are then compared chunk by chunk, on their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import places
from tessera.llm.kernel import strings, tidy, turn_to
from tessera.llm.places import FILE, ROW

#: Bytes of a chunk. Sums of 2**16 products below 2**39 stay below 2**55.
CHUNK = 1 << 16
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1_103_515_245, 1_664_525_013, 1_597_334_677, 1_812_433_253)

_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def _powers(base: int, prime: int) -> np.ndarray:
    p = np.empty(CHUNK, np.uint64)
    x = 1
    for i in range(CHUNK):
        p[CHUNK - 1 - i] = x
        x = x * base % prime
    return p


_POWERS: list[np.ndarray] = []


def chunk_fingerprint(data: bytes) -> tuple[int, ...]:
    """Of at most CHUNK bytes: sum of (byte + 1) * B**(bytes after it), for each field."""
    if not _POWERS:
        _POWERS.extend(_powers(b, p) for b, p in zip(BASES, PRIMES))
    v = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int(v @ w[CHUNK - len(v) :]) % p for w, p in zip(_POWERS, PRIMES))


def combine(left: tuple[int, ...], right: tuple[int, ...], right_length: int) -> tuple[int, ...]:
    """The fingerprint of two texts in a row, from theirs and the second one's length."""
    return tuple((x * pow(b, right_length, p) + y) % p for x, y, b, p in zip(left, right, BASES, PRIMES))


def fingerprint(data: bytes) -> tuple[int, ...]:
    """Of any number of bytes, chunk by chunk."""
    f = (0,) * len(PRIMES)
    for a in range(0, len(data), CHUNK):
        part = data[a : a + CHUNK]
        f = combine(f, chunk_fingerprint(part), len(part))
    return f


@tidy
def _fingerprints(batches):
    """id, text and what else a row carries, to the fingerprint, the length and the hash of the text."""
    turn_to("exact_dedup")
    for batch in batches:
        data, offsets = strings(batch.column(1))
        hi, lo, size, sha = [], [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            x = data[a:b].tobytes().translate(_TO_LOWER)
            f = fingerprint(x)
            hi.append(f[0] << 31 | f[1])
            lo.append(f[2] << 31 | f[3])
            size.append(len(x))
            sha.append(hashlib.sha256(x).hexdigest())
        rest = batch.columns[2:]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string()), *rest], ["id", "f1", "f2", "size", "sha", *batch.schema.names[2:]])


@tidy
def _chunks(batches, length: int):
    """The chunks of each text, with its key."""
    for batch in batches:
        data, offsets = strings(batch.column(1))
        out = {k: [] for k in ("f1", "f2", "size", "no", "chunk")}
        held = 0
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            x = data[a:b].tobytes().translate(_TO_LOWER)
            f = fingerprint(x)
            f1, f2 = f[0] << 31 | f[1], f[2] << 31 | f[3]
            for no, at in enumerate(range(0, max(len(x), 1), length)):
                for k, v in zip(out, (f1, f2, len(x), no, x[at : at + length])):
                    out[k].append(v)
                held += min(len(x), length)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pydict(out, _CHUNK_SCHEMA)
                    out, held = {k: [] for k in out}, 0
        if out["no"]:
            yield pa.RecordBatch.from_pydict(out, _CHUNK_SCHEMA)


_CHUNK_SCHEMA = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("size", pa.int64()), ("no", pa.int64()), ("chunk", pa.binary())])
_KEY = ["f1", "f2", "size"]


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, sha, keep_id, group_size and place of each row of a located DataFrame."""
    spark = docs.sparkSession
    session.ship_code(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *places.PLACE)
    prints = session.materialize(source.mapInArrow(_fingerprints, f"id long, f1 long, f2 long, size long, sha string, {FILE} long, {ROW} long"), "prints")
    sizes = session.materialize(prints.groupBy(*_KEY).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    joined = prints.join(sizes, _KEY)

    # Compare: within a group, every chunk must have one value; equal chunks collapse before the shuffle.
    several = places.Decisions.write(joined.where("group_size > 1").select(*places.PLACE, F.lit(1).alias("number")), docs, 0, text_col)
    chunks = source.mapInArrow(lambda it: _chunks(several.chosen(it), CHUNK), "f1 long, f2 long, size long, no long, chunk binary")
    unequal = chunks.groupBy(*_KEY, "no").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select(*_KEY).distinct()
    unequal = session.materialize(unequal, "unequal")
    if not unequal.isEmpty():  # different texts with one fingerprint: their groups are parted by the texts' SHA-256
        same = prints.join(unequal, _KEY, "left_semi")
        parted = same.join(same.groupBy(*_KEY, "sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), [*_KEY, "sha"])
        joined = joined.join(unequal, _KEY, "left_anti").unionByName(parted)
    return joined.withColumn("kept", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the largest id stays. Rows that repeat an id are rows of their own: each counts in
    group_size, and all that carry the kept id are kept. A null id sorts below any other; if
    a group has none but null ids, its keep_id is null and its rows are kept. An empty table
    gives an empty result. Other columns, whatever they are called, play no part. Texts may be
    of any length: they are hashed and compared chunk by chunk.
    """
    whole = _grouped(places.located(docs), id_col, text_col)
    return whole.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts.

    That of the largest id stays, as in ``groups``; of rows that repeat that id (or of null
    ids, where the group has no other), the one first in file and row. Null and empty texts
    are one group. An empty table stays empty, columns may have any names, and no text is
    shuffled.
    """
    found = places.located(docs)
    several = session.materialize(_grouped(found, id_col, text_col).where("group_size > 1").select(*_KEY, "sha", "kept", *places.PLACE), "several")
    stays = several.where("kept").groupBy(*_KEY, "sha").agg(F.min(F.struct(*places.PLACE)).alias("p")).select("p.*")
    return places.keep(found, several.join(stays, places.PLACE, "left_anti"), text_col).select(*(F.col(f"`{c}`") for c in docs.columns))
