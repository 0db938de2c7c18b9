"""Integer codes: variable bytes and unary, as plain functions and as Arrow-batched columns.

Variable bytes: groups of seven bits, the lowest first; a set top bit says that more follow.
Unary: n is n - 1 ones and a zero; bits fill a byte from its lowest. Parquet's own encodings
serve the index tables; these exist to read and write such streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def vbyte_encode(values: list[int]) -> bytes:
    out = bytearray()
    for v in values:
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def vbyte_decode(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


def vbyte_length(value: Column) -> Column:
    """Bytes of one value."""
    return F.greatest(F.ceil(F.length(F.bin(value)) / 7), F.lit(1)).cast("int")


def _joined(hex_bytes: Column) -> Column:
    return F.unhex(F.array_join(hex_bytes, ""))


def vbyte_bytes(values: Column) -> Column:
    """The code of an array of numbers from 0 on, without leaving the JVM."""

    def groups(v: Column) -> Column:
        last = vbyte_length(v) - 1
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(F.call_function("shiftright", v, i * 7).bitwiseAND(127) + F.when(i < last, 128).otherwise(0)), 2, "0"))

    return _joined(F.flatten(F.transform(values, groups)))


def unary_bytes(values: Column) -> Column:
    """The code of an array of numbers from 1 on, without leaving the JVM."""
    bits = F.array_join(F.transform(values, lambda v: F.concat(F.repeat(F.lit("1"), (v - 1).cast("int")), F.lit("0"))), "")
    size = F.ceil(F.length(bits) / 8).cast("int")
    padded = F.rpad(bits, size * 8, F.lit("0"))
    byte = lambda i: F.lpad(F.conv(F.reverse(F.substring(padded, i * 8 - 7, F.lit(8))), 2, 16), 2, "0")
    return _joined(F.transform(F.sequence(F.lit(1), size), byte))


def unary_encode(values: list[int]) -> bytes:
    bits, n = 0, 0
    for v in values:
        bits |= (1 << v - 1) - 1 << n
        n += v
    return bits.to_bytes((n + 7) // 8, "little")


def unary_decode(data: bytes, bit: int = 0) -> list[int]:
    """All values from a bit on; the zero bits that pad the last byte read as ones (1)."""
    out, run = [], 1
    for i in range(bit, 8 * len(data)):
        if data[i // 8] >> i % 8 & 1:
            run += 1
        else:
            out.append(run)
            run = 1
    return out


def pack_offset(byte: Column, bit: Column) -> Column:
    return F.shiftleft(byte, 3).bitwiseOR(bit)


def unpack_offset(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, 3), packed.bitwiseAND(7)


def common_prefix_length(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _column(function, returns: str):
    def apply(values: Column) -> Column:
        @F.pandas_udf(returns)
        def code(s: pd.Series) -> pd.Series:
            return s.map(lambda v: None if v is None else function(v))

        return code(values)

    return apply


vbyte_encode_column = _column(lambda v: vbyte_encode([int(x) for x in v]), "binary")
vbyte_decode_column = _column(vbyte_decode, "array<bigint>")
unary_encode_column = _column(lambda v: unary_encode([int(x) for x in v]), "binary")
unary_decode_column = _column(unary_decode, "array<bigint>")


# Lists of a whole index: rows come in order of list, and a batch of lists is coded at once.


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def vbyte_encode_lists(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lists, and each list's number of bytes. Numbers below 0 are read as 64 bits."""
    n = np.ones(len(values), np.int64)
    for shift in range(7, 63, 7):
        n += values >> shift > 0
    n[values < 0] = 10
    part = _within(n)
    value = np.repeat(values, n)
    last = np.repeat(n, n) - 1
    data = (value >> np.minimum(7 * part, 63) & 127 | np.where(part < last, 128, 0)).astype(np.uint8)
    ends = np.cumsum(n)[np.cumsum(sizes) - 1]
    return data, np.diff(ends, prepend=0)


def vbyte_decode_lists(data: np.ndarray, n_bytes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Values of all lists; a value never goes over the end of its list."""
    n = np.diff(np.flatnonzero(data < 128), prepend=-1)
    return np.bitwise_or.reduceat((data & 127).astype(np.int64) << 7 * _within(n), np.cumsum(n) - n)


def unary_encode_lists(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(sizes) - sizes
    n_bits = np.add.reduceat(values, starts)
    n_bytes = (n_bits + 7) // 8
    shift = np.repeat(8 * (np.cumsum(n_bytes) - n_bytes) - (np.cumsum(n_bits) - n_bits), sizes)  # what padding moves a list by
    bits = np.ones(8 * n_bytes.sum(), np.uint8)
    bits[np.cumsum(values) + shift - 1] = 0
    pad = 8 * n_bytes - n_bits
    bits[np.repeat(8 * np.cumsum(n_bytes) - pad, pad) + _within(pad)] = 0
    return np.packbits(bits, bitorder="little"), n_bytes


def unary_decode_lists(data: np.ndarray, n_bytes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first ``sizes`` values of each list; what pads its last byte reads as more."""
    zeros = np.flatnonzero(np.unpackbits(data, bitorder="little") == 0)
    starts = 8 * (np.cumsum(n_bytes) - n_bytes)
    at = np.repeat(np.searchsorted(zeros, starts), sizes) + _within(sizes)
    first = np.zeros(len(at), bool)
    first[np.cumsum(sizes) - sizes] = True
    before = np.where(first, np.repeat(starts, sizes) - 1, zeros[at - 1])
    return zeros[at] - before


CODED = "term string, rng long, n_bytes long, code string, decoded string"


def coded_lists(encode: Callable, decode: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (term, rng, value) in order of list: each list's code in hexadecimal
    digits and what it decodes to, ``CODED``."""

    def coded(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(starts, append=rows.num_rows)
        values = rows["value"].to_numpy().astype(np.int64)
        data, n_bytes = encode(values, sizes)
        digits = data.tobytes().hex().upper().encode()
        ends = np.concatenate([[0], np.cumsum(n_bytes)])
        code = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(2 * ends.astype(np.int64)), pa.py_buffer(digits)).cast(pa.string())
        read = pa.array(decode(data, n_bytes, sizes), pa.int64()).cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, rows.num_rows), pa.int32()), read)
        firsts = rows.select(["term", "rng"]).take(pa.array(starts)).combine_chunks()
        columns = [*(pa.concat_arrays(c.chunks) for c in firsts.columns), pa.array(n_bytes, pa.int64()), code, pc.binary_join(lists, ",")]
        return pa.RecordBatch.from_arrays(columns, ["term", "rng", "n_bytes", "code", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the last list, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            starts = _starts(rows)
            if held and _key(held[-1]) == _key(rows) and len(starts) == 1:
                held.append(rows)
                continue
            if held:
                whole = pa.concat_tables([*held, rows.slice(0, starts[-1])])
                yield coded(whole, _starts(whole))
            elif starts[-1]:
                yield coded(rows.slice(0, starts[-1]), starts[:-1])
            held = [rows.slice(starts[-1])]
        if held:
            whole = pa.concat_tables(held)
            yield coded(whole, _starts(whole))

    return run


def _key(rows: pa.Table) -> tuple:
    return rows["term"][0].as_py(), rows["rng"][0].as_py()


def _starts(rows: pa.Table) -> np.ndarray:
    """Where each list begins."""
    n = rows.num_rows - 1
    new = np.zeros(n, bool)
    for c in ("term", "rng"):
        new |= pc.not_equal(rows[c].slice(1), rows[c].slice(0, n)).to_numpy()
    return np.concatenate([[0], np.flatnonzero(new) + 1])


vbyte_lists = coded_lists(vbyte_encode_lists, vbyte_decode_lists)
unary_lists = coded_lists(unary_encode_lists, unary_decode_lists)
