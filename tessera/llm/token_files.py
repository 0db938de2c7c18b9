"""Token ids in shard files with Elias-Fano encoded document boundaries.

A shard holds the documents of one range of ids, in ascending order. Its file:

    ids         one array for all documents, 2 or 4 bytes each, little-endian
    doc ids     8 bytes each; a bitmap says which are null
    boundaries  n + 1 ascending numbers, Elias-Fano: the low bits packed, the high parts in
                unary, and the place of every SAMPLE-th one bit for select
    trailer     fixed size: the sections' lengths and a magic number

A boundary takes some 2 + log2(ids / documents) bits; ``Shard.boundary(i)`` finds any of them
from the nearest sample, without a table of 64-bit offsets.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import repeats
from tessera.llm.kernel import slices, strings, tidy, turn_to

MAGIC = b"TSRTOK01"
TRAILER = struct.Struct("<8s8Q")
SAMPLE = 256
#: Bytes of texts in a shard, and shards at most: beyond, shards grow with the input instead.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 1 << 13
#: Id appended to each document.
END_ID = 1
#: What a null id counts as among ids.
NULL_KEY = -(1 << 63)
#: Words whose ids a worker remembers, at most; beyond, it starts afresh.
CACHE_WORDS = 400_000
CACHE_STEMS = 700_000

_PUNCTUATION = b".,;:!?#$%&*|"


class EliasFano:
    """Ascending numbers from 0 to ``top`` in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.samples = np.frombuffer(samples, "<u8")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = b"".join(np.packbits(((values[a : a + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() for a in range(0, n, 65536)) if low_bits else b""
        ones = (values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones.astype(np.int64)] = 1
        return cls(n, low_bits, low, np.packbits(flags, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u8").tobytes())

    def select(self, i: int) -> int:
        """The place of the i-th one bit, counted on from the nearest sample before it."""
        at = int(self.samples[i // SAMPLE])
        missing = i % SAMPLE
        byte, bits = at // 8, self.high[at // 8] >> (at % 8)
        if missing == 0:
            return at
        base, seen = at, -1
        while True:
            count = bits.bit_count()
            if seen + count >= missing:
                while True:
                    if bits & 1:
                        seen += 1
                        if seen == missing:
                            return base
                    bits >>= 1
                    base += 1
            seen += count
            byte += 1
            bits, base = self.high[byte], byte * 8

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = self.select(i) - i << self.low_bits
        if self.low_bits:
            first = i * self.low_bits
            chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
            value |= chunk >> first % 8 & (1 << self.low_bits) - 1
        return value

    def decode(self) -> np.ndarray:
        """All of them."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        values = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            weights = (1 << np.arange(self.low_bits)).astype(np.int64)
            for a in range(0, self.n, 65536):
                b = min(a + 65536, self.n)
                bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[a * self.low_bits // 8 : (b * self.low_bits + 7) // 8], bitorder="little")[: (b - a) * self.low_bits]
                values[a:b] |= bits.reshape(-1, self.low_bits).astype(np.int64) @ weights
        return values


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes a shard as documents come; the file appears under its name only when it is whole."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width
        self.fs, self.name = _open(path)
        self.fs.create_dir(os.path.dirname(self.name), recursive=True)
        self.part = f"{self.name}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.doc_ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: list[bytes]) -> None:
        for x in ids:
            self.out.write(x)
        self.doc_ids.append(doc_ids), self.nulls.append(nulls), self.lengths.append(lengths)

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the shard."""
        docs = np.concatenate(self.doc_ids).astype("<i8")
        nulls = np.packbits(np.concatenate(self.nulls), bitorder="little").tobytes()
        bounds = np.concatenate(([0], np.cumsum(np.concatenate(self.lengths))))
        ef = EliasFano.encode(bounds)
        for x in (docs.tobytes(), nulls, ef.low, ef.high, ef.samples.tobytes()):
            self.out.write(x)
        self.out.write(TRAILER.pack(MAGIC, len(docs), int(bounds[-1]), self.width, ef.low_bits, len(ef.low), len(ef.high), ef.samples.nbytes, len(nulls)))
        self.out.close()
        self.fs.move(self.part, self.name)
        return len(docs), int(bounds[-1])


class Shard:
    """A shard file opened for reading."""

    def __init__(self, path: str):
        self.fs, self.name = _open(path)
        self.file = self.fs.open_input_file(self.name)
        size = self.file.size()
        magic, self.n_docs, self.n_ids, self.width, low_bits, low, high, samples, nulls = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard of token ids: {path}")
        at = self.n_ids * self.width
        parts = []
        for n in (8 * self.n_docs, nulls, low, high, samples):
            parts.append(self.file.read_at(n, at) if n else b"")
            at += n
        self.doc_ids = np.frombuffer(parts[0], "<i8")
        self.nulls = np.unpackbits(np.frombuffer(parts[1], np.uint8), bitorder="little")[: self.n_docs].astype(bool)
        self.bounds = EliasFano(self.n_docs + 1, low_bits, *parts[2:])

    def boundary(self, i: int) -> int:
        return self.bounds[i]

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from one boundary to another."""
        raw = self.file.read_at((last - first) * self.width, first * self.width) if last > first else b""
        return np.frombuffer(raw, f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.boundary(i), self.boundary(i + 1))


class Encoder:
    """Encodes whole texts word by word: white space never takes part in a token of this kind of model.

    Words are remembered as they stand, and their stems (an ASCII word in lower case, or one
    that ends in a letter, without the punctuation after it) apart from them, as the model
    lower-cases and never joins a letter with punctuation. Stems of letters only, each one
    word end in the model, are encoded many in a row and parted at their word ends.
    """

    def __init__(self, tokenizer_path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.type = f"<u{width}"
        self.width = width
        settings = json.loads(self.tokenizer.to_str())
        steps = {x["type"] for x in (settings.get("normalizer") or {}).get("normalizers", [])}
        suffix = settings["model"].get("end_of_word_suffix")
        self.splits = "Lowercase" in steps and bool(suffix)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            for piece, i in self.tokenizer.get_vocab().items():
                self.ends[i] = piece.endswith(suffix)
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _learn_stems(self, stems: list[bytes]) -> None:
        rows, rest = [], []
        for w in stems:
            (rows if w.isalpha() or not w.isascii() and w.decode().lower().isalpha() else rest).append(w)
        for a in range(0, len(rows), 2000):
            part = rows[a : a + 2000]
            ids = np.array(self._encode([b" ".join(part).decode()])[0], self.type)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(cuts) != len(part):
                rest += part
                continue
            raw, first = ids.tobytes(), 0
            for w, last in zip(part, cuts.tolist()):
                self.stems[w] = raw[first:last]
                first = last
        for w, ids in zip(rest, self._encode([w.decode() for w in rest])):
            self.stems[w] = np.array(ids, self.type).tobytes()

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > CACHE_WORDS:  # words of these texts that are known already are frequent ones
            self.known = {w: self.known[w] for w in words if w in self.known}
        if len(self.stems) > CACHE_STEMS:
            self.stems.clear()
        stems, known = self.stems, self.known
        new = words.difference(known)
        plan: list[tuple[bytes, bytes, bytes]] = []
        wanted: set[bytes] = set()
        for w in new:
            if self.splits and w.isalpha():  # ASCII letters
                stem = w.lower()
                if stem in stems:
                    known[w] = stems[stem]
                else:
                    plan.append((w, stem, b""))
                    wanted.add(stem)
                continue
            stem, tail = w, b""
            if self.splits:
                cut = w.rstrip(_PUNCTUATION)
                if cut and len(cut) < len(w) and (cut[-1:].isalnum() or cut[-1] >= 0x80 and cut.decode()[-1].lower().isalpha()):
                    stem, tail = cut, w[len(cut) :]
                if stem.isascii():
                    stem = stem.lower()
            if stem in stems and (not tail or tail in stems):
                known[w] = stems[stem] + stems[tail] if tail else stems[stem]
                continue
            plan.append((w, stem, tail))
            wanted.add(stem)
            if tail:
                wanted.add(tail)
        self._learn_stems([s for s in wanted if s not in stems])
        for w, stem, tail in plan:
            known[w] = stems[stem] + stems[tail] if tail else stems[stem]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@functools.lru_cache(maxsize=2)
def encoder_of(tokenizer_path: str, width: int) -> Encoder:
    """The encoder, and what it remembers, for as long as the worker lives."""
    return Encoder(tokenizer_path, width)


@tidy
def _tokenize(batches, tokenizer_path: str, width: int, edges: np.ndarray, end_id: int):
    turn_to("token_files", encoder_of.cache_clear)
    encoder = encoder_of(tokenizer_path, width)
    end = np.array([end_id], f"<u{width}").tobytes()
    for batch in batches:
        data, offsets = strings(batch.column(1))
        ids = batch.column(0)
        keys = ids.fill_null(NULL_KEY).to_numpy(zero_copy_only=False)
        shard = np.searchsorted(edges, keys, "right").astype(np.int32)
        before = np.searchsorted(edges, keys, "left").astype(np.int32)
        for a, b in slices(offsets):
            texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
            out = [x + end for x in encoder.encode(texts)]
            for i in (a + np.flatnonzero(shard[a:b] - before[a:b] > 1)).tolist():  # an id of several shards: its rows go by their token ids
                shard[i] = before[i] + 1 + (int.from_bytes(out[i - a][:8].ljust(8, b"\0"), "big") * int(shard[i] - before[i]) >> 64)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(shard[a:b]), pa.array(out, pa.binary())], ["id", "shard", "ids"])


@tidy
def _write(batches, folder: str, width: int):
    writers: dict[int, Writer] = {}
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        ids = batch.column("id")
        for s in np.unique(shards).tolist():
            at = np.flatnonzero(shards == s)
            if s not in writers:
                writers[s] = Writer(f"{folder}/shard-{s:08d}.tok", width)
            rows = batch.column("ids").take(pa.array(at)).to_pylist()
            own = ids.take(pa.array(at))
            lengths = np.array([len(x) // width for x in rows], np.int64)
            writers[s].add(own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), lengths, rows)
    done = [(s, w.path, *w.close()) for s, w in writers.items()]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "n_docs", "n_ids"])


def shard_edges(docs: DataFrame, id_col: str, shards: int) -> np.ndarray:
    """Ids that part the documents into ``shards`` ranges of like count; only sizes depend on it.

    An id that very many rows have stands there several times, and takes as many shards. A
    null id counts as NULL_KEY. The driver holds ``shards`` numbers, MOST_SHARDS at most.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).cast("double")
    quantiles = docs.select(key.alias("q")).approxQuantile("q", [i / shards for i in range(1, shards)], 0.2 / shards) if shards > 1 else []
    return np.clip(np.sort(np.array(quantiles, np.float64)), NULL_KEY, 2.0**63 - 1024).astype(np.int64)


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write the ids of all texts below ``folder`` and return the manifest: shard, path, n_docs, n_ids, start.

    Null and empty texts have the end id alone. Null ids come first; rows that share an id
    are ordered by their ids. An empty table writes no file and has an empty manifest. Columns
    other than id and text play no part, whatever they are called.
    ``start`` counts the ids of all shards before. Shards are written under a temporary name
    and then moved, so a task that is run again, or twice, does no harm.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    session.ship_code(spark)
    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    if shards is None:
        shards = min(max(1, round(repeats.input_bytes(docs, text_col) / SHARD_BYTES)), MOST_SHARDS)
    folder = folder or session.scratch_path(spark, "tokens")
    edges = shard_edges(docs, id_col, shards)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tokens = source.mapInArrow(lambda it: _tokenize(it, tokenizer_path, width, edges, end_id), "id long, shard int, ids binary")
    placed = tokens.repartitionById(len(edges) + 1, "shard").sortWithinPartitions("shard", "id", "ids")
    manifest = session.materialize(placed.mapInArrow(lambda it: _write(it, folder, width), "shard int, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard, MOST_SHARDS at most
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


@tidy
def _read(batches, most: int = 1 << 20):
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            shard = Shard(path)
            a, bounds = 0, [shard.boundary(0)]
            while a < shard.n_docs:
                while (b := a + len(bounds) - 1) < shard.n_docs and bounds[-1] <= bounds[0] + most:
                    bounds.append(shard.boundary(b + 1))
                if b > a + 1 and bounds[-1] > bounds[0] + most:
                    b -= 1  # the last document begins the next batch
                at = np.array(bounds[: b - a + 1], np.int64)
                ids = shard.ids(int(at[0]), int(at[-1])).astype("<u4")
                crc = [zlib.crc32(ids[i:j]) for i, j in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids[a:b], mask=shard.nulls[a:b]), pa.array(start + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["id", "start", "n_tokens", "ids_crc32"],
                )
                a, bounds = b, bounds[b - a :]


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the files hold of each document: id, start, n_tokens, ids_crc32; a task reads a shard."""
    shards = manifest.count()
    placed = manifest.select("shard", "path", "start").repartitionById(max(shards, 1), F.col("shard"))
    return placed.mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
