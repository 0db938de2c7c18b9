"""Removal of passages that repeat across documents, by fixed-block anchors.

A window is WINDOW = 13 consecutive words. Any 13 words in a row hold a whole block of BLOCK =
7 words of their document's own fixed grid (0, 7, 14, ...), so two equal windows meet where a
rolling 7-word window of one document equals a grid block of the other.

1. Anchors: hashes of all grid blocks and of all rolling windows go to buckets by hash, equal
   ones collapsed before the shuffle. A hash with a grid block and another occurrence is a
   hit; each bucket answers with its own region of a filter of fixed size.
2. Extension: hits are extended to the 13-word windows around them. Their 64-bit hashes go to
   buckets again, one for each document and distinct window; a window is a repeat in every
   document but the one of least id. Answers are (document, window hash). Windows that very
   many documents have are counted beforehand; their least ids go to all tasks, which answer
   them where they stand, so no bucket holds one's documents.
3. Documents with answers are joined with them, and the words of their repeated windows go;
   adjoining windows thus make up maximal repeats. Other documents aren't shuffled.

Step 1 only narrows what step 2 looks at: a false hit there costs time, not correctness. Step
2 takes equal 64-bit hashes for equal windows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import bloom, repeats
from tessera.llm.kernel import Words, cover, slices, strings, tidy, turn_to

WINDOW, BLOCK = 13, 7
#: Documents from which on a window is hot, at least; beyond, a share of all (document, window)
#: pairs, so that there are MOST_HOT hot windows at most (16 MB).
HOT, MOST_HOT = 1 << 16, 1 << 20
#: Documents of one packed batch that a window needs to be counted as one that may be hot.
_HOT_IN_BATCH = 8
#: Stands for a null id: such a row is never the first to have a window.
NO_ID = (1 << 63) - 1


def bucket_counts(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Buckets of the two shuffles; only speed depends on them."""
    size = repeats.input_bytes(docs, text_col)
    return repeats.power_of_two(size / (1 << 19), 16, 1 << 20), repeats.power_of_two(size / (1 << 23), 8, 1 << 24)


def _anchor_keys(w: Words, hashes: np.ndarray, log_buckets: int, window: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each rolling window, its short key, whether it is no grid block)."""
    g, ok = w.grams(hashes, block)
    ok &= np.repeat(w.counts >= window, w.counts)[: len(ok)]
    at = np.flatnonzero(ok)
    in_row = at - np.repeat(w.first[:-1], w.counts)[at]
    return at, repeats.short_keys(g[at], log_buckets), in_row % block != 0


@tidy
def _send_anchors(batches, log_buckets: int, window: int, block: int):
    turn_to("substring_dedup")
    sender = repeats.Sender()
    for batch in batches:
        data, offsets = strings(batch.column(1))
        for a, b in slices(offsets):
            w = Words(data, offsets[a : b + 1])
            _, keys, rolling = _anchor_keys(w, w.hashes(), log_buckets, window, block)
            if sender.add(keys, rolling):
                yield sender.flush()
    if sender.size:
        yield sender.flush()


def anchor_filter(source: DataFrame, n_buckets: int, window: int, block: int) -> np.ndarray:
    """The filter of grid blocks that some other window equals, from all documents."""
    log_buckets = n_buckets.bit_length() - 1
    return repeats.collect(source.mapInArrow(lambda it: _send_anchors(it, log_buckets, window, block), repeats.SENT), n_buckets)


def _windows(w: Words, hashes: np.ndarray, filter_: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows that hold a hit."""
    log_buckets = filter_.shape[0].bit_length() - 1
    at, keys, _ = _anchor_keys(w, hashes, log_buckets, window, block)
    n = len(hashes)
    hits = np.zeros(n + 1, np.int64)
    hits[at[repeats.is_hit(filter_, keys)] + 1] = 1
    hits = np.cumsum(hits)
    g, ok = w.grams(hashes, window)
    i = np.flatnonzero(ok)
    i = i[hits[i + window - block + 1] > hits[i]]
    return i, g[i]


@tidy
def _send_windows(batches, shared, log_buckets: int, window: int, block: int):
    turn_to("substring_dedup")
    filter_ = shared.value
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        keys, ids = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
        keys, ids = keys[new], ids[new]
        bucket = (keys >> np.uint64(64 - log_buckets)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = [*cuts[1:].tolist(), len(keys)]
        rows = list(zip(cuts.tolist(), ends))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([keys[a:b].tobytes() for a, b in rows], pa.binary()), pa.array([ids[a:b].tobytes() for a, b in rows], pa.binary())], ["bucket", "keys", "ids"])

    size = 0
    for batch in batches:
        data, offsets = strings(batch.column(1))
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        for a, b in slices(offsets):
            w = Words(data, offsets[a : b + 1])
            at, keys = _windows(w, w.hashes(), filter_, window, block)
            if len(at):
                held.append((keys, ids[a:b][w.row_of_word()[at]]))
                size += len(at)
            if size >= repeats.FLUSH:
                yield flush()
                size = 0
    if size:
        yield flush()


def _pairs(batches):
    for batch in batches:
        for keys, ids in zip(batch.column("keys").to_pylist(), batch.column("ids").to_pylist()):
            yield np.frombuffer(keys, np.uint64), np.frombuffer(ids, np.int64)


def _frequent(batches, least: int):
    """(window hash, documents) of the windows frequent in a packed row, and under a null hash all pairs."""
    total = 0
    for keys, _ in _pairs(batches):
        total += len(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        count = np.diff(np.append(first, len(keys)))
        many = count >= least
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[first[many]].view(np.int64)), pa.array(count[many])], ["key", "n"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["key", "n"])


def _hot_leasts(batches, hot: np.ndarray):
    for keys, ids in _pairs(batches):
        is_hot = np.isin(keys, hot)
        keys, ids = keys[is_hot], ids[is_hot]
        if len(keys):
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(np.minimum.reduceat(ids, first))], ["key", "least"])


@tidy
def _hot_answers(batches, hot: np.ndarray, leasts: np.ndarray):
    for keys, ids in _pairs(batches):
        is_hot = np.isin(keys, hot)
        keys, ids = keys[is_hot], ids[is_hot]
        yield from _by_id(keys, ids, ids > leasts[np.searchsorted(hot, keys)]).to_batches()


@tidy
def _cold(batches, hot: np.ndarray):
    for batch in batches:
        rows = []
        for bucket, (keys, ids) in zip(batch.column("bucket").to_pylist(), _pairs([batch])):
            cold = ~np.isin(keys, hot)
            if cold.any():
                rows.append({"bucket": bucket, "keys": keys[cold].tobytes(), "ids": ids[cold].tobytes()})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())]))


def find_hot(packed: DataFrame, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """(hash, least id) of the hot windows, in order of their hashes."""
    counts = packed.mapInArrow(lambda it: _frequent(it, min(_HOT_IN_BATCH, hot)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = session.materialize(counts, "frequent")
    total = counts.where("key is null").first()
    least = max(hot, (total.n if total else 0) // MOST_HOT)
    keys = np.sort(counts.where(f"key is not null and n >= {least}").select("key").toArrow()["key"].to_numpy().view(np.uint64))  # MOST_HOT at most
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    shared = packed.sparkSession.sparkContext.broadcast(keys)
    found = packed.mapInArrow(lambda it: _hot_leasts(it, shared.value), "key long, least long").groupBy("key").agg(F.min("least").alias("least")).toArrow()
    leasts = np.empty(len(keys), np.int64)
    leasts[np.searchsorted(keys, found["key"].to_numpy().view(np.uint64))] = found["least"].to_numpy()
    return keys, leasts


def _by_id(keys: np.ndarray, ids: np.ndarray, later: np.ndarray) -> pa.Table:
    """The windows in question, packed by document."""
    keys, ids = keys[later], ids[later]
    order = np.argsort(ids, kind="stable")
    keys, ids = keys[order], ids[order]
    cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    payload = [keys[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)])]
    return pa.table({"id": pa.array(ids[cuts]), "keys": pa.array(payload, pa.binary())})


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """For each document, those of its windows that a document of smaller id has too."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table["ids"].to_pylist()])
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(keys))))
    return _by_id(keys, ids, ids > least)


@tidy
def _split(batches, shared):
    """Documents without answers are done; others pass with their text."""
    words = shared.value
    for batch in batches:
        data, offsets = strings(batch.column(1))
        ids = batch.column(0).fill_null(NO_ID)
        may = bloom.test(words, ids.to_numpy(zero_copy_only=False))
        n, sha, text = [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            raw = data[a:b].tobytes()
            if may[i]:
                n.append(None), sha.append(None), text.append(raw)
            else:
                part = raw.split()
                n.append(len(part)), sha.append(hashlib.sha256(b" ".join(part)).hexdigest()), text.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary())], ["id", "key", "n", "sha", "raw"])


@tidy
def _finish(batches, window: int, with_text: bool):
    for batch in batches:
        n, sha = batch.column("n").to_pylist(), batch.column("sha").to_pylist()
        removed, kept = [0] * len(n), [None] * len(n)
        raws, answers = batch.column("raw"), batch.column("answers")
        for i in range(len(n)):
            if n[i] is not None:
                continue
            raw = raws[i].as_py()
            w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            part = raw.split()
            n[i] = len(part)
            found = answers[i].as_py()
            if found:
                g, ok = w.grams(w.hashes(), window)
                gone = cover(ok & np.isin(g, np.concatenate([np.frombuffer(x, np.uint64) for x in found])), window, len(part))
                removed[i] = int(gone.sum())
                if removed[i]:
                    part = [part[j] for j in np.flatnonzero(~gone).tolist()]
            left = b" ".join(part)
            sha[i] = hashlib.sha256(left).hexdigest()
            if with_text:
                kept[i] = left.decode()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False, buckets: tuple[int, int] | None = None, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_removed, kept_sha256 and kept_text.

    Every word of a window that starts in a document of smaller id too is removed; windows
    are judged on the input. ``kept_text`` (null unless ``with_text``, and null where nothing
    went) joins the kept words by single spaces. Texts of under ``window`` words, empty or
    null ones lose nothing; the latter have no words and the hash of the empty string. Rows
    that share an id are not repeats of one another, but each is one of the rows of smaller
    id. A row with a null id loses what any other document has, and takes nothing from it.
    An empty table gives an empty result; other columns, whatever they are called, play no part.
    """
    spark = docs.sparkSession
    session.ship_code(spark)
    block = (window + 1) // 2
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first, second = buckets or bucket_counts(docs, text_col)
    shared = spark.sparkContext.broadcast(anchor_filter(source, first, window, block))
    log_second = second.bit_length() - 1
    pairs = "bucket long, keys binary, ids binary"
    packed = windows = session.materialize(source.mapInArrow(lambda it: _send_windows(it, shared, log_second, window, block), pairs), "windows")
    answered = []
    frequent = spark.sparkContext.broadcast(find_hot(packed, hot))
    if len(frequent.value[0]):
        answered.append(packed.mapInArrow(lambda it: _hot_answers(it, *frequent.value), "id long, keys binary"))
        packed = packed.mapInArrow(lambda it: _cold(it, frequent.value[0]), pairs)
    answered.append(packed.groupBy("bucket").applyInArrow(_answer, "id long, keys binary"))
    answers = session.materialize(functools.reduce(DataFrame.unionByName, answered), "repeats")
    session.drop(windows)

    marked = spark.sparkContext.broadcast(bloom.build(answers, "id"))
    # Both kinds come of one pass over the texts: written once, as the union below reads them twice.
    rows = session.materialize(source.mapInArrow(lambda it: _split(it, marked), "id long, key long, n long, sha string, raw binary"), "split")
    by_doc = answers.groupBy(F.col("id").alias("key")).agg(F.collect_list("keys").alias("answers"))  # at most a document's own windows
    joined = rows.where("n is null").join(by_doc, "key", "left").select("id", "n", "sha", "raw", "answers")
    finished = joined.mapInArrow(lambda it: _finish(it, window, with_text), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    done = rows.where("n is not null").select("id", F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    return done.unionByName(finished).withColumnRenamed("id", id_col)
