"""Near-duplicate detection by bottom-k sketches of one hash function.

1. Of each document's set of word shingles, the SKETCH smallest hashes are kept, in order.
   Documents of equal sets are one from here on (their representative is the least id).
2. Inverted lists of retained values, by runs of RUN values that follow one another in a
   sketch: single common shingles thus make no long lists. Runs are counted first, packed by
   bucket (see ``repeats``); those of one document only are never listed. Sets of at most SMALL
   shingles are listed by runs of two as well.
3. Hot runs, of more than OFTEN documents, are listed for documents only that have as many of
   them as a link needs common runs: any other document shares one that isn't hot with each of
   its partners. So a passage that stands in very many unlike documents makes no pairs of them.
4. Rounds. First every document is held against one hub, the least id of its lists (that in
   most of them); links found join into components. Then pairs in a common list but in
   different components are held against each other, so that pairs inside a group of copies
   are never listed.
5. A pair is looked at further if it has enough lists in common. Its two sets come together
   block by block; the sketch of their union, made from both sketches, estimates their
   similarity, and where that is DOUBT or more the full sets decide.

Sets of up to SKETCH shingles are whole in their sketches. Let u be the union's size and d
the shingles in one set only; links have d <= u / 5. The d cut the shared ones into at most d
+ 1 stretches, so the longest has 3 or more for u > 5 (2 for u = 5), and u - 3d - 2 >= 0.4 u -
2 runs are common: these lose no link. For larger sets, the union's 64 least hashes are a
sample without replacement, all orders being as likely; ``least_runs`` counts how many common
runs a pair at exactly 0.8 then has but for a chance of MISS (2e-8). The chance that the
estimate falls below DOUBT is near 1e-8.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import places, repeats
from tessera.llm.components import components
from tessera.llm.kernel import Words, mix, slices, strings, tidy, turn_to

SHINGLE = 2
SKETCH, RUN, SMALL, DOUBT = 64, 3, 5, 0.5
#: A run that more documents have is hot (255 at most).
OFTEN = 64
#: Chance to lose a link of large sets, and common runs that are asked for at most.
MISS, MOST_RUNS = 2e-8, 24
#: Documents whose sets a task compares with those of as many others.
BLOCK = 128
#: A link: PERCENT * union <= 100 * intersection.
PERCENT = 80


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 63-bit hashes of each row's shingles, words in lower-case A-Z."""
    w = Words(data, offsets)
    h = w.hashes(lower=True)
    g, _ = w.grams(h, k)
    out = []
    for a, n in zip(w.first[:-1].tolist(), w.counts.tolist()):
        if n >= k:
            out.append(np.unique(g[a : a + n - k + 1] >> np.uint64(1)))
        elif n:  # the whole sequence is one shingle
            with np.errstate(over="ignore"):
                x = np.array([sum((int(v) * 0x9E3779B97F4A7C15 ** (i + 1) for i, v in enumerate(h[a : a + n])), n) & (1 << 64) - 1], np.uint64)
            out.append(mix(x) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@tidy
def _sketches(batches, k: int):
    turn_to("near_dedup")
    for batch in batches:
        data, offsets = strings(batch.column(1))
        for a, b in slices(offsets):
            sets = shingle_sets(data, offsets[a : b + 1], k)
            kept = [s[:SKETCH] for s in sets]
            at = np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int32)
            values = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(values)),
                    *(c.slice(a, b - a) for c in batch.columns[2:]),
                ],
                ["id", "n", "sig", "sketch", *batch.schema.names[2:]],
            )


def _runs(values: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the runs of retained values in each row's sketch."""
    rows, keys = [], []
    count = np.diff(offsets)
    row = np.repeat(np.arange(len(count)), count)
    for k, wanted in ((RUN, count >= RUN), (2, (sizes <= SMALL) & (count >= 2))):
        n = len(values) - k + 1
        if n <= 0:
            continue
        with np.errstate(over="ignore"):
            x = values[:n] * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            for j in range(1, k):
                x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + values[j : n + j]
        ok = (row[:n] == row[k - 1 :]) & wanted[row[:n]]
        rows.append(row[:n][ok])
        keys.append(mix(x[ok]))
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _batch_runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    sketch = batch.column("sketch")
    offsets = sketch.offsets.to_numpy()
    values = sketch.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64).view(np.uint64)
    return _runs(values, offsets - offsets[0], batch.column("n").to_numpy())


@tidy
def _send_runs(batches, log_buckets: int):
    tally = repeats.Tally()
    for batch in batches:
        row, keys = _batch_runs(batch)
        if len(keys):
            # A document's own repeats of a run (there are none but by collision) don't matter.
            if tally.add(repeats.short_keys(keys, log_buckets)):
                yield tally.flush()
    if tally.size:
        yield tally.flush()


@tidy
def _entries(batches, shared, log_buckets: int, percent: int):
    """The lists of each document; ``left`` is the number of its hot runs, if they are left out."""
    turn_to("near_dedup")
    twice, often = shared.value
    for batch in batches:
        row, keys = _batch_runs(batch)
        ok = repeats.is_hit(twice, repeats.short_keys(keys, log_buckets))
        row, keys = row[ok], keys[ok]
        ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
        hot = repeats.is_hit(often, repeats.short_keys(keys, log_buckets))
        left = np.bincount(row[hot], minlength=len(n))
        left[left >= _own_runs(n, percent)] = 0
        ok = ~hot | (left[row] == 0)
        row, keys = row[ok], keys[ok]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[row]), pa.array(n[row]), pa.array(left[row]), pa.array(_few(n, percent)[row])], ["value", "id", "n", "left", "few"])


@functools.cache
def _arrangements() -> list[list[int]]:
    """How many orders of SKETCH values, k of which aren't shared, have c runs of shared ones (MOST_RUNS at most)."""
    states = {(0, 0, 0): 1}
    for _ in range(SKETCH):
        after: dict[tuple[int, int, int], int] = {}
        for (length, k, c), ways in states.items():
            longer = min(length + 1, RUN)
            for state in ((0, k + 1, c), (longer, k, min(c + (longer == RUN), MOST_RUNS))):
                after[state] = after.get(state, 0) + ways
        states = after
    out = [[0] * (MOST_RUNS + 1) for _ in range(SKETCH + 1)]
    for (_, k, c), ways in states.items():
        out[k][c] += ways
    return out


def miss(union: int, c: int, percent: int = PERCENT) -> float:
    """The chance that a pair at exactly ``percent`` has fewer than ``c`` common runs, its union being larger than SKETCH."""
    apart = union - -(-union * percent // 100)
    orders = _arrangements()
    return sum(math.comb(apart, k) * math.comb(union - apart, SKETCH - k) * sum(orders[k][:c]) / (math.comb(union, SKETCH) * math.comb(SKETCH, k)) for k in range(min(apart, SKETCH) + 1))


@functools.cache
def least_runs(percent: int = PERCENT) -> tuple[tuple[int, int], ...]:
    """(c, the largest n such that a set of n > 0.8 * SKETCH shingles has c runs in common with any partner), from MOST_RUNS down to 2."""
    out = []
    for c in range(MOST_RUNS, 1, -1):
        low, high = SKETCH * percent // 100, 1 << 15
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if n * 100 // percent > SKETCH and miss(n * 100 // percent, c, percent) < MISS or n * 100 // percent <= SKETCH else (low, n - 1)
        out.append((c, low))
    return tuple(out)


def _few(n: np.ndarray, percent: int) -> np.ndarray:
    """Common runs by the size of the smaller set, where one is larger than its sketch: the smaller, the more."""
    out = np.ones(len(n), np.int64)
    for c, most in reversed(least_runs(percent)):
        out[n <= most] = c
    return out


def _own_runs(n: np.ndarray, percent: int) -> np.ndarray:
    """Common runs that a set of n shingles has with any partner, at least."""
    whole = np.maximum(n * 2 // 5 - 2, 1)
    large = _few(n, percent)
    return np.where(n * 100 <= percent * SKETCH, whole, np.where(n <= SKETCH, np.minimum(whole, large), large))


@tidy
def _sets_of(batches, tiles: places.Decisions, k: int):
    """(tile, id, set) for each tile that a document is in."""
    turn_to("near_dedup")
    held: dict = {}
    for batch in batches:
        which, tile = tiles.look_up_all(batch.column(places.FILE).to_numpy(), batch.column(places.ROW).to_numpy(), held)
        rows, at = np.unique(which, return_inverse=True)
        if not len(rows):
            continue
        order = np.argsort(at, kind="stable")
        tile, copies = tile[order], np.bincount(at)
        data, offsets = strings(batch.column(1).take(pa.array(rows)))
        ids = batch.column(0).take(pa.array(rows)).to_numpy()
        first = np.concatenate(([0], np.cumsum(copies)))
        for a, b in slices(offsets):
            sets = [s.tobytes() for s in shingle_sets(data, offsets[a : b + 1], k)]
            for i in range(a, b):  # a row goes to few tiles, or to many if very many documents are held against it
                own = tile[first[i] : first[i + 1]]
                for j in range(0, len(own), 256):
                    part = own[j : j + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), ids[i])), pa.array([sets[i - a]] * len(part), pa.binary())], ["of", "id", "items"])


def _confirm(percent: int):
    def confirm(key: tuple, pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held: dict[int, list[np.ndarray]] = {}
        for i, items in zip(sets["id"].to_pylist(), sets["items"].to_pylist()):
            held.setdefault(i, []).append(np.frombuffer(items, np.uint64))

        def linked(x: np.ndarray, y: np.ndarray) -> bool:
            # A set's first values are its sketch; the union's are among those of both.
            union = np.union1d(x[:SKETCH], y[:SKETCH])[:SKETCH]
            shared = len(np.intersect1d(np.intersect1d(union, x[:SKETCH], assume_unique=True), y[:SKETCH], assume_unique=True))
            if max(len(x), len(y)) > SKETCH and shared < DOUBT * len(union):
                return False
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= percent * (len(x) + len(y) - both)

        ok = [any(linked(x, y) for x in held.get(a, ()) for y in held.get(b, ())) for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())]
        return pairs.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return confirm


def _blocks(pairs: DataFrame) -> DataFrame:
    """(id, block): documents with a common least partner together, some BLOCK of them at most."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e")).select("e.*")
    label = ends.groupBy("id").agg(F.least(F.min("other"), F.min("id")).alias("label"))
    parts = label.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    return label.join(parts, "label").select("id", F.xxhash64("label", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))


def _links(pairs: DataFrame, source: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the written pairs (a, b) that are links, written.

    Pairs are put together by the blocks of their two documents, so that a set goes once to
    each tile, that is, pair of blocks, not to each pair of documents; a task holds the sets of
    two blocks. Which tiles a document is in is found out from ``rows`` (id and place); its set
    is made where its text is read and goes to them directly.
    """
    blocks = session.materialize(_blocks(pairs), "blocks")
    placed = pairs.join(blocks.select(F.col("id").alias("a"), F.col("block").alias("x")), "a").join(blocks.select(F.col("id").alias("b"), F.col("block").alias("y")), "b")
    placed = session.materialize(placed.select(F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("tile"), "a", "b"), "placed")
    needed = placed.select(F.col("tile").alias("number"), F.explode(F.array("a", "b")).alias("id")).distinct().join(rows, "id")
    tiles = places.Decisions.write(needed.select(*places.PLACE, "number"), source, 0)
    sets = source.mapInArrow(lambda it: _sets_of(it, tiles, k), "of long, id long, items binary")
    links = session.materialize(placed.groupBy("tile").cogroup(sets.groupBy("of")).applyInArrow(_confirm(percent), "a long, b long"), "links")
    session.drop(blocks, placed)
    return links


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, buckets: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id and kept.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets
    of ``k``-word shingles (a shorter text is one shingle; one without words, or null, has
    none and no links). component_id is the least id reachable; the document that carries it
    is kept. Rows that share an id are one document to links. A null id has no links, a null
    component_id, and is kept. Repeated rows share everything; an empty table gives an empty
    result. Columns other than id and text play no part, whatever they are called.
    """
    return _classes(places.located(docs), id_col, text_col, k, percent, buckets).drop(*places.PLACE)


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE, percent: int = PERCENT, buckets: int | None = None) -> DataFrame:
    """``classes`` of a located DataFrame, with places."""
    spark = docs.sparkSession
    session.ship_code(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *places.PLACE)
    all_docs = session.materialize(source.mapInArrow(lambda it: _sketches(it, k), ", ".join(["id long, n long, sig binary, sketch array<long>", *(f"{c} long" for c in places.PLACE)])), "sketches")
    rows = all_docs.where("id is not null and n > 0").select("id", *places.PLACE)
    linked = all_docs.where("id is not null and n > 0")
    same = session.materialize(linked.groupBy("sig").agg(F.min("id").alias("rep")), "same")
    reps = linked.join(same.select(F.col("rep").alias("id"), "sig"), ["id", "sig"], "left_semi").select("id", "n", "sketch")
    reps = session.materialize(reps, "reps")

    n_buckets = buckets or repeats.power_of_two(repeats.input_bytes(docs, text_col) / (1 << 21), 16, 1 << 20)
    log_buckets = n_buckets.bit_length() - 1
    shared = spark.sparkContext.broadcast(repeats.tally(reps.mapInArrow(lambda it: _send_runs(it, log_buckets), repeats.TALLIED), n_buckets, OFTEN))
    entries = session.materialize(reps.mapInArrow(lambda it: _entries(it, shared, log_buckets, percent), "value long, id long, n long, left long, few long"), "entries")

    def near(a: str, b: str) -> Column:
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def wanted(a: tuple[str, str, str], b: tuple[str, str, str]) -> Column:
        """Listed runs that a link of two documents has in common; each given by its n, left and few."""
        most = F.greatest(a[0], b[0])
        runs = F.when(most <= SKETCH, F.greatest(F.floor(most * 2 / 5) - 2, F.lit(1))).otherwise(F.greatest(a[2], b[2]))
        return runs - F.greatest(a[1], b[1])

    hubs = entries.groupBy("value").agg(F.count("*").alias("c"), F.min(F.struct("id", "n", "left", "few")).alias("hub")).where("c > 1").select("value", F.col("hub.id").alias("hub"), *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("n", "left", "few")))
    by_hub = entries.join(hubs, "value").where("id <> hub").where(near("n", "hub_n")).groupBy("id", "n", "left", "few", "hub", "hub_n", "hub_left", "hub_few").agg(F.count("*").alias("c"))
    # A hub isn't the hub of all lists that the two have in common: for a start, half as many will do.
    by_hub = by_hub.where(F.col("c") >= wanted(("n", "left", "few"), ("hub_n", "hub_left", "hub_few")) / 2)
    first = by_hub.groupBy("id").agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("hub")).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    first = session.materialize(first, "first")
    links = _links(first, source, rows, k, percent)

    found = session.materialize(components(links.unionByName(_same_ids(linked, same))), "found")
    labelled = entries.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value")
    labelled = session.materialize(labelled.join(mixed, "value", "left_semi"), "labelled")
    parts = labelled.groupBy("value", "component").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("left").alias("left"), F.max("few").alias("few"), F.count("*").alias("members"), F.min("id").alias("id"))
    left, right = (parts.select("value", *(F.col(c).alias(f"{c}_{s}") for c in ("component", "least", "most", "left", "few", "members", "id"))) for s in "ab")
    # Pairs of components first, then their members: pairs inside a component never arise.
    between = left.join(right, "value").where("component_a < component_b").where((100 * F.col("most_a") >= percent * F.col("least_b")) & (100 * F.col("most_b") >= percent * F.col("least_a")))
    pair = [f"{c}_{s}" for s in "ab" for c in ("id", "n", "left", "few")]
    single = F.col("members_a") + F.col("members_b") == 2
    alone = between.where(single).withColumnsRenamed({"least_a": "n_a", "least_b": "n_b"}).select(pair)
    a, b = (labelled.select("value", *(F.col(c).alias(f"{c}_{s}") for c in ("component", "id", "n", "left", "few"))) for s in "ab")
    groups = between.where(~single).select("value", "component_a", "component_b").join(a, ["value", "component_a"]).join(b, ["value", "component_b"]).select(pair)
    across = alone.unionByName(groups).where(near("n_a", "n_b"))
    counted = across.select("id_a", "id_b", wanted(*((f"n_{s}", f"left_{s}", f"few_{s}") for s in "ab")).cast("int").alias("wanted")).groupBy("id_a", "id_b", "wanted").agg(F.count("*").alias("c")).where("c >= wanted")
    second = counted.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).join(first, ["a", "b"], "left_anti")
    second = session.materialize(second, "second")
    more = _links(second, source, rows, k, percent)
    session.drop(entries, labelled, first, second)
    found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))

    rep_of = same.join(found, F.col("rep") == F.col("id"), "left").select("sig", F.coalesce("component", "rep").alias("component"))
    out = all_docs.drop("sketch").join(rep_of, "sig", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), *places.PLACE)


def _same_ids(linked: DataFrame, same: DataFrame) -> DataFrame:
    """Links between the representatives of rows that share an id but not their text."""
    twice = linked.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    rows = linked.join(twice, "id", "left_semi").join(same, "sig").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    return rows


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: one document of each group, all rows of its id.

    Rows without an id or without words are kept, repeated rows stay as often as they were, an
    empty table stays empty, and columns may have any names. No text is shuffled for the choice.
    """
    found = places.located(docs)
    gone = _classes(found, id_col, text_col, **options).where("not kept")
    return places.keep(found, gone, text_col).select(*(F.col(f"`{c}`") for c in docs.columns))
