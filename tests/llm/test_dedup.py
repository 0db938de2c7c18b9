"""Exact, near and substring deduplication against brute force."""

import pytest

from tessera.llm import exact_dedup, near_dedup, repeats, substring_dedup
from tests.llm import fixtures as fx


def test_fingerprints_compose(monkeypatch):
    data = bytes(range(256)) * 7
    for cut in (0, 1, 300, len(data)):
        x, y = data[:cut], data[cut:]
        assert exact_dedup.combine(exact_dedup.fingerprint(x), exact_dedup.fingerprint(y), len(y)) == exact_dedup.fingerprint(data)
    long = data * 80
    assert len(long) > exact_dedup.CHUNK
    plain = tuple(sum((b + 1) * pow(base, len(data) - 1 - i, p) for i, b in enumerate(data)) % p for base, p in zip(exact_dedup.BASES, exact_dedup.PRIMES))
    assert exact_dedup.fingerprint(data) == plain
    assert exact_dedup.fingerprint(b"\0") != exact_dedup.fingerprint(b"\0\0")


@pytest.mark.parametrize("clash", [False, True])
def test_exact(spark, clash):
    rows = fx.awkward(1)
    df = exact_dedup.groups(fx.frame(spark, rows, clash))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}
    assert got == fx.exact_groups(rows)
    kept = exact_dedup.deduplicate(fx.frame(spark, rows, clash))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, g in got.items() if g[2])
    assert kept.columns == fx.frame(spark, rows, clash).columns


def test_exact_with_equal_fingerprints(spark, monkeypatch):
    """Texts of one fingerprint are still told apart by their bytes."""
    rows = [(1, "aa", None, None, None), (2, "bb", None, None, None), (3, "AA", None, None, None), (4, "cc", None, None, None)]
    df = fx.frame(spark, rows)
    one = lambda batches: (b.set_column(1, "f1", _same(b)).set_column(2, "f2", _same(b)) for b in exact_fingerprints(batches))
    exact_fingerprints, chunks = exact_dedup._fingerprints, exact_dedup._chunks
    monkeypatch.setattr(exact_dedup, "_fingerprints", one)
    monkeypatch.setattr(exact_dedup, "_chunks", lambda batches, words: _constant_chunks(batches))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.groups(df).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1)}
    assert chunks


def _same(batch):
    import pyarrow as pa

    return pa.array([7] * batch.num_rows, pa.int64())


def _constant_chunks(batches):
    import pyarrow as pa

    for b in batches:
        texts = [x.lower().encode() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_pydict({"f1": [7] * len(texts), "f2": [7] * len(texts), "size": [2] * len(texts), "no": [0] * len(texts), "chunk": texts}, exact_dedup._CHUNK_SCHEMA)


@pytest.mark.parametrize("clash", [True])
def test_near(spark, clash):
    rows = fx.awkward(2)
    df = near_dedup.classes(fx.frame(spark, rows, clash))
    want = fx.near_classes(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()} == want
    assert len({c for _, c, _ in want.values()}) < len(want)
    kept = near_dedup.deduplicate(fx.frame(spark, rows, clash))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, g in want.items() if g[2])


def test_near_chain_and_large_group(spark):
    """A chain of links is one class; so is a group of many copies, each with its own change."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(6):
        rows.append((100 - i, " ".join(words[3 * i : 3 * i + 40]), None, None, None))
    for i in range(80):
        copy = [f"v{j}" for j in range(70)]
        copy[i % 70] = f"own{i}"
        rows.append((200 + i, " ".join(copy), None, None, None))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.classes(fx.frame(spark, rows)).collect()}
    assert got == fx.near_classes(rows)
    assert got[100][1] == 95 and got[279][1] == 200


def test_near_small_sets(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(["a b c d e f", "a b c d e f g", "a b c d e", "a b c d", "a b c", "q a b c d e f", "a b", "b a", "a"])]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.classes(fx.frame(spark, rows)).collect()} == fx.near_classes(rows)


def test_near_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e", None, None, None), (1, "a b c d e", None, None, None), (1, "x y z u v", None, None, None), (2, "X y z u v", None, None, None), (None, "a b c d e", None, None, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_dedup.classes(fx.frame(spark, rows)).collect())
    assert got == [(-1, 4, -1, True), (1, 4, 1, True), (1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False)]


@pytest.mark.parametrize("buckets", [None, (16, 8), (1 << 10, 64)])
def test_substrings(spark, buckets):
    rows = fx.awkward(3)
    df = substring_dedup.remove_repeats(fx.frame(spark, rows, buckets is None), with_text=True, buckets=buckets)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in df.collect()}
    want = fx.without_repeats(rows)
    assert {i: g[:3] for i, g in got.items()} == {i: w[:3] for i, w in want.items()}
    assert all(g[3] is None and not g[1] or g[3] == want[i][3] for i, g in got.items())
    assert sum(w[1] > 0 for w in want.values()) > 5


def test_substrings_other_window_and_ids(spark):
    rows = fx.awkward(4, 25)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(fx.frame(spark, rows), window=6).collect()}
    assert got == {i: w[:3] for i, w in fx.without_repeats(rows, 6).items()}
    long = " ".join(f"w{i}" for i in range(20))
    odd = [(None, long, None, None, None), (5, long, None, None, None), (5, long + " x", None, None, None), (6, long, None, None, None)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(fx.frame(spark, odd)).collect())
    assert got == [(-1, 20, 20), (5, 20, 0), (5, 21, 0), (6, 20, 20)]


def test_repeat_filter_refuses_no_repeated_key(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2)
    keys[:500] = keys[500:1000]

    def send(batches):
        sender = repeats.Sender()
        for _ in batches:
            sender.add(repeats.short_keys(keys, 4))
        if sender.size:
            yield sender.flush()

    found = repeats.collect(spark.range(1).coalesce(1).mapInArrow(send, repeats.SENT), 16)
    hit = repeats.is_hit(found, repeats.short_keys(keys, 4))
    assert hit[:1000].all() and hit[1000:].mean() < 0.01


@pytest.mark.parametrize("operator", [exact_dedup.groups, exact_dedup.deduplicate, near_dedup.classes, substring_dedup.remove_repeats])
def test_empty_tables_and_null_texts(spark, operator):
    none = spark.createDataFrame([], fx.SCHEMA)
    assert operator(none).count() == 0
    nulls = fx.frame(spark, [(1, None, None, None, None), (2, None, None, None, None)])
    got = operator(nulls)
    assert got.count() == (1 if operator is exact_dedup.deduplicate else 2)
