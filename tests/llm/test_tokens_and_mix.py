"""Token files, SentencePiece, mixing, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import kernel, mixing, sentencepiece_codec, token_files
from tessera.llm.components import components
from tessera.llm.queries import tokenizer
from tests.llm import fixtures as fx

WORD_BPE, PIECES = tokenizer("word_bpe_49k.json"), tokenizer("piece_bpe_32k.model")
SIGNS = ["a", "bc", "DEF", "é", "É", "ß", "Σ", "İ", "́", "̌", "J", "»", "日本", "🙂", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "'s", "'LL", ".", "..", ",", "!", "###", "0", "42", "▁", "<|endoftext|>"]


@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=900))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = np.sort(np.array(values))
    ef = token_files.EliasFano.encode(values)
    assert (ef.decode() == values).all() and [ef[i] for i in range(0, len(values), 7)] == values[::7].tolist()
    with pytest.raises(IndexError):
        ef[len(values)]


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    whole, own, rng = Tokenizer.from_file(WORD_BPE), token_files.Encoder(WORD_BPE, 2), random.Random(0)
    for _ in range(3000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randrange(40)))
        assert np.frombuffer(own.encode([text.encode()])[0], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("shards", [None, 5])
def test_token_files(spark, shards):
    from tokenizers import Tokenizer

    rows = fx.awkward(8)
    rows += [(7, "a repeated id", None, None, None), (None, "no id", None, None, None)]
    manifest = token_files.write(fx.frame(spark, rows, True), WORD_BPE, shards=shards)
    got = [tuple(r) for r in token_files.read(manifest).orderBy("start").collect()]
    whole = Tokenizer.from_file(WORD_BPE)
    want, start = [], 0
    coded = [(r[0], np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")) for r in rows]
    for i, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes())):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    first = manifest.orderBy("shard").first()
    shard = token_files.Shard(first.path)
    assert shard.document(0).tolist() == [*whole.encode("no id", add_special_tokens=False).ids, 1] and shard.nulls[0]
    assert shard.boundary(shard.n_docs) == shard.n_ids == first.n_ids


@pytest.mark.parametrize("most", [0, 1, 7, 40, 1 << 20])
def test_offsets_come_from_select(tmp_path, monkeypatch, most):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    lengths = np.where(rng.random(700) < 0.2, 0, rng.integers(0, 30, 700))
    rows = [rng.integers(0, 60_000, n).astype("<u2") for n in lengths]
    path = f"file://{tmp_path}/a.tok"
    writer = token_files.Writer(path, 2)
    writer.add(np.arange(700), np.zeros(700, bool), lengths, [x.tobytes() for x in rows])
    writer.close()
    monkeypatch.setattr(token_files.EliasFano, "decode", lambda self: pytest.fail("boundaries were decoded as a whole"))
    batches = list(token_files._read([pa.RecordBatch.from_pydict({"path": [path], "start": [5]})], most))
    got = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    starts = 5 + np.concatenate(([0], np.cumsum(lengths)[:-1]))
    assert got == [(i, s, n, zlib.crc32(x.astype("<u4").tobytes())) for i, (s, n, x) in enumerate(zip(starts.tolist(), lengths.tolist(), rows))]
    assert all(b.num_rows == 1 or sum(b.column("n_tokens").to_pylist()) <= most for b in batches)


def test_token_files_of_an_empty_table(spark):
    manifest = token_files.write(spark.createDataFrame([], fx.SCHEMA), WORD_BPE)
    assert manifest.count() == 0 and token_files.read(manifest).count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_search_gives_the_librarys_ids(library):
    model, rng = sentencepiece_codec.load(PIECES), random.Random(0)
    signs = [*SIGNS, *"thonerinestre", "the", "tion", "ing "]
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(80)))
        want = library.encode(text)
        assert model.encode(text) == want and model.encode_batch([text])[0] == np.array(want, "<i4").tobytes()
        search, got, at = sentencepiece_codec.Search(model), [], 0
        escaped = "▁" + text.replace(" ", "▁") if text else ""
        while at < len(escaped):
            step = rng.randrange(1, 30)
            got += search.push(escaped[at : at + step])
            at += step
        assert got + search.finish() == want
        assert model.decode(want) == text.replace("▁", " ")


def test_search_commits_early():
    model = sentencepiece_codec.load(PIECES)
    search, most = sentencepiece_codec.Search(model), 0
    text = "then" * 3000
    got = []
    for a in range(0, len(text), 50):
        got += search.push(text[a : a + 50])
        most = max(most, len(search.text))
    assert most < 200 and "".join(model.pieces[i] for i in got + search.finish()) == text


def test_every_new_segment_goes_through_the_search(library, monkeypatch):
    """Characters that the search takes in are those of all segments not remembered, but for what each has in common with the one before."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    taken = [0, 0]
    push, start = sentencepiece_codec.Search.push_pieces, sentencepiece_codec.Search.start

    def counting_push(self, chars):
        taken[0] += len(chars)
        return push(self, chars)

    def counting_start(self, text):
        k = start(self, text)
        taken[1] += k
        return k

    monkeypatch.setattr(sentencepiece_codec.Search, "push_pieces", counting_push)
    monkeypatch.setattr(sentencepiece_codec.Search, "start", counting_start)
    model = sentencepiece_codec.Model(PIECES)
    asked, learn = [], model.learn

    def watching(segments):
        asked.append(sum(map(len, segments.difference(model.segments))))
        return learn(segments)

    model.learn = watching
    for a in range(0, len(texts), 20):
        assert [np.frombuffer(x, "<i4").tolist() for x in model.encode_batch(texts[a : a + 20])] == library.encode(texts[a : a + 20])
    assert sum(taken) == sum(asked) > 50_000 and taken[0] > 0.4 * sum(asked)


def test_unigram_search_finds_the_best_path():
    """With scores as weights, the search maximises their sum."""
    model = sentencepiece_codec.load(PIECES)
    small = object.__new__(sentencepiece_codec.Model)
    small.bpe, small.score = False, {"a": -3.0, "b": -3.0, "ab": -2.0, "aba": -6.0, "ba": -1.5, "bab": -9.0}
    small.id = {p: i for i, p in enumerate(small.score)}
    small.reachable = {p: p for p in small.id}
    small.longest, small.least = 3, -13.0
    small.longest_to = {"ab": 3, "ba": 3}
    small.tuples = {p: (i,) for p, i in small.id.items()}
    names = list(small.id)

    def best(s):
        if not s:
            return 0.0, []
        return max(((small.score[s[:k]] + best(s[k:])[0], [s[:k], *best(s[k:])[1]]) for k in (1, 2, 3) if s[:k] in small.score), key=lambda x: x[0])

    for text in ("abab", "babab", "aabbab", "bbaab"):
        search = sentencepiece_codec.Search(small)
        ids = [*search.push(text[:3]), *search.push(text[3:]), *search.finish()]
        assert sum(small.score[names[i]] for i in ids) == best(text)[0]
    assert model.bpe


def test_sentencepiece_tables(spark, library):
    rows = fx.awkward(9, 30)
    df = sentencepiece_codec.encode(fx.frame(spark, rows, True), PIECES)
    texts = {r[0]: r[1] or "" for r in rows}
    got = df.collect()
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip for r in got) and len(got) == len(rows)
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(df, PIECES).collect()} == texts
    assert sentencepiece_codec.encode(spark.createDataFrame([], fx.SCHEMA), PIECES).count() == 0


def filled(sizes):
    """Targets by repeated sharing of the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("flight_rows", [20_000, 40])
def test_mix(spark, flight_rows):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.3) * 5)), None, rng.choice(["hot"] * 6 + ["b", "c", "", None, "é"]), None) for i in range(600)]
    rows += [(600, None, None, "b", None), (601, "", None, "b", None), (602, "w", None, "b", None), (602, "w", None, "b", None)]
    df = fx.frame(spark, rows, True)
    got = mixing.report(df, flight_rows=flight_rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.report(df.repartition(3), flight_rows=flight_rows).collect()))
    source = {r[0]: r[3] for r in rows}
    sizes: dict = {}
    taken: dict = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sizes[source[r.doc_id]] = sizes.get(source[r.doc_id], 0) + r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert len(got) == len(rows)
    want = filled(sizes)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    most = max(r.size for r in got)
    for s, t in want.items():
        assert abs(taken[s] - t) <= (2 if flight_rows > 1000 else 2 * most)
    mixed = mixing.mix(df, flight_rows=flight_rows)
    assert mixed.columns == df.columns and sum(len(fx.byte_words(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], fx.SCHEMA)
    assert mixing.report(empty).count() == 0 and mixing.mix(empty).count() == 0
    nulls = fx.frame(spark, [(1, None, None, None, None), (2, "", None, "a", None)])
    assert sorted(map(tuple, mixing.report(nulls).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)] and mixing.mix(nulls).count() == 0


@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(0, 500)), max_size=60), st.integers(0, 99))
@settings(max_examples=100, deadline=None)
def test_flight_keeps_totals(units, seed):
    p, x = [u[0] for u in units], [float(u[1]) for u in units]
    count, words = sum(p), sum(a * b for a, b in zip(p, x))
    mixing.fly(p, x, random.Random(seed))
    assert sum(0 < v < 1 for v in p) <= 2
    assert sum(p) == pytest.approx(count, abs=1e-4) and sum(a * b for a, b in zip(p, x)) == pytest.approx(words, abs=1e-2)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(i) == c for i, c in got.items()) and set(got) | {5} >= {i for e in edges for i in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kernel():
    import pyarrow as pa

    texts = [None, "", " a  b\n", "Ab aB", "x" * 5000 + " y", "é b c"]
    data, offsets = kernel.strings(pa.array(texts))
    w = kernel.Words(data, offsets)
    assert w.counts.tolist() == [len(fx.byte_words(t)) for t in texts]
    h, low = w.hashes(), w.hashes(lower=True)
    assert h[2] != h[3] and low[2] == low[3] and h[2] != low[2]
    assert list(kernel.slices(offsets, 1)) == [(i, i + 1) for i in range(6)] or list(kernel.slices(offsets, 1))[-1][1] == 6
    assert kernel.cover(np.array([0, 1, 0, 0, 0], bool), 3, 5).tolist() == [False, True, True, True, False]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    rows = []
    for i in range(80):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(30, 60))]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 1))
    rows += [(100 + i, rows[i][1].upper(), "en", "s0", 1) for i in range(10)]
    rows += [(200 + i, rows[20 + i][1] + " extra", "en", "s1", 1) for i in range(10)]
    rows += [(300 + i, " ".join(f"w{j}$$$###" for j in range(i, i + 40)), "en", "s2", 1) for i in range(0, 900, 45)]
    spark.createDataFrame(rows, fx.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    ids = sorted({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()})
    kept = [r for r in rows if r[0] < 300]
    kept = [r for r in kept if fx.exact_groups(kept)[r[0]][2]]
    classes = fx.near_classes(kept)
    kept = [r for r in kept if classes[r[0]][2]]
    assert set(ids) <= {r[0] for r in kept} and not any(i >= 300 for i in ids)
    mixed = {r.doc_id for r in __import__("tessera.llm.mixing", fromlist=["mix"]).mix(fx.frame(spark, kept)).collect()}
    assert set(ids) == mixed
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
