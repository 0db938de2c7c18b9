"""What must not grow faster than the input: shuffles by plan, tasks by their number, codes by batch."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera import catalogue, session
from tessera.functions import codecs, stem
from tessera.functions.normalize import NormalizerConfig
from tessera.functions.scoring import BM25, TFIDF
from tessera.operators import bounds, search
from tessera.operators import index as ix

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with common and rare words, one with a null id; passages as queries."""
    at, r = tmp_path_factory.mktemp("growth"), random.Random(5)
    rows = [(i, " ".join(r.choices(WORDS, range(1, 41), k=r.randint(0, 30)))) for i in range(600)]
    rows += [(None, "w1 nowhere"), (700, None), (70_000, "w39 w38 w39"), (70_001, "the hopping hops")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(at / "documents.parquet"))
    asked = [(i, " ".join(r.choices(WORDS, k=5))) for i in range(12)] + [(20, "w39 w38"), (21, "w39 unheard"), (22, "the")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def same_as_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df, want = catalogue.QUERIES[name](spark, folder), con.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    rows = [sorted(x, key=repr) for x in (map(tuple, df.select(columns).collect()), want.select(*columns).fetchall())]
    assert rows[0] and rows[0] == rows[1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"(?<!Broadcast)Exchange (\w+\(.*?\)|\w+),", plan_of(df))


# codes


@pytest.mark.parametrize("code, plain, value", [(codecs.vbyte_lists, codecs.vbyte_encode, lambda r: r.choice([0, 1, 127, 128, 16384, r.getrandbits(62)])), (codecs.unary_lists, codecs.unary_encode, lambda r: r.choice([1, 1, 2, 7, 8, 9, 300]))])
def test_lists_are_coded_by_batch(code, plain, value):
    r = random.Random(3)
    want = {(t, g): [value(r) for _ in range(n)] for t, g, n in [("a", 0, 1), ("a", 1, 500), ("b", 1, 8), ("c", 0, 3), ("d", 5, 90), ("e", -1, 1)]}
    rows = [(t, g, v) for (t, g), vs in want.items() for v in vs]
    for sizes in ([], [1] * 20, [501, 8, 3], [100, 100, 100], [2, 498, 1, 9, 80]):
        cut, at = [], 0
        for n in [*sizes, len(rows)]:
            part = rows[at : at + n]
            cut.append(pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.int64())], ["term", "rng", "value"]))
            at += n
        got = {(x["term"], x["rng"]): x for b in code(iter(cut)) for x in b.to_pylist()}
        assert got.keys() == want.keys()
        for k, vs in want.items():
            assert got[k]["code"] == plain(vs).hex().upper() and got[k]["n_bytes"] == len(plain(vs))
            assert got[k]["decoded"] == ",".join(map(str, vs))


def test_numbers_below_zero_come_back():
    values, sizes = np.array([-1, 5, -(2**63), 2**63 - 1]), np.array([1, 3])
    assert list(codecs.vbyte_decode_lists(*codecs.vbyte_encode_lists(values, sizes), sizes)) == list(values)


@pytest.mark.parametrize("name", ["unary_round_trip", "vbyte_round_trip"])
def test_codes_shuffle_postings_once(spark, folder, name):
    same_as_sql(spark, folder, name)
    df = catalogue.QUERIES[name](spark, folder)
    assert len(shuffles(df)) == 1 and "collect_list" not in plan_of(df)


# searches


@pytest.mark.parametrize("name", ["topk_and_tfidf", "legacy_and", "topk_pruned_bm25", "topk_or_bm25", "partition_topk_merge", "next_geq", "terms_by_sigma"])
def test_scores_are_not_shuffled(spark, folder, name):
    same_as_sql(spark, folder, name)
    by = shuffles(catalogue.QUERIES[name](spark, folder))
    if name != "topk_pruned_bm25":  # which scores its first ranges alone
        assert not [x for x in by if re.search(r"qid#\d+L, (docid|rng|part)", x)]
    assert "SortMergeJoin [term" not in plan_of(catalogue.QUERIES[name](spark, folder))


@pytest.mark.parametrize("scorer", [BM25(), TFIDF()])
def test_pruned_with_saved_bounds_and_without(spark, folder, tmp_path, scorer):
    docs, q = catalogue.collection(spark, folder), catalogue.passages(spark, folder)
    saved = ix.save(ix.build(docs), str(tmp_path / "index"), width=8)
    terms = search.query_terms(q, saved)
    assert search.few(terms)

    def best(*args):
        return sorted((r.qid, r["rank"], r.docid, round(r.score, 6)) for r in search.search(saved, q, 5, *args).collect())

    for width in (8, 16):
        assert best("pruned", scorer, width) == best("or", scorer)
    got = [{(r.qid, r.rng): round(r.ub, 9) for r in search.query_bounds(i, terms, scorer, 8).collect()} for i in (saved, ix.replace(saved, bounds=None))]
    assert got[0] == got[1]


# stems


def test_stems_are_counted_by_document():
    rows = [(None, "hops", 1), (None, "hopping", 2), (1, "hops", 1), (1, "hopped", 4), (1, "cat", 1), (2, "hop", 3), (3, "cats", 1), (3, "hoping", 1)]
    want = {(None, "hop"): 3, (1, "hop"): 5, (1, "cat"): 1, (2, "hop"): 3, (3, "cat"): 1, (3, "hope"): 1}
    for n in (1, 2, 3, 5, 8):
        cut = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + n]), (pa.int64(), pa.string(), pa.int64()))], ["docid", "term", "tf"]) for i in range(0, len(rows), n)]
        got = [((x["docid"], x["term"]), x["tf"]) for b in stem.stem_counts(iter(cut)) for x in b.to_pylist()]
        assert len(got) == len(want) and dict(got) == want


def test_stems_shuffle_texts_only(spark, folder):
    same_as_sql(spark, folder, "stem_pipeline")
    assert len(shuffles(catalogue.QUERIES["stem_pipeline"](spark, folder))) == 1


def test_words_of_texts_are_split_and_stemmed_by_batch():
    texts = [(None, "hops  the hopping"), (1, None), (1, "hops"), (1, "hopped cat"), (2, ""), (3, "the of"), (4, "x" * 241 + " cats " + "x" * 240), (4, " cat "), (5, "hoping")]
    want = {(None, "hop"): 2, (1, "hop"): 2, (1, "cat"): 1, (4, "cat"): 2, (4, stem.stem("x" * 240)): 1, (5, "hope"): 1}
    for n in (1, 2, 3, 9):
        cut = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*texts[i : i + n]), (pa.int64(), pa.string()))], ["docid", "text"]) for i in range(0, len(texts), n)]
        rows = [x for b in stem.text_counts(NormalizerConfig.english())(iter(cut)) for x in b.to_pylist()]
        assert len(rows) == len(want) and {(x["docid"], x["term"]): x["tf"] for x in rows} == want
        assert all(x["dl"] == sum(tf for (d, _), tf in want.items() if d == x["docid"]) for x in rows)


def test_stems_make_no_row_for_each_word(spark, folder):
    plan = plan_of(catalogue.QUERIES["stem_pipeline"](spark, folder))
    assert "Generate" not in plan and "Aggregate" not in plan


# F8: the index


def test_index_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "w1 w2 hopping"), (1, "w1 hops"), (2, None), (None, "w1 w7"), (None, ""), (3, "w1"), (3, "w1")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "w1")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name in ("block_stats", "postings", "doc_index", "collection_stats", "term_sigma", "stem_pipeline", "unary_round_trip"):
        same_as_sql(spark, str(tmp_path), name)


def test_index_is_saved_without_bounds_by_range(spark, folder, tmp_path):
    built = ix.build(catalogue.collection(spark, folder), NormalizerConfig())
    assert len(shuffles(ix.frequencies(catalogue.collection(spark, folder)))) == 1
    saved = ix.save(built, str(tmp_path / "index"), width=0)
    assert saved.bounds is None and not (tmp_path / "index/bounds").exists()
    assert "Join" not in plan_of(bounds.term_sigma(built))


# bounds and parts


def test_bounds_by_range_join_nothing(spark, folder):
    same_as_sql(spark, folder, "range_bounds")
    df = catalogue.QUERIES["range_bounds"](spark, folder)
    assert len(shuffles(df)) == 1 and "Join" not in plan_of(df)


def test_blocks_are_weighted_last(spark, folder):
    same_as_sql(spark, folder, "term_blocks")
    assert plan_of(catalogue.QUERIES["term_blocks"](spark, folder)).count("Join ") == 1  # counts of the ranges before


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_blocks_are_cut_where_lists_lie(step):
    r = random.Random(step)
    pieces = [[("a", 3), ("b", 9), ("c", 4), ("d", 1), ("e", 5)], [("e", 6)], [("e", 2), ("f", 8), ("g", 3)], [("h", 2)], [("i", 1), ("j", 1), ("k", 1)]]
    rows = [(p, t, i, r.random(), r.random()) for p, ts in enumerate(pieces) for t, n in ts for i in range(n)]
    types = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + step]), types)], ["piece", "term", "docid", "bm25", "tfidf"]) for i in range(0, len(rows), step)]
    got = sorted(tuple(x.values()) for b in bounds.cut_blocks(4)(iter(batches)) for x in b.to_pylist() if x["block"] is not None)
    want = []
    for t in "bcdfj":
        own = [x for x in rows if x[1] == t]
        for b in range(0, len(own), 4):
            part = own[b : b + 4]
            want.append((t, b // 4, len(part), max(x[3] for x in part), max(x[4] for x in part), part[-1][2], len(own)))
    assert got == want
    apart = sorted((x["term"], x["last_docid"], x["bm25"], x["tfidf"]) for b in bounds.cut_blocks(4)(iter(batches)) for x in b.to_pylist() if x["block"] is None)
    assert apart == sorted(x[1:] for x in rows if x[1] not in "bcdfj")


def test_blocks_shuffle_few_lists(spark, folder):
    index = catalogue.opened(spark, folder)
    rows = bounds._blocks_in_place(index, 4)
    assert 0 < rows.where("block IS NULL").count() < index.postings.count() / 1.2 and rows.where("block > 0").count()
    assert {tuple(x) for x in bounds.term_blocks(ix.replace(index, buckets=0), 4).collect()} == {tuple(x) for x in bounds.term_blocks(index, 4).collect()}


@pytest.mark.parametrize("name", ["local_lexicon", "range_bounds", "unary_round_trip", "term_blocks"])
def test_tasks_grow_in_number(spark, folder, monkeypatch, name):
    index = catalogue.opened(spark, folder)
    for module in (ix, bounds):
        monkeypatch.setattr(module, "TASK_BYTES", int(session.input_bytes(index.postings) / 40))
    same_as_sql(spark, folder, name)
    counts = [int(x) for x in re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan_of(catalogue.QUERIES[name](spark, folder)))]
    assert counts == [41]
