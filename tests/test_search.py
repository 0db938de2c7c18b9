"""Index invariants and retrieval against a brute-force scorer."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions.normalize import NormalizerConfig
from tessera.functions.scoring import BM25, TFIDF
from tessera.operators import bounds
from tessera.operators import index as ix
from tessera.operators.cursor import Cursor
from tessera.operators.search import merge_parts, next_geq, query_terms, search, terms_by_sigma
from tessera.operators.sorted_map import SortedMap
from tessera.plans import cli
from tessera.sources.collections import read_buffer, read_collection, read_queries, run_lines
from tessera.streaming.queries import answer, query_stream

PLAIN = NormalizerConfig.plain()


def docs(spark, *texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "docid long, text string")


def asked(spark, *texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "qid long, text string")


def brute(texts, query, k, scorer, all_terms=False):
    bags = [Counter((t or "").lower().split()) for t in texts]
    n, avgdl = len(texts), sum(sum(b.values()) for b in bags) / len(texts)
    terms = set(query.lower().split())
    found = []
    for i, b in enumerate(bags):
        hit = [t for t in terms if b[t]]
        if not hit or all_terms and len(hit) < len(terms):
            continue
        s = 0.0
        for t in hit:
            idf = math.log2(n / sum(1 for x in bags if x[t]))
            s += b[t] / (0.82 * (0.32 + 0.68 * sum(b.values()) / avgdl) + b[t]) * idf if isinstance(scorer, BM25) else (1 + math.log2(b[t])) * idf
        found.append((-round(s, 6), i + 1))
    return [(d, r + 1) for r, (_, d) in enumerate(sorted(found)[:k])]


def got(df, qid=1):
    return [(r.docid, r["rank"]) for r in df.where(F.col("qid") == qid).orderBy("rank").collect()]


TEXTS = ["wolf bear wolf", "wolf", "bear lynx bear", "bear", "", "the wolf the", None, "wolf", "lynx fox owl", "bear wolf lynx fox"]


def test_index_tables(spark):
    i = ix.build(docs(spark, *TEXTS), PLAIN)
    assert (i.n_docs, i.doc_len_sum) == (10, 19)
    assert {r.docid: r.dl for r in i.doc_index.collect()} == {1: 3, 2: 1, 3: 3, 4: 1, 5: 0, 6: 3, 7: 0, 8: 1, 9: 3, 10: 4}
    assert {r.term: r.df for r in i.lexicon.collect()} == {"wolf": 5, "bear": 4, "lynx": 3, "fox": 2, "owl": 1, "the": 1}
    assert i.postings.groupBy("docid").agg((F.sum("tf") - F.max("dl")).alias("d")).where("d <> 0").count() == 0


@pytest.mark.parametrize("scorer", [BM25(), TFIDF()])
@pytest.mark.parametrize("k", [0, 1, 3, 50])
def test_retrieval(spark, scorer, k):
    i = ix.build(docs(spark, *TEXTS), PLAIN)
    queries = ["wolf bear", "lynx fox", "wolf wolf", "nowhere", "owl nowhere", ""]
    q = asked(spark, *queries)
    results = {mode: search(i, q, k, mode, scorer, width=3, seed_ranges=1) for mode in ("or", "and", "pruned")}
    for n, text in enumerate(queries, 1):
        assert got(results["or"], n) == brute(TEXTS, text, k, scorer)
        assert got(results["pruned"], n) == brute(TEXTS, text, k, scorer)
        assert got(results["and"], n) == brute(TEXTS, text, k, scorer, True)


def test_conjunction_read_literally(spark):
    i = ix.build(docs(spark, "wolf bear", "wolf", "bear lynx", "bear"), PLAIN)
    q = asked(spark, "wolf bear", "wolf lynx bear")
    assert {d for d, _ in got(search(i, q, mode="and"))} == {1}
    assert {d for d, _ in got(search(i, q, mode="and-lists"))} == {1, 3, 4}
    assert got(search(i, q, mode="and"), 2) == []
    assert {d for d, _ in got(search(i, q, mode="and-lists"), 2)} == {3, 4}


def test_term_in_every_document_still_ranks(spark):
    i = ix.build(docs(spark, "a b", "a", "a c"), PLAIN)
    assert got(search(i, asked(spark, "a"))) == [(1, 1), (2, 2), (3, 3)]


def test_stop_words_only_and_empty_collection(spark):
    i = ix.build(docs(spark, "the wolf"), NormalizerConfig())
    assert search(i, asked(spark, "the of and")).count() == 0
    empty = ix.build(docs(spark, "x").where("false"), PLAIN)
    assert search(empty, asked(spark, "x")).count() == 0


@pytest.mark.parametrize("n", [3, 4, 5, 8])
def test_blocks(spark, n):
    i = ix.build(docs(spark, *(["t"] * n), "u u"), PLAIN)
    rows = [r for r in bounds.term_blocks(i, 4).where("term = 't'").orderBy("block").collect()]
    assert [r.n for r in rows] == [4] * (n // 4) + ([n % 4] if n % 4 else [])
    assert [r.last_docid for r in rows] == [min(4 * (b + 1), n) for b in range(len(rows))]
    split = bounds.numbered(i.postings, width=3).where("term = 't'").orderBy("docid").collect()
    assert [r.place for r in split] == list(range(n))
    sigma = bounds.term_sigma(i).where("term = 't'").first().bm25_sigma
    assert sigma == pytest.approx(max(r.bm25_ub for r in rows))


def test_save_load_and_parts(spark, tmp_path):
    i = ix.build(docs(spark, *TEXTS), PLAIN)
    j = ix.save(i, str(tmp_path / "index"), buckets=4)
    q = asked(spark, "wolf bear", "fox")
    assert got(search(j, q)) == got(search(i, q)) and j.config == PLAIN
    local = ix.local_lexicon(i, 4)
    merged = SortedMap.merge([SortedMap(local.where(f"part = {p}").select("term", "df"), "term") for p in range(3)], {"df": F.sum})
    assert {r.term: r.df for r in merged.rows.collect()} == {r.term: r.df for r in i.lexicon.collect()}
    assert merge_parts(search(i, q).union(search(i, q, 1)).dropDuplicates(["qid", "docid"]), 2).count() == 4
    parts = {r.docid: r.part for r in ix.size_parts(docs(spark, "aaaa", "bbbb", "cc", ""), 6).collect()}
    assert parts == {1: 0, 2: 0, 3: 1, 4: 2}


def test_saved_bounds_prune_and_buckets_are_skipped(spark, tmp_path):
    rows = docs(spark, *([f"common w{i} w{i % 7}" for i in range(200)] + ["common rare rare rare"]))
    j = ix.save(ix.build(rows, PLAIN), str(tmp_path / "index"), buckets=16, width=8)
    assert j.width == 8 and j.bounds.where("term = 'common'").count() == 26
    q = asked(spark, "common rare w3", "w5 w6")
    for scorer in (BM25(), TFIDF()):
        want = {n: got(search(j, q, 5, "or", scorer), n) for n in (1, 2)}
        for width in (None, 8, 64):
            assert {n: got(search(j, q, 5, "pruned", scorer, width), n) for n in (1, 2)} == want
    plan = search(j, asked(spark, "rare"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("dynamicpruning") >= 2  # postings and lexicon
    sigmas = terms_by_sigma(query_terms(q, j), j).where("qid = 1").orderBy("place").collect()
    assert [r.term for r in sigmas] == ["common", "w3", "rare"]
    plain = terms_by_sigma(query_terms(q, j), ix.build(rows, PLAIN)).where("qid = 1").orderBy("place").collect()
    assert plain == sigmas
    wanted = spark.createDataFrame([(1, "w3", 5), (1, "w3", 4), (2, "w3", 202), (3, "nowhere", 0)], "qid long, term string, target long")
    assert sorted((r.target, r.docid) for r in next_geq(wanted, j).collect()) == [(4, 4), (5, 11)]


@pytest.mark.parametrize("saved", [False, True])
def test_cursor_over_a_list(spark, tmp_path, saved):
    i = ix.build(docs(spark, *("even" if n % 2 else "odd even odd" for n in range(25))), PLAIN)
    if saved:
        i = ix.save(i, str(tmp_path / "index"), buckets=4)
    c = Cursor(i, "odd", block=4)
    assert [(r.docid, r.tf, r.dl) for r in c] == [(n, 2, 3) for n in range(1, 26, 2)]
    seen = Cursor(i, "odd", block=4)
    steps = iter(seen)
    assert [next(steps).docid, seen.next_geq(3).docid, seen.next_gt(3).docid, seen.next_geq(16).docid, next(steps).docid] == [1, 3, 5, 17, 19]
    assert seen.next_geq(26) is None and Cursor(i, "odd").next_geq(25).docid == 25 and list(Cursor(i, "nowhere")) == []


def test_lines_in_memory(spark):
    rows = read_buffer(spark, "a\tone\ttwo\r\nno tab\n\nb\t".encode()).collect()
    assert [tuple(r) for r in rows] == [("a", "one\ttwo", False), (None, "no tab", True), (None, "", True), ("b", "", False)]
    assert read_buffer(spark, b"").count() == 0


def test_dense_ids_follow_the_source(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("cast(id as string) as docno", "id as docid_", "'x' as n")
    got = ix.with_docids(df, 5)
    assert got.columns == ["docid", "docno", "docid_", "n"]
    assert sorted((r.docid, r.docid_) for r in got.collect()) == [(i + 5, i) for i in range(1000)]
    assert ix.with_docids(df.where("false")).count() == 0


def test_archives_of_lines(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as t:
        for name, data in (("a.tsv", "x\tone two\nno tab\r\n"), ("b.tsv", "".join(f"d{i}\tword{i}\n" for i in range(25_000)))):
            info = tarfile.TarInfo(name)
            info.size = len(data.encode())
            t.addfile(info, io.BytesIO(data.encode()))
    found, corrupt = read_collection(spark, str(tmp_path / "c.tar.gz"))
    assert found.count() == 25_001 and [r.line for r in corrupt.collect()] == ["no tab"]
    assert found.where("docno in ('x', 'd24999')").orderBy("docno").collect() == [("d24999", "word24999"), ("x", "one two")]


def test_queries_from_standard_input(spark, tmp_path, capsys, monkeypatch):
    import io

    ix.save(ix.build(docs(spark, *TEXTS), PLAIN), str(tmp_path / "data"))
    monkeypatch.setattr("sys.stdin", io.StringIO("owl\n\nlynx owl\n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    cli.main(["search", str(tmp_path / "data"), "-k", "1", "-t", "2"])
    assert spark.conf.get("spark.sql.shuffle.partitions") == "2"
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [x.split()[:3] for x in capsys.readouterr().out.splitlines() if " Q0 " in x] == [["1", "Q0", "9"], ["3", "Q0", "9"]]


def test_sorted_map(spark, tmp_path):
    one = [("corea", 1), ("zorro", 5), ("kkkkkkk", 50), ("pechino", 0), ("cisterna", 100)]
    two = [("corea", 4), ("banano", 5), ("ewew", 50), ("pacone", 0), ("pechino", 69), ("cisterna", 150)]
    a, b = (SortedMap.write(spark.createDataFrame(x, "key string, v long"), str(tmp_path / n), files=3) for x, n in ((one, "a"), (two, "b")))
    assert "corea" in a and "autocisterna" not in a and "aaa" not in a and a.size() == 5
    assert [r.key for r in a.ordered().collect()] == sorted(k for k, _ in one)
    assert [r.v for r in a.find("zorro").collect()] == [5] and a.find().count() == 0
    merged = SortedMap.merge([a, b], {"v": F.sum})
    assert {r.key: r.v for r in merged.rows.collect()} == {"banano": 5, "cisterna": 250, "corea": 5, "ewew": 50, "kkkkkkk": 50, "pacone": 0, "pechino": 69, "zorro": 5}


def test_sources_run_and_cli(spark, tmp_path, capsys):
    (tmp_path / "c.tsv").write_text("caffe\tbanano\nno tab here\nbabe\tbanano banano\tmore\nbeef\tbanano\n")
    (tmp_path / "q.tsv").write_text("7\tbanano\nx\tbanano\n8\t\n")
    found, corrupt = read_collection(spark, str(tmp_path / "c.tsv"))
    assert [r.docno for r in found.collect()] == ["caffe", "babe", "beef"] and corrupt.count() == 1
    assert found.where("docno = 'babe'").first().text == "banano banano\tmore"
    queries, bad = read_queries(spark, str(tmp_path / "q.tsv"))
    assert [(r.qid, r.text) for r in queries.collect()] == [(7, "banano")] and bad.count() == 1
    numbered = ix.with_docids(found)
    assert sorted(r.docid for r in numbered.collect()) == [1, 2, 3]
    cli.main(["build", str(tmp_path / "c.tsv"), str(tmp_path / "data"), "--no-stemmer"])
    cli.main(["search", str(tmp_path / "data"), "-q", "more", "-k", "2", "-r", "R", "-s", "tfidf"])
    assert capsys.readouterr().out.splitlines()[-1] == "1 Q0 babe 1 1.58496 R"
    cli.main(["search", str(tmp_path / "data"), "-b", str(tmp_path / "q.tsv"), "-o", str(tmp_path / "run"), "-a", "bmm"])
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "run").glob("part-*")) == 3


def test_stream_of_queries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("1\twolf bear\nbad\tline\n")
    i = ix.build(docs(spark, *TEXTS), PLAIN)
    stream = answer(i, query_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), k=3)
    assert stream.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert got(rows) == brute(TEXTS, "wolf bear", 3, BM25())


def test_query_terms_are_distinct(spark):
    i = ix.build(docs(spark, "wolf"), NormalizerConfig.english())
    assert [tuple(r) for r in query_terms(asked(spark, "Wolves wolves the WOLVES"), i).collect()] == [(1, "wolv")]


def test_run_lines_have_six_digits(spark):
    df = spark.createDataFrame([(1, "d", 1, 12.3456789), (1, "e", 2, 0.000012345678), (1, "f", 3, 2.0)], "qid long, docno string, rank int, score double")
    assert [r.line for r in run_lines(df, "R").orderBy("rank").collect()] == ["1 Q0 d 1 12.3457 R", "1 Q0 e 2 1.23457e-05 R", "1 Q0 f 3 2 R"]
