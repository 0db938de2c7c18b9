"""The driver's contract, with and without the training-data operators."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"qid", "docno", "docid", "rank", "score"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["tokens", "doc_index", "topk_or_bm25", "legacy_and", "topk_pruned_tfidf", "size_parts", "term_blocks", "trec_run", "mojibake_fix", "tsv_round_trip", "terms_by_sigma", "next_geq", "vbyte_round_trip", "unary_round_trip", "stem_pipeline"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = [sorted(map(tuple, x[columns].itertuples(index=False)), key=repr) for x in (got, want)]
    assert rows[0] == rows[1]


def test_mojibake_of_whole_documents(spark, tmp_path):
    import duckdb

    repairs = [
        ("AntonÃ\xadn DvorÃ¡k (1841â\x80\x931904)", "Antonín Dvorák (1841–1904)"),
        ("café", "café"),
        ("uk € Ã¡", "uk € Ã¡"),
        ("second half only: plain plain Ã\xa0", "second half only: plain plain à"),
        ("", ""),
    ]

    def plain(t):
        if t is None or not any("\x80" <= c <= "\xa0" or c == "\xad" for c in t):
            return t
        try:
            return t.encode("latin-1").decode()
        except UnicodeError:
            return t

    texts = [a for a, _ in repairs] + [None, "plain " * 5000 + "DvorÃ¡k Ã\xad", "no\xa0break", "â\x80\x93 and 漢", "Ã¡ but no control", "\xad", "two\nlines Ã\xa0"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.fixed for r in entry.queries()["mojibake_fix"](spark, str(tmp_path)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert [got[i] for i in range(len(repairs))] == [b for _, b in repairs]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.sql(entry.oracle_sql()["mojibake_fix"]).fetchall()) == got


def test_entry_without_the_llm_package(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name == 'corpus_pipeline' or name.startswith('tessera.llm'): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        f"sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'topk_or_bm25' in q and not any(x.startswith('op') for x in q) and 'pipeline' not in q, list(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
