"""Golden values of normalisation, stemming, codes and scores."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codecs, scoring
from tessera.functions import normalize as nz
from tessera.functions.stem import stem
from tessera.operators import index as ix

TWINKLE = " ".join(["Twinkle, twinkle, little bat!", "How I wonder what you're at!", "Up above the world you fly,", "Like a tea-tray in the sky."])


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


def test_punctuation_keeps_byte_length(spark):
    text = "Nel mezzo,, del cammin. ¶ nuovo ⸻ molto lungo ⸻ fine."
    got = one(spark, text, nz.strip_punctuation)
    assert len(got.encode()) == len(text.encode())
    assert got.split() == "Nel mezzo del cammin nuovo molto lungo fine".split()


def test_terms_with_and_without_stop_words(spark):
    plain = one(spark, TWINKLE, lambda c: nz.terms(c, nz.NormalizerConfig.plain()))
    assert plain == [*"twinkle twinkle little bat how i wonder what".split(), *"you re at up above the world".split(), *"you fly like a tea tray in the sky".split()]
    kept = one(spark, TWINKLE, lambda c: nz.terms(c, nz.NormalizerConfig.english()))
    assert [stem(w) for w in kept] == "twinkl twinkl littl bat wonder world like tea tray sky".split()


def test_double_encoding(spark):
    raw = "AntonÃ­n DvorÃ¡k (1841â\u0080\u00931904)"
    assert one(spark, raw, nz.fix_encoding) == "Antonín Dvorák (1841–1904)"
    for same in ("café", "uk € Ã¡", "", "plain"):
        assert one(spark, same, nz.fix_encoding) == same


def test_lower_case(spark):
    assert one(spark, "ÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÀÇÙÆ", nz.lower_latin1) == "èéêëìíîïðñòóôõöøùúûüýàçùæ"
    assert one(spark, "ßX×", nz.lower_latin1) == "ÿx÷"
    assert one(spark, "ABCXYZ1234567890É", nz.lower_ascii) == "abcxyz1234567890É"


def test_long_and_empty_terms(spark):
    assert one(spark, "a" * 240 + " " + "b" * 241 + "  \t ", lambda c: nz.terms(c, nz.NormalizerConfig.plain())) == ["a" * 240]


def test_stop_words():
    assert len(set(nz.stop_words())) == 1155
    assert "fly" in nz.stop_words() and "little" not in nz.stop_words()


@pytest.mark.parametrize(
    "word, want",
    [("consigned", "consign"), ("knightly", "knight"), ("hopping", "hop"), ("hoping", "hope"), ("cries", "cri"), ("ties", "tie"), ("relational", "relat"), ("abilities", "abil"), ("dying", "die"), ("gas", "gas"), ("gaps", "gap"), ("controlling", "control"), ("generously", "generous"), ("sky", "sky"), ("by", "by"), ("say", "say"), ("skis", "ski"), ("proceed", "proceed"), ("electricity", "electr")],
)
def test_stem(word, want):
    assert stem(word) == want


@given(st.text("abcdefghijklmnopqrstuvwxyz'", max_size=20))
@settings(max_examples=300, deadline=None)
def test_stem_never_fails(word):
    assert len(stem(word)) <= len(word) + 1


def test_unary():
    data = bytes([0x03, 0x6E, 0x91, 0x75])
    values = [3, *[1] * 6, *(4, 3, 2, 1), *(1, 2, 1), *(3, 2, 4)]
    assert codecs.unary_decode(data)[: len(values)] == values
    assert codecs.unary_decode(data, 3)[: len(values) - 1] == values[1:]
    assert codecs.unary_encode(values) == data


@given(st.lists(st.integers(1, 40)))
@settings(max_examples=100, deadline=None)
def test_unary_round_trip(values):
    got = codecs.unary_decode(codecs.unary_encode(values))
    assert got[: len(values)] == values and set(got[len(values) :]) <= {1}


def test_vbyte():
    assert codecs.vbyte_decode(bytes([0x03, 0xEE, 0x91, 0x04])) == [3, 67822]
    assert [len(codecs.vbyte_encode([v])) for v in (0, 10, 1000, 1000000)] == [1, 1, 2, 3]


@given(st.lists(st.integers(0, (1 << 64) - 1)))
@settings(max_examples=100, deadline=None)
def test_vbyte_round_trip(values):
    assert codecs.vbyte_decode(codecs.vbyte_encode(values)) == values


def test_code_columns(spark):
    df = spark.createDataFrame([([3, 1, 5],), (None,)], "v array<bigint>")
    for encode, decode in ((codecs.vbyte_encode_column, codecs.vbyte_decode_column), (codecs.unary_encode_column, codecs.unary_decode_column)):
        rows = [r[0] for r in df.select(decode(encode(F.col("v")))).collect()]
        assert rows[0][:3] == [3, 1, 5] and rows[1] is None
    packed = spark.range(1).select(codecs.pack_offset(F.lit(9), F.lit(5)).alias("p")).select("p", *codecs.unpack_offset(F.col("p"))).first()
    assert tuple(packed) == (77, 9, 5)
    assert codecs.common_prefix_length("banano", "bandito") == 3


def test_scores(spark):
    row = spark.range(1).select(
        scoring.BM25()(F.lit(3), F.lit(2.0), F.lit(120), F.lit(100.0)),
        scoring.TFIDF()(F.lit(8), F.lit(2.0)),
        scoring.TFIDF(fast_log=True)(F.lit(9), F.lit(2.0)),
        scoring.TFIDF()(F.lit(0), F.lit(2.0)),
        scoring.idf(F.lit(10), F.lit(4)),
    ).first()
    assert row[0] == pytest.approx(3 / (0.82 * (0.32 + 0.68 * 1.2) + 3) * 2)
    assert tuple(row[1:4]) == (8.0, 8.0, 0.0)
    assert row[4] == pytest.approx(math.log2(2.5))
    assert isinstance(scoring.scorer("unknown"), scoring.BM25) and isinstance(scoring.scorer("tfidf"), scoring.TFIDF)


def test_stem_pipeline(spark):
    docs = spark.createDataFrame([(1, TWINKLE)], "docid long, text string")
    got = {r.term: r.tf for r in ix.frequencies(docs, nz.NormalizerConfig.english()).collect()}
    assert got == {"twinkl": 2, "littl": 1, "bat": 1, "wonder": 1, "world": 1, "like": 1, "tea": 1, "tray": 1, "sky": 1}


def test_codes_without_python_are_the_same(spark):
    values = [10, 100, 1000, 10000, 0xCAFEBABE, 12345, 0xDEADBEEF, 0, 127, 128]
    unary = [10, 20, 10, 1, 1, 1, 1, 8, 23, 1, 5, 1, 1]
    row = spark.createDataFrame([(values, unary)], "v array<long>, u array<long>").select(codecs.vbyte_bytes(F.col("v")).alias("v"), codecs.unary_bytes(F.col("u")).alias("u")).first()
    assert bytes(row.v) == codecs.vbyte_encode(values) and bytes(row.u) == codecs.unary_encode(unary)


def test_scratch_is_shared_and_emptied(spark, tmp_path):
    import os

    from tessera import session

    table = session.materialize(spark.range(5), "five")
    path = table._tessera_path.removeprefix("file://")
    assert os.path.isdir(path) and table.count() == 5
    session.drop(table, table)
    assert not os.path.exists(path)
    other = session.materialize(spark.range(3), "three")._tessera_path.removeprefix("file://")
    folder = os.path.dirname(other)
    held = f"{folder}-held"
    os.rename(folder, held)  # what other tests wrote
    session.materialize(spark.range(3), "three")
    session.clear(spark)
    assert not os.path.exists(folder)
    os.rename(held, folder)

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Cluster)
