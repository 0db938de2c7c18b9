"""Null ids, repeated rows, hot keys and clashing columns, operator by operator and through the pipeline."""

import random
from collections import Counter

import pytest

from tessera.llm import chat, exact_dedup, mixing, near_dedup, pii, places, quality_rules, secret_scan, sentencepiece_codec, substring_dedup, token_files
from tessera.llm.queries import tokenizer
from tests.llm import fixtures as fx

BIG = 2**53 + 1  # beyond what a double holds


def rows_with_nulls():
    rows = [(BIG + 2 * i, "w " * (i % 17 + 1), None, "s" if i % 3 else None, None) for i in range(60)]
    return [*rows, (None, "w w w", None, "s", None), (None, "w w w", None, "s", None), (None, None, None, None, None), (BIG, "w w", None, "s", None)]


def test_mixing_keeps_ids_beside_a_null_one(spark):
    rows = rows_with_nulls()
    df = fx.frame(spark, rows, True)
    got = mixing.report(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    size = {(r[0], r[3], len(fx.byte_words(r[1]))) for r in rows}
    assert all(any((r.doc_id, s, r.size) in size for s in ("s", None)) and r.taken in (0, r.size, 2 * r.size) for r in got)
    mixed = mixing.mix(df).collect()
    assert sum(len(fx.byte_words(r.text)) for r in mixed) == sum(r.taken for r in got)
    assert Counter(r.doc_id for r in mixed if r.text) <= Counter({i: 2 * n for i, n in Counter(r[0] for r in rows).items()})


def exact_with_nulls(rows):
    low = [(r[1] or "").encode().translate(fx.LOW) for r in rows]
    out = []
    for r, t in zip(rows, low):
        ids = [x[0] for x, u in zip(rows, low) if u == t]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), keep is None or r[0] == keep))
    return sorted(out, key=repr)


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup_with_null_ids(spark, monkeypatch, collide):
    rows = [(1, "aa", None, None, None), (2, "bb", None, None, None), (None, "cc", None, None, None), (None, "aa", None, None, None), (None, "Cc", None, None, None), (2, "bb", "x", None, None), (None, "dd", None, None, None)]
    if collide:  # every text gets one fingerprint, so bytes must tell them apart
        monkeypatch.setattr(exact_dedup, "fingerprint", lambda data: (7, 7, 7, 7))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(fx.frame(spark, rows, True)).collect()), key=repr)
    assert got == exact_with_nulls(rows)
    kept = exact_dedup.deduplicate(fx.frame(spark, rows, True))
    assert sorted(r.text.lower() for r in kept.collect()) == ["aa", "bb", "cc", "dd"] and "clash" in kept.columns[5:] + ["clash"]


def test_places_are_those_of_the_files(spark, tmp_path):
    spark.range(100_000).selectExpr("id", "id % 7 as _metadata", "'x' as text").repartition(3).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    for df in (docs, docs.where("id % 2 = 0"), docs.select("id", "text"), docs.union(docs), docs.where("rand(3) < 0.5"), docs.join(docs.select("id").where("id < 10"), "id")):
        found = places.located(df)
        assert found.select(*places.PLACE).distinct().count() == found.count()
        gone = found.where("id % 3 = 0")
        assert sorted(r.id for r in places.keep(found, gone).select("id").collect()) == sorted(r.id for r in found.where("id % 3 <> 0").select("id").collect())
    assert places.located(docs)._jdf.queryExecution().analyzed().toString().count("Relation") == 1


def test_decisions_in_ranges_of_rows(spark, tmp_path):
    spark.range(5000).selectExpr("id", "'x' as text").coalesce(1).write.parquet(str(tmp_path / "t"))
    found = places.located(spark.read.parquet(str(tmp_path / "t")))
    decided = places.Decisions.write(found.where("id % 5 = 0").selectExpr(*places.PLACE, "cast(id % 4 as int) as number"), found, 9, log_range=4)
    got = {r.id: r.number for r in found.withColumn("number", decided.column()).collect()}
    assert got == {i: i % 4 if i % 5 == 0 else 9 for i in range(5000)}
    none = places.Decisions.write(found.where("false").selectExpr(*places.PLACE, "0 as number"), found, 1)
    assert found.where(none.column() == 1).count() == 5000


def test_a_hot_passage_makes_no_pairs(spark, monkeypatch):
    """One passage in very many unlike documents: rows that the pair join gives stay in proportion."""
    rng = random.Random(5)
    passage = " ".join(f"license{i}" for i in range(20))
    rows = [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(40)) + f" {passage}", None, None, None) for i in range(20_000)]
    rows += [(30_000 + i, rows[i][1] + " tail", None, None, None) for i in range(0, 50)]
    made = []
    materialize = near_dedup.session.materialize

    def counting(df, name):
        out = materialize(df, name)
        if name in ("entries", "first", "second"):
            made.append((name, out.count()))
        return out

    monkeypatch.setattr(near_dedup.session, "materialize", counting)
    got = near_dedup.classes(spark.createDataFrame(rows, fx.SCHEMA).repartition(8)).where("not kept").collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(30_000 + i, i) for i in range(50)]
    assert dict(made)["entries"] < 20_000 and dict(made)["first"] + dict(made)["second"] < 1_000, made


def test_boilerplate_documents_meet_by_runs(spark):
    """Documents of common values only: each sentence is in very many documents, each document is another choice of them."""
    rng = random.Random(6)
    sentences = [" ".join(f"s{i}w{j}" for j in range(9)) for i in range(14)]
    rows = []
    for i in range(300):
        chosen = rng.sample(range(14), 9)
        rows.append((i, " ".join(sentences[j] for j in chosen), None, None, None))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(sentences[j] for j in chosen) + " end of it", None, None, None))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.classes(fx.frame(spark, rows)).collect()}
    assert got == fx.near_classes(rows)


def test_chances_of_common_runs():
    """The counted chances against simulated ones, and the sizes they allow."""
    import numpy as np

    rng = np.random.default_rng(0)
    for union, c in ((80, 22), (100, 26), (400, 26)):
        shared = np.zeros(union, bool)
        shared[: -(-union * 80 // 100)] = True
        x = np.array([rng.permutation(shared)[:64] for _ in range(20_000)])
        runs = (x[:, :-2] & x[:, 1:-1] & x[:, 2:]).sum(1)
        for few in (c, 20, 15):
            assert abs((runs < min(few, 24)).mean() - near_dedup.miss(union, min(few, 24))) < 0.015
    sizes = near_dedup.least_runs()
    assert sorted(n for _, n in sizes) == [n for _, n in sizes] and sizes[-1][1] > 1000
    for c, n in sizes:
        assert n <= 51 or near_dedup.miss(n * 5 // 4, c) < near_dedup.MISS <= near_dedup.miss((n + 1) * 5 // 4, c) or (n + 1) * 5 // 4 == n * 5 // 4 or n == 1 << 15
    own = near_dedup._own_runs(np.arange(1, 3000), 80)
    assert own[0] == 1 and own[50] == 18 and own[63] <= 15 and (own >= 1).all() and (np.diff(own[63:]) <= 0).all()


@pytest.mark.parametrize("hot", [1, 3, 10])
def test_hot_windows_are_answered_where_they_stand(spark, hot):
    rows = fx.awkward(12)
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(5000 + i, f"own{i} {passage} end{i}", None, None, None) for i in range(40)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(fx.frame(spark, rows, True), hot=hot).collect()}
    assert got == {i: w[:3] for i, w in fx.without_repeats(rows).items()}


def test_token_files_of_one_id(spark):
    """Rows that share an id, or have none, fill several shards and keep their order."""
    rng = random.Random(7)
    rows = [(5 if i % 3 else None, " ".join(rng.choice(["zebra", "apple", "middle", "one", "two"]) for _ in range(30)), None, None, None) for i in range(90)] + [(9, "last", None, None, None)]
    manifest = token_files.write(fx.frame(spark, rows), tokenizer("word_bpe_49k.json"), shards=12)
    got = [(r.doc_id, r.start, r.n_tokens) for r in token_files.read(manifest).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and manifest.count() > 4


def test_rows_on_their_own_take_repeats_and_nulls(spark):
    text = "Mail jo@mail.com, key Xk29dPqLm38sVnQz71TbYcR4 " + "and words " * 20
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text, None, None, None), (None, None, None, None, None), (2, "", None, None, None), (3, text * 3000, None, None, None)]
    df = fx.frame(spark, rows, True)
    field = pii.fit(df)
    for found in (pii.detect(df, field), secret_scan.scan(df)):
        got = found.collect()
        by_id = Counter((r.doc_id, r.n_spans) for r in got)
        assert by_id[1, 1] == 2 and by_id[None, 1] == by_id[None, 0] == by_id[2, 0] == by_id[3, 3000] == 1
    judged = Counter((r.doc_id, r.n_words) for r in quality_rules.judge(df, quality_rules.DecisionList()).collect())
    assert judged[1, 44] == 2 and judged[None, 44] == judged[None, 0] == judged[2, 0] == judged[3, 44 * 3000] == 1
    coded = sentencepiece_codec.encode(df, tokenizer("piece_bpe_32k.model")).collect()
    assert Counter(r.doc_id for r in coded) == Counter(r[0] for r in rows) and all(r.round_trip for r in coded)


def test_fit_is_the_same_for_repeated_ids(spark):
    rows = [(i % 40, "good words here " * 9 if i % 2 else "$$$ ### bad %%% " * 9, None, None, None) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    a, b = (quality_rules.fit(spark.createDataFrame(r, fx.SCHEMA).repartition(n), labels) for r, n in ((rows, 1), (shuffled, 5)))
    assert a == b


def test_chat_with_repeated_rows_and_turn_numbers(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (3, None, "user", "a"), (3, 0, "user", "b"), (3, 0, "bot", "b"), (4, 0, "user", "x" * 200_000), (5, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.rendered for r in chat.render(df).collect()}
    assert got == {
        1: "<|user|>\nhi<|end|>\n" * 2 + "<|bot|>\nyo<|end|>\n",
        3: "<|user|>\na<|end|>\n<|bot|>\nb<|end|>\n<|user|>\nb<|end|>\n",
        4: "<|user|>\n" + "x" * 200_000 + "<|end|>\n",
        5: "<|user|>\n<|end|>\n",
    }


def through(spark, path, rows, labels):
    import corpus_pipeline

    fx.frame(spark, rows, True).drop("n_words").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(path))
        assert i == 4 or docs.columns == columns, name
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen.append(docs.collect())
    return seen


def test_pipeline_over_awkward_rows(spark, tmp_path):
    rng = random.Random(8)

    def text(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))

    rows = [(BIG + i, text(rng.randrange(25, 60)), "en", rng.choice(["s", "t", None]), 1) for i in range(40)]
    rows += [(None, rows[0][1], "en", "s", 1), (None, text(30), "en", "s", 1), rows[3], rows[3], (7, None, None, None, None), (8, "", None, "s", None), (9, text(30_000), "en", "s", 1), (10, rows[5][1].upper(), "en", "s", 1), (11, rows[6][1] + " more", "en", "t", 1)]
    rules, exact, near, mixed, coded = through(spark, tmp_path, rows, [(None, 0, 0), (BIG, None, None)])
    assert Counter(r.text for r in rules) == Counter(r[1] for r in rows if len(fx.byte_words(r[1])) >= 20)
    assert Counter(r.text.lower() for r in exact) == Counter({r.text.lower(): 1 for r in rules})
    assert {r.doc_id for r in exact if r.text == rows[0][1]} == {BIG} and not any(r.doc_id == 10 for r in exact)
    assert len(near) == len(exact) - 1 and {r.doc_id for r in exact} - {r.doc_id for r in near} == {BIG + 6}  # of those alike, the least id stays
    assert all(n <= 2 for n in Counter(r.text for r in mixed).values()) and {r.text for r in mixed} <= {r.text for r in near}
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in mixed) and all(r.round_trip for r in coded)


def test_pipeline_over_an_empty_table(spark, tmp_path):
    assert through(spark, tmp_path, [], []) == [[], [], [], [], []]
