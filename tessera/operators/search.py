"""Ranked retrieval for batches of queries.

A batch that is read from few bytes is sent to all tasks. The postings of its terms are then
shuffled once, by range of document ids, and all that follows for a document (its terms' weights,
its scores for each query, its place among the best of its task) happens in the task that holds its
range. Only the best of each task move on. Other batches are joined with the lists by shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import session
from tessera.functions.scoring import BM25, TFIDF, idf
from tessera.operators.bounds import greatest, range_bounds, term_sigma, weighted_bounds
from tessera.operators.index import TASK_BYTES, WIDTH, Index, stemmed, tokens

K = 10
#: Bytes of the files of a batch of queries that is sent to all tasks.
FEW_BYTES = 4 << 20
#: Document ids in a range whose postings a task holds together.
RANGE = 16
#: What a bound may fall short of a score by, for rounding; ranks go by scores rounded to 6 digits.
SLACK = 1e-6


def query_terms(queries: DataFrame, index: Index) -> DataFrame:
    """(qid, term), distinct, normalised as the documents were. ``queries`` has qid and text."""
    rows = tokens(queries, index.config, "qid", "text").withColumnRenamed("docid", "qid")
    if index.config.stem:
        rows = stemmed(rows, ["qid"])
    return rows.distinct()


def few(terms: DataFrame) -> bool:
    """Whether a batch is known to be small. Only speed depends on it."""
    return 0 < session.input_bytes(terms) <= FEW_BYTES


def _sent(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows``, no more than a few for each of a query's terms, with a broadcast asked for if those are few."""
    return F.broadcast(rows) if few(terms) else rows


def _weighted(terms: DataFrame, index: Index) -> tuple[DataFrame, list[str]]:
    """Known terms with df and idf, and what they are joined with postings by."""
    terms, keys = index.placed(terms)
    return index.lexicon.select(*keys, "df").join(_sent(terms, terms), keys).select("qid", *keys, "df", idf(F.lit(index.n_docs), F.col("df")).alias("idf")), keys


def scored_postings(terms: DataFrame, index: Index, scorer: BM25 | TFIDF = BM25()) -> DataFrame:
    """(qid, term, docid, score) of every posting of a query's terms."""
    weighted, keys = _weighted(terms, index)
    return index.postings.join(_sent(weighted, terms), keys).select("qid", "term", "docid", scorer(F.col("tf"), F.col("idf"), F.col("dl"), F.lit(index.avgdl)).alias("score"))


def gathered(index: Index, terms: DataFrame, width: int) -> DataFrame:
    """The postings of all terms asked for, with ``rng``, all of a range of ids in one partition."""
    needed, keys = index.placed(terms.select("term").distinct())
    held = index.postings.join(F.broadcast(needed), keys, "left_semi").select("term", "docid", "tf", "dl", F.expr(f"docid div {width}").alias("rng"))
    return held.repartition(session.parts(index.postings, TASK_BYTES), "rng")


def document_scores(terms: DataFrame, index: Index, scorer: BM25 | TFIDF = BM25(), width: int = RANGE, kept: DataFrame | None = None) -> DataFrame:
    """(qid, rng, docid, score, matched) of all documents with a term of the query, or of those in
    the ranges of ``kept`` (qid, rng). Of few queries a range stays in one partition."""
    if few(terms):
        rows = gathered(index, terms, width)
        if kept is not None:
            rows = rows.join(kept.groupBy("rng").agg(F.collect_list("qid").alias("qids")), "rng")
        weighted = _weighted(terms, index)[0].select("qid", "term", "idf")
        rows = rows.join(F.broadcast(weighted), "term")
        if kept is not None:
            rows = rows.where("array_contains(qids, qid)")
        rows = rows.select("qid", "rng", "docid", scorer(F.col("tf"), F.col("idf"), F.col("dl"), F.lit(index.avgdl)).alias("score"))
    else:
        rows = scored_postings(terms, index, scorer).withColumn("rng", F.expr(f"docid div {width}"))
        if kept is not None:
            rows = rows.join(kept, ["qid", "rng"], "left_semi")
    return rows.groupBy("qid", "rng", "docid").agg(F.sum("score").alias("score"), F.count("*").alias("matched"))


def terms_by_sigma(terms: DataFrame, index: Index, scorer: BM25 | TFIDF = BM25()) -> DataFrame:
    """(qid, place, term, sigma): the known terms of each query by their greatest score, least first."""
    column = "bm25_sigma" if scorer.needs_length else "tfidf_sigma"
    terms, keys = index.placed(terms)
    sigma = index.lexicon if column in index.lexicon.columns else term_sigma(index)
    if not set(keys) <= set(sigma.columns):
        keys = ["term"]
    found = sigma.select(*keys, F.round(column, 6).alias("sigma")).join(_sent(terms, terms), keys)
    return found.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("sigma", "term")).cast("long").alias("place"), "term", "sigma")


def next_geq(wanted: DataFrame, index: Index) -> DataFrame:
    """(qid, term, target, docid): for each row of (qid, term, target), the first document of the
    term's list at or after ``target``; none if the list ends before."""
    wanted, keys = index.placed(wanted)
    return index.postings.join(_sent(wanted, wanted), keys).where(F.col("docid") >= F.col("target")).groupBy("qid", "term", "target").agg(F.min("docid").alias("docid"))


def top_k(scores: DataFrame, k: int, *within: str) -> DataFrame:
    """(qid, docid, score, rank): greatest score rounded to 6 digits first, then the least id. Ranks
    are those among the query's rows of the same ``within``, which are returned too."""
    if k <= 0:
        scores = scores.where("false")
    order = Window.partitionBy("qid", *within).orderBy(F.round("score", 6).desc(), F.col("docid"))
    return scores.select("qid", *within, "docid", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= max(k, 1))


def _named(best: DataFrame, index: Index) -> DataFrame:
    return best.join(index.doc_index.select("docid", "docno"), "docid").select("qid", "docno", "docid", "rank", "score")


def search(index: Index, queries: DataFrame, k: int = K, mode: str = "or", scorer: BM25 | TFIDF = BM25(), width: int | None = None, seed_ranges: int = 3) -> DataFrame:
    """(qid, docno, docid, rank, score) of the k best documents of each query.

    Modes: ``or`` any term; ``and`` all terms; ``and-lists`` all terms whose lists haven't
    ended before the document (see ``ended_lists``); ``pruned`` the answer of ``or``, scoring
    only ranges of ids (of ``width``; by default those that a saved index has bounds for) whose
    bounds can reach it. An unknown mode is ``or``. Queries without known terms have no rows.
    """
    terms = query_terms(queries, index)
    if mode == "pruned":
        return _named(pruned(index, terms, k, scorer, width or index.width or WIDTH, seed_ranges), index)
    scores = document_scores(terms, index, scorer)
    if mode in ("and", "and-lists"):
        wanted = terms.groupBy("qid").agg(F.count("*").alias("wanted"))  # unknown terms count
        scores = scores.join(_sent(wanted, terms), "qid")
        missing = F.col("matched") if mode == "and" else F.col("matched") + F.size(F.filter("ends", lambda e: e < F.col("docid")))
        if mode == "and-lists":
            scores = scores.join(_sent(ended_lists(terms, index), terms), "qid")
        scores = scores.where(missing == F.col("wanted"))
    return _named(top_k(scores, k), index)


def ended_lists(terms: DataFrame, index: Index) -> DataFrame:
    """(qid, ends): the last document of each term's list, for queries all of whose terms are known.

    Read literally, the conjunctive scan drops a list when it ends, and from there on asks
    only for the terms that are left.
    """
    needed, keys = index.placed(terms.select("term").distinct())
    last = index.postings.join(_sent(needed, terms), keys).groupBy("term").agg(F.max("docid").alias("last"))
    ends = terms.join(last, "term", "left").groupBy("qid").agg(F.collect_list("last").alias("ends"), F.count("*").alias("n"))
    return ends.where(F.size("ends") == F.col("n")).select("qid", "ends")


def pruned(index: Index, terms: DataFrame, k: int, scorer: BM25 | TFIDF, width: int, seed_ranges: int) -> DataFrame:
    """Top k by bounds: the ranges of greatest bound give a threshold, and ranges that reach it are scored."""
    ranked = session.materialize(query_bounds(index, terms, scorer, width), "ranges")  # narrow, and read twice
    first = Window.partitionBy("qid").orderBy(F.col("ub").desc(), F.col("rng"))
    best = ranked.withColumn("place", F.row_number().over(first)).where(F.col("place") <= seed_ranges).select("qid", "rng")
    seeds = scored_postings(terms, index, scorer).withColumn("rng", F.expr(f"docid div {width}")).join(_sent(best, terms), ["qid", "rng"], "left_semi")
    found = top_k(seeds.groupBy("qid", "docid").agg(F.sum("score").alias("score")), k)
    threshold = found.where(F.col("rank") == max(k, 1)).select("qid", F.col("score").alias("threshold"))  # none if fewer than k
    kept = ranked.join(_sent(threshold, terms), "qid", "left").where(F.col("threshold").isNull() | (F.col("ub") >= F.col("threshold") - SLACK))
    return top_k(document_scores(terms, index, scorer, width, kept.select("qid", "rng")), k)


def query_bounds(index: Index, terms: DataFrame, scorer: BM25 | TFIDF, width: int) -> DataFrame:
    """(qid, rng, ub): what no document of the range scores above. From the saved bounds where the
    index has them for ranges of this width, else from the postings of the terms asked for."""
    column = "bm25_ub" if scorer.needs_length else "tfidf_ub"
    placed, keys = index.placed(terms)
    saved = index.bounds is not None and index.width == width
    if few(terms):
        if saved:
            rows = index.bounds.join(F.broadcast(placed.select(*keys).distinct()), keys, "left_semi").select("term", "rng", column)
            rows = rows.repartition(session.parts(index.bounds, TASK_BYTES), "rng").join(F.broadcast(terms), "term")
        else:
            rows = gathered(index, terms, width).groupBy("term", "rng").agg(*greatest(index))
            rows = weighted_bounds(rows.join(F.broadcast(_weighted(terms, index)[0].select("qid", "term", "df")), "term"), index, "qid", "rng")
    else:
        bounds, keys = (index.bounds, keys) if saved else (range_bounds(index, width), ["term"])
        rows = placed.join(bounds.select(*keys, "rng", column), keys)
    return rows.groupBy("qid", "rng").agg(F.sum(column).alias("ub"))


def merge_parts(results: DataFrame, k: int) -> DataFrame:
    """The k best of results found in parts of the collection (qid, docid, score, ...)."""
    return top_k(results, k)
