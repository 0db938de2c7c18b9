"""Upper bounds of scores: by term, by block of postings, and by range of document ids.

A score is a posting's own part times the term's weight, which is nowhere below 0, so the greatest
parts are found first and weighted then: no posting is joined with the lexicon for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import session
from tessera.functions.scoring import BM25, TFIDF, idf
from tessera.operators.index import RANGE, TASK_BYTES, Index

#: Postings in a block.
BLOCK = 15_000
#: Columns of what ``cut_blocks`` returns.
BLOCKS = ["term", "block", "n", "bm25", "tfidf", "last_docid", "df"]


def parts_of_scores(index: Index) -> tuple[Column, Column]:
    """A posting's own parts of both scores."""
    one = F.lit(1.0)
    return BM25()(F.col("tf"), one, F.col("dl"), F.lit(index.avgdl)), TFIDF()(F.col("tf"), one)


def greatest(index: Index) -> list[Column]:
    """Aggregates of postings: their number and the greatest parts of both scores."""
    bm25, tfidf = parts_of_scores(index)
    return [F.count("*").alias("n"), F.max(bm25).alias("bm25"), F.max(tfidf).alias("tfidf")]


def weighted_bounds(rows: DataFrame, index: Index, *columns: Column | str, ending: str = "ub") -> DataFrame:
    """``columns`` and the greatest scores, from those parts and the term's ``df``."""
    weight = idf(F.lit(index.n_docs), F.col("df"))
    return rows.select(*columns, (F.col("bm25") * weight).alias(f"bm25_{ending}"), (F.col("tfidf") * weight).alias(f"tfidf_{ending}"))


def term_sigma(index: Index) -> DataFrame:
    """(term, df, bm25_sigma, tfidf_sigma): the greatest score of each term; of a saved index, as saved."""
    if "bm25_sigma" in index.lexicon.columns:
        return index.lexicon.select("term", "df", "bm25_sigma", "tfidf_sigma")
    rows = index.postings.groupBy("term").agg(*greatest(index)).withColumnRenamed("n", "df")
    return weighted_bounds(rows, index, "term", "df", ending="sigma")


def numbered(postings: DataFrame, width: int = RANGE, n: int | None = None) -> DataFrame:
    """Postings with ``place``, their number in the term's list from 0, and ``df``.

    A frequent term is numbered range by range of ids; the counts of the ranges before are
    added, so no task sorts a whole list. ``n``: tasks that postings are shuffled to.
    """
    n = n or session.parts(postings, TASK_BYTES)
    rows = postings.withColumn("r", F.expr(f"docid div {width}"))
    whole = Window.partitionBy("term")
    ahead = F.coalesce(F.sum("n").over(whole.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("term", "r").agg(F.count("*").alias("n")).select("term", "r", ahead.alias("ahead"), F.sum("n").over(whole).alias("df"))
    local = F.row_number().over(Window.partitionBy("term", "r").orderBy("docid")) - 1
    joined = rows.repartition(n, "term", "r").withColumn("local", local).join(sizes, ["term", "r"])
    return joined.withColumn("place", (F.col("local") + F.col("ahead")).cast("long")).drop("r", "local", "ahead")


def cut_blocks(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of postings (piece, term, docid, bm25, tfidf) that come piece by piece, in order of term
    and document. The first and the last list of a piece may go on in another, so their
    postings are returned one by one, with neither ``block`` nor ``df``."""

    def cut(rows: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        sizes = ends - starts
        place = np.arange(ends[-1]) - np.repeat(starts, sizes)
        apart = np.repeat(edge, sizes)
        at = np.flatnonzero(apart | (place % block == 0))
        until = np.append(at[1:], ends[-1])
        best = [pa.array(np.maximum.reduceat(rows.column(c).to_numpy()[: ends[-1]], at)) for c in ("bm25", "tfidf")]
        number = pa.array(place[at] // block, mask=apart[at])
        df = pa.array(np.repeat(sizes, sizes)[at], mask=apart[at])
        return pa.RecordBatch.from_arrays([rows.column("term").take(pa.array(at)), number, pa.array(until - at), *best, rows.column("docid").take(pa.array(until - 1)), df], BLOCKS)

    def whole(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([0]), np.array([rows.num_rows]), np.array([True])

    def sliced(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return (rows.slice(i, 1 << 16) for i in range(0, rows.num_rows, 1 << 16))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last list, which may go on in the next batch
        opening = True  # whether it is the first of its piece
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and all(batch.column(c)[-1] == held[0].column(c)[0] for c in ("piece", "term")):
                if opening:
                    yield from sliced(cut(batch, *whole(batch)))
                else:
                    held.append(batch)  # nothing but that list
                continue
            rows = pa.concat_batches([*held, batch])
            piece, term = rows.column("piece").to_numpy(), rows.column("term")
            new_piece = piece[1:] != piece[:-1]
            new = new_piece | pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
            starts = np.append(0, np.flatnonzero(new) + 1)
            first = np.append(opening, new_piece[starts[1:] - 1])
            if len(starts) > 1:
                last = first[1:]  # before the first list of another piece
                yield from sliced(cut(rows, starts[:-1], starts[1:], first[:-1] | last))
            held, opening = [rows.slice(starts[-1])], bool(first[-1])
        if held:
            rows = pa.concat_batches(held)
            yield from sliced(cut(rows, *whole(rows)))

    return blocks


def _blocks_in_place(index: Index, block: int) -> DataFrame:
    """What ``cut_blocks`` finds in the files of a saved index, which hold lists in order. Written, as
    both parts of it must come from the same reading."""
    session.ship_code(index.postings.sparkSession)
    bm25, tfidf = parts_of_scores(index)
    piece = F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("piece")
    rows = index.postings.select(piece, "term", "docid", bm25.alias("bm25"), tfidf.alias("tfidf"))
    return session.materialize(rows.mapInArrow(cut_blocks(block), "term string, block long, n long, bm25 double, tfidf double, last_docid long, df long"), "blocks")


def term_blocks(index: Index, block: int = BLOCK) -> DataFrame:
    """(term, block, n, bm25_ub, tfidf_ub, last_docid), ceil(df / block) rows for each term. Of a
    saved index only lists at either end of a file's part are shuffled."""
    bm25, tfidf = parts_of_scores(index)
    n = session.parts(index.postings, TASK_BYTES)
    cut = _blocks_in_place(index, block) if index.buckets else None
    if cut is None:
        rows = index.postings.select("term", "docid", bm25.alias("bm25"), tfidf.alias("tfidf"))
    else:
        rows = cut.where("block IS NULL").select("term", F.col("last_docid").alias("docid"), "bm25", "tfidf")
    rows = numbered(rows, n=n).groupBy("term", F.expr(f"place div {block}").alias("block"))
    rows = rows.agg(F.count("*").alias("n"), F.max("bm25").alias("bm25"), F.max("tfidf").alias("tfidf"), F.max("docid").alias("last_docid"), F.max("df").alias("df"))
    if cut is not None:
        rows = rows.unionByName(cut.where("block IS NOT NULL"))
    return weighted_bounds(rows, index, "term", "block", "n", "last_docid").select("term", "block", "n", "bm25_ub", "tfidf_ub", "last_docid")


def block_stats(index: Index, block: int = BLOCK) -> DataFrame:
    """(n_terms, max_blocks, avg_blocks) of the lists of blocks."""
    blocks = index.lexicon.select(F.ceil(F.col("df") / block).cast("long").alias("b"))
    return blocks.agg(F.count("*").alias("n_terms"), F.max("b").alias("max_blocks"), F.avg("b").alias("avg_blocks"))


def range_bounds(index: Index, width: int) -> DataFrame:
    """(term, rng, n, bm25_ub, tfidf_ub), rng being docid div width: aligned across terms. Postings
    are shuffled by term once, and each task holds a bounded number of them."""
    if index.bounds is not None and index.width == width:
        return index.bounds.select("term", "rng", "n", "bm25_ub", "tfidf_ub")
    rows = index.postings.select("term", "docid", "tf", "dl").repartition(session.parts(index.postings, TASK_BYTES), "term")
    rows = rows.groupBy("term", F.expr(f"docid div {width}").alias("rng")).agg(*greatest(index))
    return weighted_bounds(rows.withColumn("df", F.sum("n").over(Window.partitionBy("term"))), index, "term", "rng", "n")
