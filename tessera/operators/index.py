"""Building, saving and opening the index tables.

postings(term, docid, tf, dl)   one row for each term of a document, with the document's length
doc_index(docid, docno, dl)     every document, those without terms too
lexicon(term, df)
and two numbers: documents and the sum of their lengths.

A saved index is laid out by bucket of the term, in files sorted by term and document, and has
score bounds besides: the greatest scores of each term in the lexicon, and (unless its width is
0) those of each term in each range of ids in

bounds(term, rng, n, bm25_ub, tfidf_ub)
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import session
from tessera.functions.normalize import NormalizerConfig, is_term, normal, words
from tessera.functions.stem import stem_column, text_counts

#: Bytes of postings in a bucket and in a file of a saved index, and buckets at most.
BUCKET_BYTES, FILE_BYTES, MOST_BUCKETS = 64 << 20, 16 << 20, 1 << 14
#: Bytes of texts, and of a saved index's postings, that a task takes after a shuffle.
TEXT_BYTES, TASK_BYTES = 4 << 20, 8 << 20
#: Document ids in a range that bounds are saved for.
WIDTH = 1024
#: Document ids in a range that is numbered on its own.
RANGE = 1 << 16


#: Tables of a saved index that are laid out by bucket.
SCHEMAS = {
    "postings": "term string, docid long, tf long, dl long, term_bucket int",
    "lexicon": "term string, df long, bm25_sigma double, tfidf_sigma double, term_bucket int",
    "bounds": "term string, rng long, n long, bm25_ub double, tfidf_ub double, term_bucket int",
}


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    doc_index: DataFrame
    lexicon: DataFrame
    n_docs: int
    doc_len_sum: int
    config: NormalizerConfig
    buckets: int = 0  # of a saved index; 0 if postings aren't laid out by bucket
    bounds: DataFrame | None = None  # of a saved index
    width: int = 0  # of the ranges that bounds are for

    @property
    def avgdl(self) -> float:
        return self.doc_len_sum / self.n_docs if self.n_docs else 0.0

    def metadata(self) -> DataFrame:
        spark = self.postings.sparkSession
        return spark.createDataFrame([(self.n_docs, self.doc_len_sum, self.avgdl)], "n_docs long, doc_len_sum long, avgdl double")

    def placed(self, terms: DataFrame) -> tuple[DataFrame, list[str]]:
        """``terms`` with what the index's tables are joined by: of a saved one, the bucket too, so
        that buckets without any of the terms aren't read."""
        if not self.buckets:
            return terms, ["term"]
        return terms.withColumn("term_bucket", term_bucket(self.buckets)), ["term", "term_bucket"]


def term_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def tokens(docs: DataFrame, config: NormalizerConfig = NormalizerConfig(), id_col: str = "docid", text_col: str = "text") -> DataFrame:
    """(docid, term), a row for each occurrence, before stemming."""
    exploded = docs.select(F.col(id_col).cast("long").alias("docid"), F.explode(words(F.col(text_col), config)).alias("term"))
    return exploded.where(is_term(F.col("term"), config))


def stemmed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace terms by their stems, row by row."""
    session.ship_code(rows.sparkSession)
    return rows.select(*keys, stem_column(F.col("term")).alias("term")).where("term <> ''")


def frequencies(docs: DataFrame, config: NormalizerConfig = NormalizerConfig(), id_col: str = "docid", text_col: str = "text") -> DataFrame:
    """(docid, term, tf, dl), all of a document in one partition. Only the texts are shuffled: the
    task that has a document splits it and counts (and stems) its terms, in Arrow batches of texts
    sorted by document. No row is made for each word."""
    session.small_splits(docs.sparkSession)
    session.ship_code(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("docid"), F.col(text_col).alias("text"))
    texts = texts.repartition(session.parts(docs, TEXT_BYTES), "docid").sortWithinPartitions("docid")
    return texts.select("docid", normal(F.col("text"), config).alias("text")).mapInArrow(text_counts(config), "docid long, term string, tf long, dl long")


def build(docs: DataFrame, config: NormalizerConfig = NormalizerConfig(), id_col: str = "docid", text_col: str = "text", docno_col: str | None = None) -> Index:
    """Index a collection; ids must be unique. Postings and documents are written to the scratch
    folder, terms are counted when they are asked for."""
    docno = F.col(docno_col) if docno_col else F.col(id_col).cast("string")
    tf = frequencies(docs.where(F.col(id_col).cast("long").isNotNull()), config, id_col, text_col)
    postings = session.materialize(tf.select("term", "docid", "tf", "dl"), "postings")
    lengths = postings.groupBy("docid").agg(F.max("dl").alias("dl"))
    doc_index = docs.select(F.col(id_col).cast("long").alias("docid"), docno.alias("docno")).join(lengths, "docid", "left").select("docid", "docno", F.coalesce("dl", F.lit(0).cast("long")).alias("dl"))
    doc_index = session.materialize(doc_index, "doc_index")
    lexicon = postings.groupBy("term").agg(F.count("*").alias("df"))
    n, total = doc_index.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return Index(postings, doc_index, lexicon, n, total, config)


def save(index: Index, path: str, buckets: int | None = None, width: int = WIDTH) -> Index:
    """Write the tables below ``path``, postings, lexicon and bounds by bucket of the term.

    Files are cut by ranges of bucket, term and document, so a term that is in most documents
    fills many of them, and no task sorts its whole list. Greatest scores are taken from the
    postings as they are then laid out, where a term's rows are side by side. ``width`` 0
    leaves the bounds by range out.
    """
    from tessera.operators.bounds import range_bounds, term_sigma  # which read an Index

    size = session.input_bytes(index.postings)
    buckets = buckets or min(max(1 << (int(size / BUCKET_BYTES)).bit_length(), 16), MOST_BUCKETS)

    def write(table: DataFrame, name: str, *order: str) -> None:
        cut = table.repartitionByRange(max(int(session.input_bytes(table) / FILE_BYTES) + 1, 8), term_bucket(buckets), *order)
        cut.withColumn("term_bucket", term_bucket(buckets)).sortWithinPartitions("term_bucket", *order).write.mode("overwrite").partitionBy("term_bucket").parquet(f"{path}/{name}")

    write(index.postings, "postings", "term", "docid")
    index.doc_index.write.mode("overwrite").parquet(f"{path}/doc_index")
    laid = replace(index, postings=index.postings.sparkSession.read.schema(SCHEMAS["postings"]).parquet(f"{path}/postings"), bounds=None, width=0)
    sigma = session.materialize(term_sigma(laid), "sigma")
    write(sigma, "lexicon", "term")
    session.drop(sigma)
    if width:
        ranges = session.materialize(range_bounds(laid, width), "bounds")
        write(ranges, "bounds", "term", "rng")
        session.drop(ranges)
    c = index.config
    index.metadata().withColumns({"buckets": F.lit(buckets), "width": F.lit(width), "fix_encoding": F.lit(c.fix_encoding), "latin1_case": F.lit(c.latin1_case), "stop_words": F.lit(c.stop_words), "stem": F.lit(c.stem)}).write.mode("overwrite").parquet(f"{path}/metadata")
    return load(index.postings.sparkSession, path)


def load(spark: SparkSession, path: str) -> Index:
    m = spark.read.parquet(f"{path}/metadata").first()
    config = NormalizerConfig(m.fix_encoding, m.latin1_case, m.stop_words, m.stem)
    session.small_splits(spark)
    tables = {k: spark.read.schema(v).parquet(f"{path}/{k}") for k, v in SCHEMAS.items() if m.width or k != "bounds"}  # an empty index has no files to read it from
    return Index(tables["postings"], spark.read.parquet(f"{path}/doc_index"), tables["lexicon"], m.n_docs, m.doc_len_sum, config, m.buckets, tables.get("bounds"), m.width)


def with_docids(docs: DataFrame, first: int = 1) -> DataFrame:
    """Dense ids in source order, without moving the rows to one partition: rows are numbered in
    the partition that they are read in, and the counts of the partitions before are added."""
    rows = session.materialize(docs.withColumn("__tessera_at", F.monotonically_increasing_id()), "numbered")
    part, low = F.shiftright("__tessera_at", 33), F.col("__tessera_at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("__tessera_part")).agg(F.count("*").alias("n"))  # one row for each partition
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("__tessera_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("__tessera_part").alias("__tessera_p"), ahead.alias("__tessera_ahead"))
    joined = rows.join(sizes, part == F.col("__tessera_p"))
    return joined.select((low + F.col("__tessera_ahead") + first).alias("docid"), *(F.col(f"`{c}`") for c in docs.columns))


def local_lexicon(index: Index, docs_per_part: int) -> DataFrame:
    """(part, term, df): document frequencies in each range of ids."""
    rows = index.postings.select(F.expr(f"docid div {docs_per_part}").alias("part"), "term")
    rows = rows.repartition(session.parts(index.postings, TASK_BYTES), "term", "part")  # as many tasks as the input asks for
    return rows.groupBy("part", "term").agg(F.count("*").alias("df"))


def size_parts(docs: DataFrame, limit: int, id_col: str = "docid", docno_col: str | None = None, text_col: str = "text") -> DataFrame:
    """The part that each document falls in when parts are cut at ``limit`` bytes in order of id:
    the bytes of all documents before it, divided by the limit.

    Sums run inside ranges of ids; only one row for each range goes through a global window.
    """
    docno = F.col(docno_col) if docno_col else F.col(id_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("docid"), (F.octet_length(docno) + F.coalesce(F.octet_length(text_col), F.lit(0))).cast("long").alias("size")).withColumn("r", F.expr(f"docid div {RANGE}"))
    ranges = rows.groupBy("r").agg(F.sum("size").alias("total")).withColumn("ahead", F.coalesce(F.sum("total").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("r").orderBy("docid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).join(ranges.select("r", "ahead"), "r").select("docid", "size", F.expr(f"(before + ahead) div {limit}").alias("part"))


