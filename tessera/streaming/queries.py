"""Queries that arrive as a stream, answered batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.index import Index
from tessera.operators.search import search


def query_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, text) from files of ``qid<TAB>text`` lines that appear in a folder; others are left out."""
    lines = spark.readStream.text(folder).select(F.split("value", "\t", 2).alias("p"))
    return lines.select(F.expr("try_cast(p[0] as bigint)").alias("qid"), F.expr("try_element_at(p, 2)").alias("text")).where("qid is not null and text <> ''")


def answer(index: Index, queries: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Search for each micro-batch of queries; a batch that is run again overwrites its own answers."""

    def batch(rows: DataFrame, number: int) -> None:
        search(index, rows, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
