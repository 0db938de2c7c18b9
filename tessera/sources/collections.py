"""Collections and query batches in tab-separated lines, and TREC run files."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lines of an archive that go on together.
ARCHIVE_LINES = 10_000


def _archive_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_stream(name, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as archive:
                for member in archive:
                    lines: list[str] = []
                    for line in archive.extractfile(member) or () if member.isfile() else ():
                        lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                        if len(lines) == ARCHIVE_LINES:
                            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                            lines = []
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files, plain or compressed, or of the files in ``.tar``,
    ``.tar.gz``, ``.tgz`` archives. An archive can't be split: a task streams through one."""
    if not path.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2")):
        return spark.read.text(path)
    names = spark.read.format("binaryFile").load(path).select("path")  # contents aren't read
    return names.repartitionByRange(max(names.count(), 1), "path").mapInArrow(_archive_lines, "value string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(docno, text, corrupt): ``docno<TAB>text``; further tabs are text. Compressed files and archives are read as they are.

    A line without a tab is corrupt: it has no docno, and its whole is in ``text``.
    """
    return _parsed(_lines(spark, path))


def read_buffer(spark: SparkSession, buffer: bytes) -> DataFrame:
    """``read_lines`` of what a buffer in memory holds."""
    lines = buffer.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    return _parsed(spark.createDataFrame([(x,) for x in (lines if lines[-1] else lines[:-1])], "value string"))


def _parsed(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t", 2)
    whole = F.instr("value", "\t") > 0
    return lines.select(F.when(whole, parts[0]).alias("docno"), F.when(whole, parts[1]).otherwise(F.col("value")).alias("text"), (~whole).alias("corrupt"))


def read_collection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, corrupt lines)."""
    lines = read_lines(spark, path)
    return lines.where("not corrupt").select("docno", "text"), lines.where("corrupt").select(F.col("text").alias("line"))


def read_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((qid, text), lines without a whole number before the tab). Lines with an empty text are left out."""
    lines = read_lines(spark, path).withColumn("qid", F.expr("try_cast(docno as bigint)"))
    return lines.where("qid is not null and text <> ''").select("qid", "text"), lines.where("qid is null").select("text")


def six_digits(score: Column) -> Column:
    """As C++ streams write a double: six significant digits."""

    @F.pandas_udf("string")
    def write(x: pd.Series) -> pd.Series:
        return pd.Series(np.char.mod("%.6g", x.to_numpy(float)), x.index, object).where(x.notna(), None)

    return write(score)


def run_lines(results: DataFrame, run: str = "TESSERA0") -> DataFrame:
    """(qid, rank, line) with lines ``qid Q0 docno rank score run``."""
    line = F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("docno"), F.col("rank").cast("string"), six_digits(F.col("score")), F.lit(run))
    return results.select("qid", "rank", line.alias("line"))


def write_run(results: DataFrame, path: str, run: str = "TESSERA0") -> None:
    """Lines ordered by query and rank, over as many files as there are partitions."""
    run_lines(results, run).orderBy("qid", "rank").select("line").write.mode("overwrite").text(path)
