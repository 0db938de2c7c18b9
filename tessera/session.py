"""What every module needs from a session: shipped code and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for Python workers, where the session doesn't choose its own: batches of long texts stay small.
WORKER_SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: For reading, likewise: what a task holds before a shuffle grows with its split.
SCAN_SETTINGS = {"spark.sql.files.maxPartitionBytes": str(16 << 20)}
_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def _settle(spark: SparkSession, settings: dict[str, str]) -> None:
    for key, value in settings.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)


def small_splits(spark: SparkSession) -> None:
    _settle(spark, SCAN_SETTINGS)


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers, whatever path the driver took it from."""
    sc = spark.sparkContext
    _settle(spark, WORKER_SETTINGS)
    if getattr(sc, "_tessera_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tessera-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "tessera_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for root, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith((".py", ".txt")):
                    path = os.path.join(root, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    sc.addPyFile(archive)
    sc._tessera_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where unset, one of our own on this machine, if all tasks run here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(sc, "_tessera_scratch", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="tessera-scratch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        own = sc._tessera_scratch = f"file://{own}"
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's own part of the scratch folder."""
    return f"{scratch_root(spark)}/tessera/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for table in tables:
        path = table.__dict__.pop("_tessera_path", None)
        if path:
            _delete(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the scratch folder; results not yet read go too."""
    _delete(spark, f"{scratch_root(spark)}/tessera/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table._tessera_path = path
    return table


def input_bytes(df: DataFrame) -> float:
    """Bytes of the files that a table reads, 0 where that is unknown. Only speed may depend on it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(float(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size if size < 1 << 60 else 0.0  # Spark's own stand-in for an unknown size is above


def parts(df: DataFrame, each: int) -> int:
    """Partitions for a shuffle of ``df``'s rows: one for each so many bytes of its files, so that
    what a task holds doesn't grow with the input, and one for each core at least."""
    spark = df.sparkSession
    least = spark.sparkContext.defaultParallelism
    size = input_bytes(df)
    return max(int(size / each) + 1, least) if size else max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
