"""Decisions about rows, applied where the rows are read.

A row of a Parquet table has a place: a hash of its file's path, and its number in the file.
Operators that drop or repeat whole documents decide on narrow tables that carry places; what
they decide is written to the scratch folder, packed by file and range of rows. The tasks that
read the documents again look up the ranges that they read, so texts are never shuffled,
however many documents go.

Paths are told apart by 64 bits: of a million files, two share them with a chance of 3e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import repeats
from tessera.llm.kernel import tidy

FILE, ROW = "__tessera_file", "__tessera_row"
PLACE = [FILE, ROW]
#: Rows of a file whose decisions are packed together: 2**LOG_RANGE.
LOG_RANGE = 16
#: Bytes of documents whose decisions make up one part of the written table; only speed depends on it.
PART_BYTES = 1 << 29
#: Ranges that a worker holds at once.
_HELD = 64


def _is_scan(docs: DataFrame) -> bool:
    """Whether each row is a row of a Parquet file, the same one whenever it is read."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and plan.relation().fileFormat().toString() == "Parquet"


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the places of its rows; what isn't a scan of Parquet files is written first."""
    if not _is_scan(docs):
        docs = session.materialize(docs, "docs")
    metadata = docs.metadataColumn("_metadata")  # whatever the table's own columns are called
    return docs.withColumns({FILE: F.xxhash64(metadata["file_path"]), ROW: metadata["row_index"]})


class Decisions:
    """A written table of numbers by place; places that it doesn't name have ``default``."""

    def __init__(self, path: str, parts: int, default: int, log_range: int):
        self.path, self.parts, self.default, self.log_range = path, parts, default, log_range

    @classmethod
    def write(cls, rows: DataFrame, docs: DataFrame, default: int, text_col: str = "text", log_range: int = LOG_RANGE) -> Decisions:
        """From (FILE, ROW, number); ``docs`` only sets the number of parts. ``look_up`` and what
        builds on it ask for one number for each place at most."""
        parts = repeats.power_of_two(repeats.input_bytes(docs, text_col) / PART_BYTES, 1, 1 << 20)
        path = session.scratch_path(rows.sparkSession, "decisions")
        at = F.shiftright(ROW, log_range).alias("at")
        low = F.col(ROW).bitwiseAND((1 << log_range) - 1).cast("int").alias("row")
        packed = rows.groupBy(F.col(FILE).alias("file"), at).agg(F.collect_list(F.struct(low, F.col("number").cast("long").alias("number"))).alias("rows"))  # of at most 2**log_range rows
        packed = packed.withColumn("part", F.pmod(F.col("file").bitwiseXOR(F.col("at")), F.lit(parts)).cast("int"))
        packed.repartition(parts, "part").sortWithinPartitions("part", "file", "at").write.partitionBy("part").parquet(path)
        return cls(path, parts, default, log_range)

    def _range(self, file: int, at: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the rows in one range, by row."""
        system, name = fs.FileSystem.from_uri(f"{self.path}/part={(file ^ at) % self.parts}")
        if system.get_file_info(name).type == fs.FileType.NotFound:
            if system.get_file_info(name.rpartition("/")[0] + "/_SUCCESS").type == fs.FileType.NotFound:
                raise FileNotFoundError(self.path)
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for info in system.get_file_info(fs.FileSelector(name)):
            if not info.path.endswith(".parquet"):
                continue
            with system.open_input_file(info.path) as source:
                table = pq.ParquetFile(source)
                for g in range(table.num_row_groups):
                    bounds = table.metadata.row_group(g).column(0).statistics
                    if bounds is not None and bounds.has_min_max and not bounds.min <= file <= bounds.max:
                        continue
                    group = table.read_row_group(g)
                    found = group.filter(pc.and_(pc.equal(group["file"], file), pc.equal(group["at"], at)))["rows"].combine_chunks().flatten()
                    rows.append(found.field("row").to_numpy().astype(np.int64))
                    numbers.append(found.field("number").to_numpy())
        row, number = np.concatenate(rows), np.concatenate(numbers)
        order = np.argsort(row, kind="stable")
        return row[order], number[order]

    def look_up_all(self, file: np.ndarray, row: np.ndarray, held: dict) -> tuple[np.ndarray, np.ndarray]:
        """(which of some rows, number) for each number of theirs; ``held`` keeps the ranges read so far."""
        at = row >> self.log_range
        which, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        edges = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (at[1:] != at[:-1])))[: len(row)]
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(row)]):
            key = (int(file[a]), int(at[a]))
            if key not in held:
                if len(held) >= _HELD:
                    held.clear()
                held[key] = self._range(*key)
            known, numbers = held[key]
            if len(known):
                low = row[a:b] & (1 << self.log_range) - 1
                first = np.searchsorted(known, low, "left")
                count = np.searchsorted(known, low, "right") - first
                which.append(np.repeat(np.arange(a, b), count))
                found.append(numbers[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())])
        return np.concatenate(which), np.concatenate(found)

    def look_up(self, file: np.ndarray, row: np.ndarray, held: dict) -> np.ndarray:
        """The numbers of some rows."""
        out = np.full(len(row), self.default, np.int32)
        which, found = self.look_up_all(file, row, held)
        out[which] = found
        return out

    @tidy
    def _numbers(self, batches):
        held: dict = {}
        for file, row in batches:
            yield pa.array(self.look_up(file.to_numpy(), row.to_numpy(), held))

    def column(self) -> Column:
        """The number of each row of a located DataFrame; only places go to Python."""
        this = self

        @F.arrow_udf("int")
        def number(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            yield from this._numbers(batches)

        return number(F.col(FILE), F.col(ROW))

    def chosen(self, batches):
        """The rows of batches whose last two columns are their places, if their number is above 0, without those columns."""
        held: dict = {}
        for batch in batches:
            number = self.look_up(batch.column(FILE).to_numpy(), batch.column(ROW).to_numpy(), held)
            names = batch.schema.names[:-2]
            rest = pa.RecordBatch.from_arrays(batch.columns[:-2], names)
            if (number > 0).any():
                yield rest.filter(pa.array(number > 0))


def keep(docs: DataFrame, gone: DataFrame, text_col: str = "text") -> DataFrame:
    """A located DataFrame without the places in ``gone``."""
    dropped = Decisions.write(gone.select(*PLACE, F.lit(0).alias("number")), docs, 1, text_col)
    return docs.where(dropped.column() > 0)
