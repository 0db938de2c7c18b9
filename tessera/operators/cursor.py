"""One term's list, read block by block: for looking around in an index. Searches work on whole tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.operators.index import Index, term_bucket

#: Postings fetched at once.
BLOCK = 1_000


class Cursor:
    """Iterates over the postings of a term in order of documents, and skips ahead.

    Of a saved index, only the files and row groups of the term's bucket whose bounds reach the
    place that is asked for are read.
    """

    def __init__(self, index: Index, term: str, block: int = BLOCK):
        rows = index.postings
        if index.buckets:
            bucket = rows.sparkSession.range(1).select(F.lit(term).alias("term")).select(term_bucket(index.buckets)).first()[0]
            rows = rows.where(F.col("term_bucket") == bucket)
        self._rows: DataFrame = rows.where(F.col("term") == term).select("docid", "tf", "dl")
        self._block, self._held, self._last, self._from = block, [], False, None

    def _fetch(self) -> None:
        rows = self._rows if self._from is None else self._rows.where(F.col("docid") >= self._from)
        self._held = rows.orderBy("docid").limit(self._block).collect()[::-1]  # a block at most
        self._last = len(self._held) < self._block

    def _pop(self) -> Row | None:
        if not self._held and not self._last:
            self._fetch()
        row = self._held.pop() if self._held else None
        if row is not None:
            self._from = row.docid + 1
        return row

    def __iter__(self) -> Iterator[Row]:
        while (row := self._pop()) is not None:
            yield row

    def next_geq(self, docid: int) -> Row | None:
        """The first posting at or after a document, from wherever the cursor is; it goes on after that."""
        while self._held and self._held[-1].docid < docid:
            self._held.pop()
        self._from = docid if self._from is None else max(docid, self._from)
        return self._pop()

    def next_gt(self, docid: int) -> Row | None:
        return self.next_geq(docid + 1)
