"""A corpus pipeline over ``documents``: rules, exact copies, near copies, mixing, token ids.

Every stage takes rows with null ids, sources and texts, empty and very long texts, repeated
rows and columns of any name; an empty table stays empty. All stages but the last return the
columns they are given, and none of them shuffles texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera import session
from tessera.llm import exact_dedup, mixing, near_dedup, quality_rules, sentencepiece_codec
from tessera.llm.queries import tokenizer


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects. Null and empty texts
    are too short and go; repeated rows stay or go together."""
    return quality_rules.keep(docs, quality_rules.fit(docs, session.read_table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest id (a null id is below any other);
    of rows that repeat it, the one first in the files."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, with all rows of its id.
    Rows with a null id or without words are in no group and stay."""
    return near_dedup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, twice at most. A null source is one
    like any other, the last; rows of one id, source and size are taken alike."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row's text, and whether they decode to it. A null or empty text has none."""
    return sentencepiece_codec.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("sentencepiece", encode)]

#: Learned rules, sampling and token ids can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each one's result is written and read again."""
    docs = session.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, session.materialize(stage(spark, docs, sf_dir), name)
        session.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
