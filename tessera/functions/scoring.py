"""Scores as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n_docs: Column, df: Column) -> Column:
    return F.log2(n_docs.cast("double") / df)


def fast_log2(x: Column) -> Column:
    """floor(log2(x)) of a positive integer, without rounding at powers of two."""
    return (F.length(F.bin(x)) - 1).cast("double")


@dataclass(frozen=True)
class BM25:
    k1: float = 0.82
    b: float = 0.68
    needs_length = True

    def __call__(self, tf: Column, weight: Column, dl: Column, avgdl: Column) -> Column:
        return tf / (self.k1 * ((1 - self.b) + self.b * dl / avgdl) + tf) * weight


@dataclass(frozen=True)
class TFIDF:
    fast_log: bool = False
    needs_length = False

    def __call__(self, tf: Column, weight: Column, dl: Column | None = None, avgdl: Column | None = None) -> Column:
        log = fast_log2(tf) if self.fast_log else F.log2(tf.cast("double"))
        return F.when(tf > 0, (1 + log) * weight).otherwise(F.lit(0.0))


def scorer(name: str) -> BM25 | TFIDF:
    """By name; BM25 where the name is unknown."""
    return {"tfidf": TFIDF(), "tfidf-fast": TFIDF(fast_log=True)}.get(name.lower(), BM25())
