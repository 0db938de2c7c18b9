"""Quality rules: base statistics of a text, and a decision list learned from labelled rows.

The list is learned by sequential covering: a rule (a conjunction of thresholds) is grown on
two thirds of the rows not yet covered by information gain, pruned on the other third, and
kept while it is precise enough there; it becomes one branch of a Spark ``CASE``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import session
from tessera.llm.kernel import Words, cover, slices, splitmix, strings, tidy, turn_to

#: Words in a window that counts as repeated.
WINDOW = 8
#: Labelled rows that the list is learned from, at most: those of least hash.
FIT_ROWS = 20_000

#: Of columns added to a caller's own.
PREFIX = "__tessera_"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bang", "n_upper", "n_letters", "n_pipe", "n_stutter"]
COUNTS_SCHEMA = ", ".join(f"{c} long" for c in _COUNTS)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of each row, the counts named in ``_COUNTS``."""
    w = Words(data, offsets)
    data, offsets = w.data, w.offsets
    n = len(w.starts)
    rows = len(w.counts)
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[w.starts] += 1
    in_word[w.ends] -= 1
    inside = np.cumsum(in_word[:-1], dtype=np.int8) > 0
    out = {"n_words": w.counts, "word_chars": _sums(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": _sums(_SYMBOL[data], offsets)}

    hashes = w.hashes()
    stutter = np.zeros(n, bool)
    stutter[1:] = hashes[1:] == hashes[:-1]
    stutter[w.first[:-1][w.counts > 0]] = False
    out["n_stutter"] = _sums(stutter, w.first)
    g, ok = w.grams(hashes, WINDOW)
    repeated = np.zeros(n, bool)
    if ok.any():
        at = np.flatnonzero(ok)
        row = w.row_of_word()[at]
        key = g[at] ^ splitmix(row.astype(np.uint64))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        flags = np.zeros(n, bool)
        flags[at[twice]] = True
        repeated = cover(flags, WINDOW, n)
    out["n_repeat_words"] = _sums(repeated, w.first)

    lines, again = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    raw = data.tobytes()
    for i in np.flatnonzero(w.counts).tolist():
        part = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i] = len(part)
        again[i] = len(part) - len(set(part))
    out |= {"n_dup_lines": again, "n_lines": lines, "n_bang": _sums(data == 33, offsets), "n_upper": _sums(_UPPER[data], offsets), "n_letters": _sums(_LETTER[data], offsets), "n_pipe": _sums(data == 124, offsets)}
    return out


@tidy
def _statistics(batches):
    turn_to("quality_rules")
    for batch in batches:
        data, offsets = strings(batch.column(1))
        for a, b in slices(offsets):
            c = text_counts(data, offsets[a : b + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c[k].astype(np.int64)) for k in _COUNTS)], ["id", *_COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the counts of each row; a null or empty text has zeros.

    Rows are looked at each on its own: repeated ones and null ids change nothing. An empty table
    gives an empty result; other columns, whatever they are called, play no part.
    """
    session.ship_code(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_statistics, f"id long, {COUNTS_SCHEMA}").withColumnRenamed("id", id_col)


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < 20) | (100 * F.col(f"{prefix}n_repeat_words") > 30 * n)


#: What rules may test, as ratios of two counts, so that a rule holds for texts of any length.
FEATURES = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "bang_per_word": ("n_bang", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "pipes_per_word": ("n_pipe", "n_words"),
    "stutter_share": ("n_stutter", "n_words"),
}


def features(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + a).cast("double") / F.greatest(F.col(prefix + b), F.lit(1)) for k, (a, b) in FEATURES.items()}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def hits(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, x: dict[str, Column]) -> Column:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a row that meets one is rejected, any other is kept."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)

    def rejects(self, prefix: str = "") -> Column:
        x = features(prefix)
        out = F.lit(False)
        for rule in reversed(self.rules):
            met = F.lit(True)
            for t in rule:
                met = met & t.column(x)
            out = F.when(met, F.lit(True)).otherwise(out)
        return out

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        out = np.zeros(n, bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([t.hits(x) for t in rule])
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, least: int) -> list[Test]:
    """Add the test of most FOIL gain until no good row is covered or nothing gains."""
    rule: list[Test] = []
    covered = np.ones(len(bad), bool)
    while len(rule) < most:
        p0, n0 = (bad & covered).sum(), (~bad & covered).sum()
        if not p0 or not n0:
            break
        base = np.log2(p0 / (p0 + n0))
        best = (1e-9, None)
        for name, values in x.items():
            v, y = values[covered], bad[covered]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cut = np.flatnonzero(np.diff(v) > 0)
            if not len(cut):
                continue
            below = np.cumsum(y)[cut]
            size = cut + 1
            for above, p, n in ((False, below, size - below), (True, p0 - below, n0 - (size - below))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p >= least, p * (np.log2(p / (p + n)) - base), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Test(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        covered &= best[1].hits(x)
    return rule


def _precision(rule: list[Test], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    met = np.logical_and.reduce([t.hits(x) for t in rule])
    p, n = int((met & bad).sum()), int((met & ~bad).sum())
    return (p / (p + n) if p + n else 0.0), p


def learn(x: dict[str, np.ndarray], bad: np.ndarray, ids: np.ndarray, precision: float = 0.9, most_rules: int = 12, most_tests: int = 4, least: int = 3) -> DecisionList:
    """Sequential covering. Rows split by a hash of their id: two thirds grow, one third prunes."""
    rules: list[tuple[Test, ...]] = []
    held = splitmix(ids.astype(np.int64).view(np.uint64)) % np.uint64(3) == 0
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        grow, prune = left & ~held, left & held
        if (bad & grow).sum() < least or not (~bad & grow).any():
            break
        xg, xp = ({k: v[m] for k, v in x.items()} for m in (grow, prune))
        rule = _grow(xg, bad[grow], most_tests, least)
        if not rule:
            break
        # The prefix that does best on the rows held back: (p - n) / (p + n), the shorter if equal.
        scores = [(2 * _precision(rule[:k], xp, bad[prune])[0] - 1, -k) for k in range(1, len(rule) + 1)]
        rule = rule[: -max(scores)[1]]
        good, hits = _precision(rule, xp, bad[prune])
        if good < precision or hits < 1:
            break
        rules.append(tuple(rule))
        left &= ~np.logical_and.reduce([t.hits(x) for t in rule])
    return DecisionList(rules)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, **options) -> DecisionList:
    """Learn from at most ``fit_rows`` labelled rows (quality 0 is bad), chosen by a hash of the id.

    Labels that are null, and ids with both labels, are left out; repeated labels count once.
    Of texts that share an id, the one with the least counts is looked at. Without labelled
    rows of both kinds the list is empty and rejects nothing. Null and empty texts have zeros.
    """
    chosen = labels.where(f"quality is not null and {id_col} is not null").groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_text")
    counts = statistics(rows, "_id", "_text").groupBy("_id").agg(F.min(F.struct(*_COUNTS)).alias("c")).select("_id", "c.*").join(F.broadcast(chosen), "_id")
    x = features()
    table = counts.select("_id", "lo", *(c.alias(k) for k, c in x.items())).orderBy("_id").toArrow()  # at most fit_rows rows
    if not table.num_rows:
        return DecisionList()
    return learn({k: table[k].to_numpy() for k in x}, table["lo"].to_numpy() == 0, table["_id"].to_numpy(), **options)


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, counts, base_failed and kept. Null and empty texts fail the base rules (under
    20 words); the rest is as in ``statistics``."""
    return statistics(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rules.rejects())


@tidy
def _with_statistics(batches, text_at: int):
    turn_to("quality_rules")
    for batch in batches:
        data, offsets = strings(batch.column(text_at))
        parts = [text_counts(data, offsets[a : b + 1]) for a, b in slices(offsets)]
        counts = [pa.array(np.concatenate([p[k] for p in parts] or [np.zeros(0)]).astype(np.int64)) for k in _COUNTS]
        yield pa.RecordBatch.from_arrays([*batch.columns, *counts], [*batch.schema.names, *(PREFIX + k for k in _COUNTS)])


def keep(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; texts are read once and not shuffled.

    Null and empty texts go, repeated rows stay or go together, an empty table stays empty, and
    columns may have any names.
    """
    session.ship_code(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(PREFIX + k, T.LongType()) for k in _COUNTS)])
    at = docs.columns.index(text_col)
    judged = docs.mapInArrow(lambda it: _with_statistics(it, at), schema)
    return judged.where(~base_failed(PREFIX) & ~rules.rejects(PREFIX)).select(*(F.col(f"`{c}`") for c in docs.columns))
