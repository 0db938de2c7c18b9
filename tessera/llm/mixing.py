"""Mixing sources to target weights by balanced (cube-method) sampling.

A source's target is met by taking every document ``floor(r)`` times, r being the target over
the source's size, and a balanced sample of its documents once more, each with probability
``r - floor(r)``. The flight phase of the cube method moves the probabilities of three units
at a time along the null space of the two constraints (words, documents) until one of them is
0 or 1; a flight thus leaves at most two undecided units, which fly again with those of the
source's other parts, until a last landing problem of at most two units a source is solved.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import places

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and of a source's target as a share of its words.
TOTAL, MOST = 1.5, 2.0
#: Units that fly together in one task.
FLIGHT_ROWS = 20_000

_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size).

    The shares are those of the weights, but no target is above ``most`` times its source's
    size; the excess is shared again by weight. That is a level L with target =
    min(L * weight, cap): sources are sorted by cap / weight, and L is what is left for the
    sources from a place on, per weight, at the first place where it doesn't exceed the
    ratio. The windows run in one task and hold one row for each source, not its documents:
    some 50 bytes, so a million sources are 50 MB.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    by_source = by_source.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (total * F.sum("source_size").over(every) - before) / left
    by_source = by_source.withColumn("level", level)
    reached = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    target = F.least(F.col("cap"), F.coalesce(reached, F.lit(float("inf"))) * F.col("weight"))
    return by_source.select("source", "source_size", target.alias("target"))


def fly(p: list[float], x: list[float], rng: random.Random) -> None:
    """Flight phase in place: p moves to 0 or 1 but for two units at most, keeping sum(p) and sum(p*x)."""
    active: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = round(p[i])
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        ahead = back = float("inf")
        for k, v in zip(active, u):
            if v > 0:
                ahead, back = min(ahead, (1 - p[k]) / v), min(back, p[k] / v)
            elif v < 0:
                ahead, back = min(ahead, -p[k] / v), min(back, (p[k] - 1) / v)
        step = ahead if rng.random() * (ahead + back) < back else -back
        for k, v in zip(active, u):
            p[k] = min(1.0, max(0.0, p[k] + step * v))
        for k in active:
            if not _EPS < p[k] < 1 - _EPS:
                p[k] = round(p[k])
        active = [k for k in active if 0 < p[k] < 1]


def land(p: list[float], x: list[float], goal: float) -> None:
    """Decide the few units left (nearest to ``goal`` words, then in documents), then mend what
    they are off by: one unit in and one out whose words differ by that (the number of documents
    stays), as long as it helps, else single units, the largest that fits first."""
    left = [i for i, v in enumerate(p) if 0 < v < 1]
    fixed = sum(v * w for i, (v, w) in enumerate(zip(p, x)) if not 0 < v < 1)
    units = sum(p[i] for i in left)
    best = min(itertools.product((0, 1), repeat=len(left)), key=lambda t: (round(abs(fixed + sum(a * x[i] for a, i in zip(t, left)) - goal), 6), abs(sum(t) - units), t))
    for a, i in zip(best, left):
        p[i] = a
    off = goal - sum(v * w for v, w in zip(p, x))
    while abs(off) > 0.5 and (swap := _swap(p, x, off)):
        out, into = swap
        p[out], p[into] = 0, 1
        off -= x[into] - x[out]
    for i in sorted(range(len(p)), key=lambda i: (-x[i], i)):
        if 0 < x[i] and abs(off) > 0.5 and p[i] == (0 if off > 0 else 1) and x[i] <= abs(off):
            p[i] = 1 - p[i]
            off += x[i] if p[i] == 0 else -x[i]


def _swap(p: list[float], x: list[float], off: float) -> tuple[int, int] | None:
    """A taken unit and one that isn't whose exchange comes nearest to mending ``off``, if it does better than half."""
    free = sorted((w, i) for i, (v, w) in enumerate(zip(p, x)) if v == 0)
    best = (abs(off) / 2, None)
    for out, (v, w) in enumerate(zip(p, x)):
        if v == 1:
            k = bisect.bisect_left(free, (w + off, -1))
            for size, into in free[max(0, k - 1) : k + 1]:
                if (rest := abs(off - (size - w))) < best[0]:
                    best = (rest, (out, into))
    return best[1]


def _flight(level: int, last: bool):
    def flight(key: tuple, units: pa.Table) -> pa.Table:
        units = units.take(pc.sort_indices(units, sort_keys=[("size", "descending"), ("doc_id", "ascending"), ("rows", "ascending")], null_placement="at_start"))
        source, part = (k.as_py() for k in key)
        seed = hashlib.sha256(repr((source, part, level)).encode()).digest()
        p = units["p"].to_pylist()
        x = pc.multiply(units["size"], units["rows"]).cast(pa.float64()).to_pylist()
        goal = sum(a * b for a, b in zip(p, x))
        fly(p, x, random.Random(seed))
        if last:
            land(p, x, goal)
        return units.set_column(units.schema.get_field_index("p"), "p", pa.array([float(v) for v in p]))

    return flight


_UNIT = "doc_id long, source string, size long, rows long, source_size long, target double, p double"


def sample(units: DataFrame, flight_rows: int = FLIGHT_ROWS) -> DataFrame:
    """Units with p at 0 or 1: part by part, then what each part left, until a source is one part."""
    columns = [c.split()[0] for c in _UNIT.split(", ")]
    undecided = "p > 0 and p < 1"
    decided = []
    # Parts are sized by the counted units of their source, so a hot source is many parts.
    row = units.where(undecided).groupBy("source").count().agg(F.max("count")).first()
    most, level = row[0] or 0, 0
    while True:
        last = most <= flight_rows
        counts = units.where(undecided).groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n"))
        open_units = units.where(undecided).join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        parts = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("doc_id", F.lit(level)), F.greatest(F.ceil(F.col("n") / flight_rows), F.lit(1)))
        flown = open_units.withColumn("part", parts).drop("n").groupBy("source", "part").applyInArrow(_flight(level, last), f"{_UNIT}, part long").select(columns)
        flown = session.materialize(flown, f"flight{level}")
        decided.append(units.where(f"not ({undecided})") if level == 0 else units.where("false"))
        if last:
            decided.append(flown)
            break
        decided.append(flown.where(f"not ({undecided})"))
        units, level = flown, level + 1
        most = 2 * -(-most // flight_rows)
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, flight_rows: int = FLIGHT_ROWS) -> DataFrame:
    """From written sizes (doc_id, source, size): one row for each distinct (doc_id, source, size), with the
    number of such rows, source_size, target and ``copies``, how often the mix takes each.

    Equal rows are one unit. Empty documents count as units and carry no words; if no text
    has words, targets are 0 and nothing is taken.
    """
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    goal = targets(sizes, weights, total, most).withColumnRenamed("source", "of")
    units = units.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("whole", F.floor(rate + _EPS)).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    units = units.withColumn("p", F.when(F.col("p") < _EPS, 0.0).otherwise(F.col("p")))
    units = session.materialize(units.select(*(c.split()[0] for c in _UNIT.split(", ")), "whole"), "units")
    chosen = sample(units.drop("whole"), flight_rows)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + _EPS)).otherwise(F.lit(0))
    return chosen.withColumn("copies", (whole + F.col("p")).cast("long")).drop("p")


def sizes_of(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *carry)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0, 1 or 2 times), with all their columns.

    Rows of one id, source and size, null ids among them, are taken alike. A null text has no
    words, a null source is the last one. An empty table, or one without words, gives no rows.
    Columns may have any names. Texts are read twice and never shuffled.
    """
    session.ship_code(docs.sparkSession)
    found = places.located(docs)
    sizes = session.materialize(sizes_of(found, id_col, source_col, text_col, tuple(places.PLACE)), "sizes")
    unit = ["doc_id", "source", "size"]
    chosen = plan(sizes.select(unit), **options).where("copies <> 1").select(*(F.col(c).alias(f"of_{c}") for c in unit), F.col("copies").alias("number"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in unit]
    copies = places.Decisions.write(sizes.join(chosen, same).select(*places.PLACE, "number"), found, 1, text_col)
    rows = found.withColumn("__tessera_copies", copies.column()).where(F.col("__tessera_copies") > 0)
    return rows.withColumn("__tessera_copy", F.explode(F.sequence(F.lit(1), F.col("__tessera_copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: its id, size, source_size, target and the words that the mix takes of it.

    Null ids are ids like any other, and stay null; the rest is as in ``mix``.
    """
    session.ship_code(docs.sparkSession)
    sizes = session.materialize(sizes_of(docs, id_col, source_col, text_col), "sizes")
    units = plan(sizes, **options)
    units = units.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return units.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
