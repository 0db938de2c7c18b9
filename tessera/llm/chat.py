"""Chat formatting: collapse of cumulative snapshots, then rendering.

Loggers that save a conversation after each turn leave many snapshots of one talk. Every
snapshot that is a proper prefix of another conversation, or equal to one of smaller id, goes.
The hash of a conversation's first t turns rolls on from that of its first t - 1. A
conversation's hash of all its turns is looked up among the hashes that others had before
their last turn, by anti-join; these are collapsed to distinct hashes first, so that a
prefix shared by very many conversations is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import session


def _turn_hash(role_col: str, text_col: str) -> Column:
    def field(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.length(c).cast("string"), F.lit(":"), F.col(c)))

    return F.sha2(F.concat(field(role_col), field(text_col)), 256)


def prefix_hashes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, t, n_turns, h1, h2): for each turn, the hash of the conversation up to it.

    The hash rolls on by exclusive or with that of the turn and its place: 128 bits.
    Turns are ordered by their number; rows that share one are ordered by role and text.
    A null role or text is not the same as an empty one. Rows of a null conversation are left out.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), _turn_hash(role_col, text_col).alias("sha")
    )
    in_order = Window.partitionBy("conv").orderBy("turn", "role", "sha")
    placed = rows.withColumn("t", F.row_number().over(in_order)).withColumn("n_turns", F.count("*").over(Window.partitionBy("conv")))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "conv",
        "t",
        "n_turns",
        F.bit_xor(F.xxhash64("t", "sha")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64("sha", "t", F.lit("second"))).over(so_far).alias("h2"),
    )


def maximal(turns: DataFrame, **columns) -> DataFrame:
    """(conv, n_turns, n_snapshots): the conversations that stay, with how many were collapsed into each.

    n_snapshots counts equal conversations only (itself included): a shorter snapshot can
    belong to several longer ones.
    """
    prefixes = session.materialize(prefix_hashes(turns, **columns), "prefixes")
    key = ["t", "h1", "h2"]
    inner = prefixes.where("t < n_turns").select(key).distinct()
    distinct = prefixes.where("t = n_turns").groupBy(key).agg(F.min("conv").alias("conv"), F.count("*").alias("n_snapshots"))
    return distinct.join(inner, key, "left_anti").select("conv", F.col("t").cast("long").alias("n_turns"), "n_snapshots")


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", open_tag: str = "<|", close_tag: str = "|>", end: str = "<|end|>") -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_snapshots, rendered.

    A turn is written ``<|role|>\\ntext<|end|>\\n``; a null role is written ``user``, a null
    text is empty. Tags in a text are broken by a space, so that no text can open a turn.
    """
    kept = maximal(turns, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    safe = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(open_tag), F.lit(f"{open_tag[0]} {open_tag[1:]}"))
    line = F.concat(F.lit(open_tag), F.coalesce(F.col(role_col), F.lit("user")), F.lit(f"{close_tag}\n"), safe, F.lit(f"{end}\n"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), _turn_hash(role_col, text_col).alias("sha"), line.alias("line")).alias("t"))
    rendered = rows.join(kept.select("conv"), "conv", "left_semi").groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "").alias("rendered"))
    return kept.join(rendered, "conv").select(F.col("conv").alias(conv_col), "n_turns", "n_snapshots", "rendered")
