"""The registered queries of this package, ``opN_<name>``, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, exact_dedup, mixing, near_dedup, pii, quality_rules, secret_scan, sentencepiece_codec, substring_dedup, token_files
from tessera.session import read_table

#: Folder of the public vocabularies, used where the package that names them isn't installed.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"


@query(
    "op8_exact_dedup",
    f"""WITH d AS (SELECT doc_id, {_LOWERED} AS low FROM documents),
g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY low)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(low) AS text_sha256 FROM d JOIN g USING (low)""",
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read_table(spark, sf_dir, "documents"))


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, read_table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read_table(spark, sf_dir, "documents"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept_text")


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file."""
    if importlib.util.find_spec("public_tokenizers"):
        return importlib.import_module("public_tokenizers").path(name)
    return os.path.join(TOKENIZERS, name)


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(read_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read_table(spark, sf_dir, "documents"))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs))


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


@query(
    "op2_chat_formatting",
    """WITH t AS (SELECT conv_id, turn, role, text, coalesce(role, 'user') AS r, replace(coalesce(text, ''), '<|', '< |') AS x,
  CASE WHEN role IS NULL THEN '-' ELSE '+' || length(role) || ':' || role END || CASE WHEN text IS NULL THEN '-' ELSE '+' || length(text) || ':' || text END AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns, list(k ORDER BY turn NULLS FIRST, role NULLS FIRST, sha256(k)) AS ks,
  string_agg('<|' || r || '|>' || chr(10) || x || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, sha256(k)) AS rendered FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT sha256(array_to_string(ks[1:i], '')) AS h FROM (SELECT ks, unnest(range(1, n_turns)) AS i FROM c)),
u AS (SELECT min(conv_id) AS conv_id, count(*) AS n_snapshots FROM c GROUP BY ks)
SELECT conv_id, n_turns, n_snapshots, rendered FROM u JOIN c USING (conv_id)
WHERE sha256(array_to_string(ks, '')) NOT IN (SELECT h FROM p)""",
)
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read_table(spark, sf_dir, "conversations"))
