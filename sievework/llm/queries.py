"""The queries of the llm problems over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.leakage import leaked
from sievework.functions.paths import hex_number
from sievework.llm.mojibake import garbled, restore
from sievework.llm.parsing import parse_files, parse_rates
from sievework.llm.tokens import VOCABULARIES, decode_corpus, encode_corpus, pieces, read_ranks
from sievework.session import cut, table


def _parsed(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    return parse_files(table(spark, d, "source_files"), keep, text="source_text", language="detected_language", path="relative_path")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, ["file_id"]).where(~F.col("valid")).select("file_id").distinct()


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every error of every invalid file; ``place`` counts from 0, the first being the cause."""
    bad = _parsed(spark, d, ["file_id", "detected_language"]).where(~F.col("valid"))
    return bad.select("file_id", "detected_language", F.posexplode("errors").alias("place", "error")).select("file_id", "detected_language", "place", "error.line", "error.column", "error.message")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of invalid files per subject and language."""
    parsed = _parsed(spark, d, ["file_id", "subject_key", "detected_language"])
    return parse_rates(parsed, ["subject_key", "detected_language"])


def p3_ledger(spark: SparkSession, d: str) -> DataFrame:
    """How the ledger's parse_status and recovery_strategy fit the verdicts, per language."""
    digest = lambda c: F.coalesce(F.hex(hex_number(F.col(c))), F.lit("-"))
    files = _parsed(spark, d, ["file_id", "workspace_id", "content_sha256", "detected_language"]).where(F.col("valid").isNotNull())
    files = files.select("file_id", "workspace_id", digest("content_sha256").alias("digest"), "detected_language", "valid").distinct()
    ledger = table(spark, d, "contributions").where(F.col("content_sha256").isNotNull())
    ledger = ledger.select(F.col("workspace_id").alias("l_workspace"), digest("content_sha256").alias("l_digest"), "parse_status", "recovery_strategy").distinct()
    both = files.join(ledger, (F.col("workspace_id") == F.col("l_workspace")) & (F.col("digest") == F.col("l_digest")))
    return both.groupBy("detected_language", "parse_status", "recovery_strategy").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"))


def p6_ids(spark: SparkSession, d: str, *, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text", read_ranks(vocabulary))


def p6_roundtrip(spark: SparkSession, d: str, *, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Whether decoding the ids gives the text back, for every document."""
    docs, ranks = table(spark, d, "documents"), read_ranks(vocabulary)
    decoded = decode_corpus(encode_corpus(docs, "doc_id", "text", ranks), "doc_id", pieces(spark, ranks))
    both = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("was")).join(decoded.select("doc_id", F.xxhash64("text").alias("now")), "doc_id", "left")
    return both.select("doc_id", F.coalesce(F.col("was") == F.col("now"), F.lit(False)).alias("same"))


def _leaks(spark: SparkSession, d: str, **how) -> DataFrame:
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), doc_id="doc_id", item_id="item_id", doc_text="text", item_text="text", **how)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where(F.col("longest_run") >= 13).select("doc_id", "item_id").distinct()


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    """Edited and partial copies too: pairs that share three runs of five words and whose best alignment reaches 0.3 of a whole copy's score."""
    pairs = _leaks(spark, d, n=5, window=5, shared=3).where(F.col("coverage") >= 0.3)
    return pairs.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.round(F.max("coverage"), 6).alias("coverage"), F.max("longest_run").alias("longest_run"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id")).distinct()


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return restore(docs, cut(garbled(docs, "doc_id", "text")), "doc_id", "text").distinct()


def queries() -> dict:
    return {"p3_found": p3_found, "p3_errors": p3_errors, "p3_rates": p3_rates, "p3_ledger": p3_ledger, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_found": p7_found, "p7_scores": p7_scores, "p8_found": p8_found, "p8_restored": p8_restored}


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
#: Every run of thirteen words of every text, met by their spelling.
_P7 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM d WHERE len(w) >= 13)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM i WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


def oracle_sql() -> dict[str, str]:
    return {"p6_roundtrip": "SELECT doc_id, true AS same FROM documents", "p7_found": _P7}
