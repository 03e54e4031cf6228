"""The operators as queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, fingerprint, langid, linededup, mixing, simhash, substring, toxicity


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "token_ids", "round_trip")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that an earlier line matches, and the first that does."""
    return linededup.removed(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document, the benchmark item that it overlaps most, with the score, and all items that it overlaps."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    grain = fingerprint.FINE
    rank = fingerprint.rarity(docs, window=grain.window)
    items = fingerprint.digests(read(spark, sf_dir, "benchmark").select("item_id", "text"), rank, grain=grain)
    return fingerprint.match(fingerprint.digests(docs, rank, grain=grain).select("doc_id", "n_features", "digest"), items)


def op3_fingerprint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two documents whose digests overlap, with the score; of equal digests, each with the least id."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint.pairs(docs, fingerprint.rarity(docs, window=fingerprint.FINE.window))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return bpe.token_counts(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a near-duplicate of lower id in its group, and the group's least id."""
    return simhash.groups(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every vector, named by its least id, and the number of different vectors that are near."""
    return embeddings.classes(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: one row for each copy of a document."""
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), copy="copy").select("doc_id", "source", "copy")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, null where it has none, with the score and its lead."""
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs.select("doc_id", "text"), langid.train(docs)).select("doc_id", "language", "score", "lead")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, and whether it reaches the threshold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, toxicity.train(docs, read(spark, sf_dir, "labels"))).select("doc_id", "score", "is_toxic")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of words that are in windows of 50 which an earlier document has."""
    return substring.spans(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "start_word", "end_word")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_line_dedup, op3_fingerprints, op3_fingerprint_pairs, op4_token_counts, op5_simhash, op6_embeddings, op7_mixing, op8_language_id, op9_toxicity, op10_substring)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.sql(), "op6_embeddings": embeddings.sql(), "op7_mixing": mixing.sql(), "op10_substring": substring.sql()}
