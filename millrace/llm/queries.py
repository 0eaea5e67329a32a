"""Queries of the dealt operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, htmltext, itq, jaccard, licences, lines, mixing, oracles, packing, quality, substrings
from .common import read


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup(read(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go, and what stays as a digest."""
    kept = lines.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(read(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.dedup(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_array_dedup, op2_quality_classifier, op3_line_dedup, op4_packing, op5_jaccard_join, op6_fingerprints, op7_html_extraction, op8_licence_scan, op9_mixing, op10_embedding_dedup)
}

ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": oracles.SUBSTRINGS,
    "op3_line_dedup": oracles.LINES,
    "op5_jaccard_join": oracles.JACCARD,
    "op8_licence_scan": licences.oracle_sql(),
    "op10_embedding_dedup": oracles.VECTORS,
}
