"""Exact deduplication of documents by normalised text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import normalize_lines, sha256_hex


def enrich(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add raw_sha256, normalized_text and normalized_sha256."""
    return docs.withColumns(
        {"raw_sha256": sha256_hex(F.col(text)), "normalized_text": normalize_lines(F.col(text))}
    ).withColumn("normalized_sha256", sha256_hex(F.col("normalized_text")))


def dedup_decisions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, retained_id and reason.

    The smallest key of equal normalised texts is retained. Reasons: ``retained``, ``exact_match`` (same raw text
    as the retained row) and ``normalized_match``. Only keys and digests shuffle; the first row of each group comes
    from a map-side combined ``min``, so a hot group costs one row per task. Null texts form one group.
    """
    hashed = docs.select(
        F.col(key).alias("source_id"),
        sha256_hex(F.coalesce(F.col(text), F.lit(""))).alias("raw"),
        sha256_hex(normalize_lines(F.coalesce(F.col(text), F.lit("")))).alias("norm"),
    )
    first = hashed.groupBy("norm").agg(F.min(F.struct("source_id", "raw")).alias("first"))
    return hashed.join(first, "norm").select(
        "source_id",
        F.col("first.source_id").alias("retained_id"),
        F.when(F.col("source_id").eqNullSafe(F.col("first.source_id")), "retained")
        .when(F.col("raw") == F.col("first.raw"), "exact_match")
        .otherwise("normalized_match")
        .alias("reason"),
    )
