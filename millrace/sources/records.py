"""Record scans and sinks: JSON lines with validation, row witnesses, pinned files, ledgers and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.calls import json_value


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON lines (gzip included): source_id, text, witness, reason.

    ``reason`` is null for a valid row, else the first of: ``invalid_json``, ``source_id``, ``text``, ``duplicate_id``.
    Blank lines are skipped; a line with more after its first value is invalid. Duplicates are all rows of an id but
    the one with the smallest witness (file, line text).
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    parsed = lines.withColumn("v", json_value(F.col("value")))
    field = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    kind = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
    rows = parsed.select(
        F.when(kind("source_id") == "STRING", field("source_id")).alias("source_id"),
        F.when(kind("text") == "STRING", field("text")).alias("text"),
        F.struct("file", F.sha2("value", 256).alias("digest")).alias("witness"),
        F.col("v").isNull().alias("broken"),
    )
    firsts = rows.where("source_id IS NOT NULL AND text IS NOT NULL").groupBy("source_id").agg(F.min("witness").alias("first"), F.count("*").alias("n"))
    joined = rows.join(firsts, "source_id", "left")
    reason = (
        F.when(F.col("broken"), "invalid_json").when(F.col("source_id").isNull(), "source_id").when(F.col("text").isNull(), "text").when(F.col("witness") != F.col("first"), "duplicate_id")
    )
    return joined.select("source_id", "text", "witness", reason.alias("reason"))


def accepted_and_excluded(classified: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """The rows without a reason, and the ledger of the others."""
    return classified.where(F.col(reason).isNull()).drop(reason), classified.where(F.col(reason).isNotNull())


def parquet_with_witness(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet scan with ``witness``: file, row number in it and a digest of the row."""
    rows = spark.read.parquet(path)
    digest = F.sha2(F.to_json(F.struct(*rows.columns)), 256).alias("digest")
    return rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), digest).alias("witness"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def require_digest(files: DataFrame, expected: dict[str, str]) -> None:
    """Raise unless each file, named by the end of its path, has the digest expected of it."""
    found = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in files.select("path", "sha256").collect()}  # a row a pinned file
    wrong = sorted(name for name, digest in expected.items() if found.get(name) != digest)
    if wrong:
        raise ValueError(f"digests differ: {', '.join(wrong)}")


def write_json_lines(rows: DataFrame, path: str, by: str | None = None, gzip: bool = False) -> None:
    """JSON lines with sorted fields, in one folder per value of ``by`` where it is given."""
    ordered = rows.select(*sorted(rows.columns))
    writer = ordered.write.option("ignoreNullFields", "false")
    if gzip:
        writer = writer.option("compression", "gzip")
    (writer.partitionBy(by) if by else writer).json(path)


def manifest(rows: DataFrame, by: str) -> DataFrame:
    """Per value of ``by``: rows, and an order-free digest of them (the sum of 64-bit row hashes, as a decimal)."""
    content = F.xxhash64(F.to_json(F.struct(*sorted(c for c in rows.columns if c != by)))).cast("decimal(38,0)")
    return rows.groupBy(by).agg(F.count("*").alias("rows"), F.sum(content).cast("string").alias("digest"))
