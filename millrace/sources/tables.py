"""Named Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


#: Tables of whole texts, whose rows cost far more to work on than to read.
TEXTS = ("documents", "pages")
CORE_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table out to all cores where its files are fewer; a larger table is left as it is.

    A file of one row group is one task, however many cores there are. Only tables of less than ``CORE_BYTES`` a core
    are dealt out, so the shuffle is bounded; the rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > cores * CORE_BYTES:
        return df
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet`` through Spark, so any Hadoop-readable location works."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows
