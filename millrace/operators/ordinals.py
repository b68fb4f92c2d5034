"""Row numbers of whole tables and of groups of any size, without a window that one task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import cut


def _counted(placed: DataFrame, by: list[str], number: str) -> DataFrame:
    """Numbers within the partitions of ``__row`` and ``__part``, plus what the partitions before hold of the group."""
    # A null key is a group as well: the joins compare what is never null.
    keys = [F.struct(F.col(c).isNull(), F.col(c)).alias(f"__k{i}") for i, c in enumerate(by)] or [F.lit(0).alias("__k0")]
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = placed.select("*", *keys)
    held = keyed.groupBy(*names, "__part").agg(F.count("*").alias("__held"), F.min("__row").alias("__first"))
    before = F.sum("__held").over(Window.partitionBy(*names).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut(held.select(*names, "__part", "__first", F.coalesce(before, F.lit(0)).alias("__before")))
    at = (F.col("__row") - F.col("__first") + F.col("__before") + 1).alias(number)
    return keyed.join(offsets, [*names, "__part"]).select(*placed.columns, at).drop("__row", "__part")


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], number: str = "number") -> DataFrame:
    """Add ``number``, a row's place from 1 on within its group ``by`` (the whole table if empty) in a total ``order``.

    Rows are dealt out by ranges of group and order and sorted, so a group of any size is spread over tasks; only one
    count a partition and group is summed up. Nulls are a group, and sort first. Rows that ``order`` does not tell apart
    are numbered in any order; an empty table stays empty.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    return _counted(cut(dealt.select("*", F.monotonically_increasing_id().alias("__row"), F.spark_partition_id().alias("__part"))), by, number)


def positions(rows: DataFrame, number: str = "position") -> DataFrame:
    """Add ``number``, a row's place from 1 on in the order in which the frame's partitions hold the rows.

    For a frame read from files that is the order of files (by size, as Spark deals them) and of rows in them; it is
    fixed when this is called, not by sorting.
    """
    placed = cut(rows.select("*", F.monotonically_increasing_id().alias("__row"), F.spark_partition_id().alias("__part")))
    return _counted(placed, [], number)


def file_positions(rows: DataFrame, number: str = "position") -> DataFrame:
    """Add ``number``, a row's place from 1 on in the order of file names and of the rows in each, for one read of files.

    Blocks of a file are ordered by where they begin, rows of a block as they are read; no column of the rows is used.
    """
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    return numbered(rows.select("*", at.alias("__at")), [], ["__at"], number).drop("__at")
