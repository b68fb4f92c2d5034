"""Leakage-free partitioning, quotas and conflict-aware deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_share(key: Column) -> Column:
    """The first eight bytes of the key's SHA-256 as a share of 2^64, in [0, 1)."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 2.0**64


def hash_split(key: Column, cuts: list[tuple[str, float]]) -> Column:
    """The first name whose cut lies above the key's share; the last name takes the rest."""
    share, out = hash_share(key), F.lit(cuts[-1][0])
    for name, cut in reversed(cuts[:-1]):
        out = F.when(share < cut, name).otherwise(out)
    return out


def leaking_keys(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split (empty when the splits are disjoint): key, splits."""
    found = rows.groupBy(key).agg(F.count_distinct(split).alias("splits"))
    return found.where("splits > 1")


def reserve_by_priority(rows: DataFrame, component: str, split: str, order: list[str]) -> DataFrame:
    """Every row of a component moves to the component's strictest split; ``order`` lists the strictest first."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(split))
    best = rows.groupBy(component).agg(F.min(rank).alias("__rank"))
    joined = rows.join(best, component)
    return joined.withColumn(split, F.element_at(F.array(*map(F.lit, order)), F.col("__rank").cast("int"))).drop("__rank")


def group_quota(groups: DataFrame, task: str, group: str, size: str, cap: int) -> DataFrame:
    """Whole groups per task in hash order, each taken when it still fits under ``cap``; later ones may fit after a skip.

    ``groups`` has one row a group. The fold needs a task's groups in order; skipping makes it no
    running sum: it streams through them in one task, holding one batch. Columns: task, group, size, taken.
    """
    rows = groups.select(
        F.col(task).alias("k"), F.sha2(F.col(group).cast("string"), 256).alias("h"), F.col(group).alias("g"), F.col(size).cast("long").alias("n")
    )
    rows = rows.repartition("k").sortWithinPartitions("k", "h", "g", "n").select("k", "g", "n")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, key, used = False, None, 0
        for batch in batches:
            taken = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not seen or k != key:
                    seen, key, used = True, k, 0
                taken.append(None if n is None else used + n <= cap)
                used += n if taken[-1] else 0
            yield batch.append_column("taken", pa.array(taken, pa.bool_()))

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    both = rows.mapInArrow(fold, f"{kinds}, taken boolean")
    return both.select(F.col("k").alias(task), F.col("g").alias(group), F.col("n").alias(size), "taken")


def capped_by_hash(rows: DataFrame, key: str, by: list[str], cap: int, seed: str) -> DataFrame:
    """At most ``cap`` rows per group, in the order of a seeded hash of the key: a reproducible sample per class."""
    order = Window.partitionBy(*by).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256), key)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cap).drop("__n")


def sample_by_hash(rows: DataFrame, key: str, count: int, seed: str) -> DataFrame:
    """``count`` rows with the least seeded hashes: a reproducible sample without replacement (a bounded top-k)."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256), key).limit(count)


def resolve_conflicts(rows: DataFrame, key: list[str], target: str, order: str) -> DataFrame:
    """Of rows with equal keys keep the first by ``order``; groups with more than one target go as a whole."""
    first = F.min(F.struct(order, *[c for c in rows.columns if c not in (*key, order)])).alias("f")
    kept = rows.groupBy(*key).agg(first, F.count_distinct(target).alias("targets"), F.count("*").alias("copies"))
    return kept.where("targets = 1").select(*key, "f.*", "copies")


def consolidate(rows: DataFrame, key: list[str], choice: str, lineage: str) -> DataFrame:
    """One row per key and its lineage (sorted, distinct); keys with conflicting choices are dropped."""
    merged = rows.groupBy(*key).agg(
        F.count_distinct(choice).alias("choices"), F.min(choice).alias(choice), F.sort_array(F.collect_set(lineage)).alias(lineage)
    )
    return merged.where("choices = 1").drop("choices")


def clean_splits(rows: DataFrame, group: str, prompt: str, split: str, order: list[str]) -> DataFrame:
    """Rows whose group, and then prompt, belongs to their split as the strictest that has it; one row per prompt.

    A group that several splits hold stays in the strictest alone; of what remains, a prompt that several splits hold
    takes whole groups of the laxer ones with it; within a split the first row per prompt (smallest id) stays.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(split))
    ranked = rows.withColumn("__r", rank)
    owned = ranked.join(ranked.groupBy(group).agg(F.min("__r").alias("__g")), group).where("__r = __g").drop("__g")
    best = owned.groupBy(prompt).agg(F.min("__r").alias("__p"))
    tainted = owned.join(best, prompt).where("__r > __p").select(group).distinct()
    kept = owned.join(tainted, group, "left_anti")
    first = Window.partitionBy(prompt, split).orderBy("id")
    return kept.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__r")
