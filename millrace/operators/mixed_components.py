"""Components of rows that share any of several keys, named by their members, and the splits that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import folded_words, marked_spans
from millrace.operators.components import connected_components
from millrace.operators.ordinals import numbered
from millrace.runtime import cut

BLOCK = 1024  # member names, or digests, that one digest is made of


def member_components(members: DataFrame, member: str, key: str) -> DataFrame:
    """(member, component): members are together that share a key, at one remove or many; the component is the least member.

    Each key ties its members to the least of them, so a key of many members costs one row each. Members without keys, or
    with keys of their own only, are alone. Null members are left out, null keys tie nothing; an empty table stays empty.
    """
    rows = cut(members.where(F.col(member).isNotNull()).select(F.col(member).alias("m"), F.col(key).alias("k")).distinct())
    least = rows.where("k is not null").groupBy("k").agg(F.min("m").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = rows.join(cut(least), "k").where("m <> first").select(F.col("first").alias("a"), F.col("m").alias("b"))
    found = connected_components(edges).select(F.col("node").alias("m"), "component")
    return rows.select("m").distinct().join(found, "m", "left").select(F.col("m").alias(member), F.coalesce("component", "m").alias("component"))


def named_by_members(components: DataFrame, member: str, component: str, prefix: str = "", digits: int = 24) -> DataFrame:
    """(component, name): a name that digests the sorted names of a component's members, whatever the order of the input.

    Names are numbered within their component over as many tasks as they need, digested in blocks of ``BLOCK`` in order,
    and so are the digests, until one is left: no row holds a component's members. A component of at most ``BLOCK``
    members is named by the digest of their names, each with its length in characters and a colon before it.
    """
    text = F.col(member).cast("string")
    item = F.concat(F.char_length(text).cast("string"), F.lit(":"), text)
    rows = components.where(F.col(member).isNotNull()).select(F.col(component).alias("c"), F.col(member).alias("m"), item.alias("item")).distinct()
    rows = numbered(rows, ["c"], ["m"], "number").select("c", "number", "item")
    named = None
    while True:
        block = F.floor((F.col("number") - 1) / BLOCK) + 1
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "item"))), lambda x: x["item"]), "")
        blocks = cut(rows.groupBy("c", block.alias("number")).agg(F.sha2(joined.cast("binary"), 256).alias("item")))
        more = blocks.where("number > 1").select("c").distinct()
        done = blocks.join(more, "c", "left_anti")
        named = done if named is None else named.unionByName(done)
        rows = cut(blocks.join(more, "c", "left_semi"))
        if not rows.take(1):
            break
    return named.select(F.col("c").alias(component), F.concat(F.lit(prefix), F.substring("item", 1, digits)).alias("name"))


def source_components(tasks: DataFrame, task: str, keys: Column, prefix: str = "source-") -> DataFrame:
    """(task, component): tasks that use a common source, named by all tasks of the component; ``keys`` is an array."""
    named = tasks.select(F.col(task).alias("task"), F.explode_outer(keys).alias("key"))
    held = cut(member_components(named, "task", "key"))
    names = named_by_members(held, "task", "component", prefix)
    return held.join(names, "component").select(F.col("task").alias(task), F.col("name").alias("component"))


def document_keys(text: Column) -> Column:
    """The keys by which documents are the same: the digest of the folded text, and of each marked passage in it."""
    state = F.concat(F.lit("state:"), F.sha2(folded_words(text), 256))
    spans = F.transform(marked_spans(text), lambda s: F.concat(F.lit("document:"), F.sha2(s, 256)))
    return F.array_union(F.array(state), spans)


def document_partitions(rows: DataFrame, row_id: str, task: str, text: str, target: str, partition: str, seed: str, held_out: int = 50) -> DataFrame:
    """(row_id, group_id, split, reason): rows that share a text or a marked passage go to one split.

    Of rows of one task and folded text only the first, by id, may stay, and it stays only if all have its target:
    others are a ``duplicate_task_state``, or ``conflicting_duplicate_annotation`` where targets differ. A group has the
    highest partition of its rows (train, challenge, test); rows of a lower one are out as ``document_overlaps_partition``,
    and ``held_out`` in a thousand training groups are for validation. ``group_id`` is named by the least text digest of
    the rows that stay, so it does not depend on the order of the input. Rows with a null id are left out; a null text
    counts as empty, and differs in no way from an empty one; partitions unknown count as train.
    """
    rank = F.when(F.col(partition) == "test", 2).when(F.col(partition) == "challenge", 1).otherwise(0)
    state = F.coalesce(F.col(text), F.lit(""))
    base = rows.where(F.col(row_id).isNotNull()).select(
        F.col(row_id).alias("r"), F.col(task).alias("t"), F.col(target).cast("string").alias("y"), rank.alias("rank"), document_keys(state).alias("keys")
    )
    base = cut(base.withColumn("state", F.get("keys", F.lit(0))))
    together = cut(member_components(base.select("r", F.explode("keys").alias("key")), "r", "key"))
    target_kinds = F.count_distinct(F.struct("y")).alias("targets")
    first = base.groupBy(F.col("t").alias("__t"), F.col("state").alias("__state")).agg(F.min(F.struct("r", "y")).alias("first"), target_kinds)
    marked = base.join(first, F.col("t").eqNullSafe(F.col("__t")) & (F.col("state") == F.col("__state")))
    own = F.col("r") == F.col("first.r")
    differs = F.when(own, F.col("targets") > 1).otherwise(~F.col("y").eqNullSafe(F.col("first.y")))
    reason = F.when(differs, "conflicting_duplicate_annotation").when(~own, "duplicate_task_state")
    marked = cut(marked.select("r", "state", "rank", reason.alias("reason")).join(together, "r"))
    stay = marked.where("reason is null").groupBy("component").agg(F.max("rank").alias("top"), F.min("state").alias("least"))
    group = F.concat(F.lit("document-"), F.substring("least", 7, 64))
    spread = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), group), 256), 1, 15), 16, 10).cast("long") % 1000
    split = F.when(F.col("top") == 2, "test").when(F.col("top") == 1, "challenge").when(spread < held_out, "validation").otherwise("train")
    placed = marked.join(cut(stay.select("component", "top", group.alias("group_id"), split.alias("split"))), "component", "left")
    why = F.coalesce("reason", F.when(F.col("rank") != F.col("top"), "document_overlaps_partition"))
    kept = lambda c: F.when(why.isNull(), F.col(c)).alias(c)
    return placed.select(F.col("r").alias(row_id), kept("group_id"), kept("split"), why.alias("reason"))
