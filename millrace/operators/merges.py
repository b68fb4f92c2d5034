"""Merging rows that say the same, attribution by name, inherited roles and ownership of shared keys.

Nulls in keys form a key of their own in aggregates and match nothing in joins; empty tables give empty results; other
columns than those named are ignored. Groups are only ever reduced by partial aggregates, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import cut


def merge_agreeing(rows: DataFrame, key: str, role: str, signature: str) -> DataFrame:
    """(key, role, signature, members, conflict): one row a key, with a conflict where roles or signatures differ.

    Of a conflicting key the least role and signature are shown; nulls agree with anything.
    """
    return rows.groupBy(key).agg(
        F.min(role).alias(role),
        F.min(signature).alias(signature),
        F.count("*").alias("members"),
        (F.coalesce(F.min(role) != F.max(role), F.lit(False)) | F.coalesce(F.min(signature) != F.max(signature), F.lit(False))).alias("conflict"),
    )


def crossing_groups(rows: DataFrame, group: str, role: str) -> DataFrame:
    """The groups whose rows have more than one role: (group, first, last)."""
    return rows.groupBy(group).agg(F.min(role).alias("first"), F.max(role).alias("last")).where("first <> last")


def average_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, members, vector): the mean of aligned vectors of each key; a null vector counts as a member with no entry."""
    members = rows.groupBy(key).agg(F.count("*").alias("members"))
    each = rows.select(key, F.posexplode(vector).alias("at", "p")).groupBy(key, "at").agg(F.avg("p").alias("p"))
    means = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "p"))).alias("x"))  # one vector a key
    return members.join(means, key, "left").select(key, "members", F.col("x")["p"].alias(vector))


def attribute(names: DataFrame, owners: DataFrame, name: str, alias: str, owner: str, also: str) -> DataFrame:
    """(name, owner) of names that exactly one owner's alias fits: equal, or a suffix after ``-``; ``also`` must agree.

    The theta join is an equi join on (suffix, also): each name is exploded into its own suffixes, a handful.
    """
    parts = F.split(F.col(name), "-")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))
    wanted = names.select(name, also, F.explode(F.array_distinct(suffixes)).alias("__suffix")).distinct()
    held = owners.select(F.col(alias).alias("__suffix"), also, owner).distinct()
    found = wanted.join(held, ["__suffix", also]).groupBy(name, also).agg(F.count_distinct(owner).alias("n"), F.min(owner).alias(owner))
    return found.where("n = 1").select(name, also, owner)


def strictest_role(members: DataFrame, component: str, role: str, priority: Column) -> DataFrame:
    """Add ``usage``: the role of the highest priority in the member's component; ties by the greater role."""
    best = members.groupBy(component).agg(F.max(F.struct(priority.alias("p"), F.col(role).alias("r")))["r"].alias("usage"))
    return members.join(best, component)


def inherit_partition(rows: DataFrame, old: DataFrame, group: str, member: str, part: str) -> DataFrame:
    """(group, part, status) of each group of ``rows`` after the parts its members had in ``old``.

    ``inherited`` where all known members had one part, ``mixed`` where they had several (part is null), ``new`` where
    none is known.
    """
    known = rows.select(group, member).join(old.select(member, part), member, "left")
    seen = known.groupBy(group).agg(F.min(part).alias("low"), F.max(part).alias("high"))
    status = F.when(F.col("low").isNull(), "new").when(F.col("low") == F.col("high"), "inherited").otherwise("mixed")
    return seen.select(group, F.when(F.col("low") == F.col("high"), F.col("low")).alias(part), status.alias("status"))


def fill_quota(groups: DataFrame, pool: str, order: list[Column], size: str, cap: Column) -> DataFrame:
    """Add ``taken``: how many of a group's rows fit its pool's cap after the groups before it; groups are ordered whole.

    A pool's groups (one row each) pass a sorted window, which spills.
    """
    before = F.coalesce(F.sum(size).over(Window.partitionBy(pool).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least(F.col(size), cap - before)))


def pairwise_overlap(sets: DataFrame, name: str, key: str) -> DataFrame:
    """(first, second, common) of every two named sets that share a key. Names must be few: a key lists its own."""
    named = sets.select(name, key).distinct().groupBy(key).agg(F.sort_array(F.collect_set(name)).alias("names"))
    listed = named.groupBy("names").agg(F.count("*").alias("n")).where(F.size("names") > 1)
    pairs = F.flatten(
        F.transform("names", lambda a, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda b: F.struct(a.alias("first"), b.alias("second"))))
    )
    each = listed.select(F.explode(pairs).alias("p"), "n")
    return each.groupBy("p.first", "p.second").agg(F.sum("n").alias("common"))


def owned_servers(records: DataFrame, aliases: DataFrame, priorities: DataFrame) -> DataFrame:
    """(server, reason) of the servers blocked: an alias or a request must belong to servers of one priority.

    ``records`` has (record, request, server) rows, ``aliases`` (server, alias), ``priorities`` (server, priority), one row
    a server. Servers meet under each alias, and those of records of a single priority meet under each request; all but
    those of the highest priority are blocked, with the lesser reason where there are both.

    To repeat this without the blocked servers and the records that have one blocks no more: whoever was below the highest
    priority of an alias or request is blocked, and of those left there no one can be below another. So one round does.
    """
    under_alias = aliases.join(priorities, "server")
    ranked = records.join(priorities, "server")
    sound = ranked.groupBy("record").agg(F.min("priority").alias("low"), F.max("priority").alias("high")).where("low = high")
    under_request = cut(ranked.join(sound.select("record"), "record").select("request", "server", "priority"))

    def losers(members: DataFrame, key: str, reason: str) -> DataFrame:
        best = members.groupBy(key).agg(F.max("priority").alias("best"))
        return members.join(best, key).where("priority < best").select("server", F.lit(reason).alias("reason"))

    lost = losers(under_alias, "alias", "schema_alias").unionByName(losers(under_request, "request", "repeated_request"))
    return lost.groupBy("server").agg(F.min("reason").alias("reason"))
