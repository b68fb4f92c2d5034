"""Relational and graph rule families: lookups, access control, intervals, evidence, routes and logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import cut

TRUTH = ("Supported", "Contradicted", "Unknown", "Both supported and contradicted")


def truth(positive: Column, negative: Column) -> Column:
    """The state of a claim, given whether evidence for and against it exists."""
    yes, no = F.coalesce(positive, F.lit(False)), F.coalesce(negative, F.lit(False))
    return F.when(yes & no, TRUTH[3]).when(yes, TRUTH[0]).when(no, TRUTH[1]).otherwise(TRUTH[2])


def lookup(rows: DataFrame, parents: DataFrame, key: str, value: str, missing: str = "Unknown") -> DataFrame:
    """Left join on ``key``; a missing parent gives ``missing``."""
    return rows.join(parents.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def permitted(policies: DataFrame, roles: DataFrame) -> DataFrame:
    """(user, resource) that some policy of the user's roles allows and none denies.

    ``policies``: role, resource, effect; ``roles``: user, role. Policies are reduced to one row a role and resource, and
    repeated roles count once, before they meet: the join makes a row a user, role and resource. Null roles match none,
    and an effect that is neither ``allow`` nor ``deny`` (null too) says nothing.
    """
    said = lambda effect: F.coalesce(F.bool_or(F.col("effect") == effect), F.lit(False)).alias(effect)
    rules = policies.groupBy("role", "resource").agg(said("allow"), said("deny")).where("allow OR deny")
    held = roles.select("user", "role").distinct().join(rules, "role").groupBy("user", "resource")
    return held.agg(F.bool_or("deny").alias("deny")).where("NOT deny").select("user", "resource")


def free_candidates(candidates: DataFrame, bookings: DataFrame, width: int) -> DataFrame:
    """Candidates (key, start, stop) that overlap no booking (key, begin, finish) of their key; intervals are half-open.

    Both sides are cut into bins of ``width``, so the overlap test is an equi-join on (key, bin).
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    taken = bookings.where("finish > begin").withColumn("bin", bins("begin", "finish")).alias("t")
    wanted = candidates.where("stop > start").withColumn("bin", bins("start", "stop")).alias("c")
    meets = (F.col("c.key") == F.col("t.key")) & (F.col("c.bin") == F.col("t.bin")) & (F.col("c.start") < F.col("t.finish")) & (F.col("c.stop") > F.col("t.begin"))
    clash = wanted.join(taken, meets, "left_semi").select("key", "start", "stop").distinct()
    return candidates.join(clash, ["key", "start", "stop"], "left_anti")


def latest_state(observations: DataFrame, by: str, time: str, value: str, now: Column, max_age: int, threshold: float) -> DataFrame:
    """(by, state): the truth of ``value >= threshold`` by the latest observations not older than ``max_age``; ties count."""
    recent = observations.where((now - F.col(time)).between(0, max_age))
    last = recent.groupBy(by).agg(F.max(time).alias("__last"))
    signs = recent.join(last, by).where(F.col(time) == F.col("__last")).groupBy(by).agg(
        F.bool_or(F.col(value) >= threshold).alias("p"), F.bool_or(F.col(value) < threshold).alias("n")
    )
    return observations.select(by).distinct().join(signs, by, "left").select(by, truth(F.col("p"), F.col("n")).alias("state"))


def best_of(rows: DataFrame, by: str, name: str, value: str, eligible: Column, none: str = "NONE") -> DataFrame:
    """(by, name): all eligible rows with the greatest value of their group, or one row ``none``."""
    keyed = rows.select(by).distinct()
    w = Window.partitionBy(by)
    top = rows.where(eligible).withColumn("__m", F.max(value).over(w)).where(F.col(value) == F.col("__m")).select(by, name)
    return keyed.join(top, by, "left").withColumn(name, F.coalesce(name, F.lit(none)))


def runnable(available: Column, required: Column, forbidden: Column) -> Column:
    """Whether all required items are available and no forbidden one is."""
    return (F.size(F.array_except(required, available)) == 0) & ~F.arrays_overlap(forbidden, available)


def membership_counts(lists: DataFrame, item: str, name: str) -> DataFrame:
    """(item, lists): in how many of the named lists an item occurs."""
    return lists.groupBy(item).agg(F.count_distinct(name).alias("lists"))


def reachable(edges: DataFrame, starts: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(start, node) over directed (a, b) edges, the start itself included; a round per step of distance."""
    edges = edges.select("a", "b").distinct()
    seen = cut(starts.select("start", F.col("start").alias("node")).distinct())
    front = seen
    for _ in range(max_rounds):
        step = front.join(edges, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        front = cut(step.join(seen, ["start", "node"], "left_anti"))
        if not front.take(1):
            break
        seen = cut(seen.unionByName(front))
    return seen


def least_costs(edges: DataFrame, starts: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(start, node, cost) over directed (a, b, cost) edges with costs of at least zero: relaxation until nothing falls."""
    edges = edges.groupBy("a", "b").agg(F.min("cost").alias("step"))
    best = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("cost")).distinct())
    front = best
    for _ in range(max_rounds):
        offers = front.join(edges, F.col("node") == F.col("a")).groupBy("start", F.col("b").alias("node")).agg(F.min(F.col("cost") + F.col("step")).alias("offer"))
        front = offers.join(best, ["start", "node"], "left").where("cost IS NULL OR offer < cost")
        front = cut(front.select("start", "node", F.col("offer").cast("long").alias("cost")))
        if not front.take(1):
            break
        best = cut(best.unionByName(front).groupBy("start", "node").agg(F.min("cost").alias("cost")))
    return best


def closure(facts: DataFrame, rules: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(object, fact) closed under rules (rule, needs, then): a rule adds its fact where all it needs hold.

    Negations are facts of their own (``not x``); contradictions imply nothing further.
    """
    needs = rules.select("rule", F.explode(F.array_distinct("needs")).alias("fact"), F.size(F.array_distinct("needs")).alias("n"), "then")
    known = cut(facts.select("object", "fact").distinct())
    for _ in range(max_rounds):
        met = known.join(needs, "fact").groupBy("object", "rule", "n", "then").agg(F.count("*").alias("k")).where("k = n")
        new = cut(met.select("object", F.col("then").alias("fact")).distinct().join(known, ["object", "fact"], "left_anti"))
        if not new.take(1):
            break
        known = cut(known.unionByName(new))
    return known
