"""Schedules and selections in a seeded order, call queues, and bootstraps of grouped means.

Order is by SHA-256 of a seed and the row's id, so reruns agree; nulls in ids hash as empty strings. Empty tables give no
rows, repeated rows count as often as they occur unless a docstring says otherwise, and other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordinals import numbered
from millrace.runtime import cut

OPEN_ROWS = 100_000  # links that a partition of the open state holds about
FIRST_ROWS = 8_192  # rows of the first stretch of a capped selection
GROWTH = 4  # and how many times as far each later one reaches
LEAST = 1024  # but of a large table the first has this share
EARLY = 16  # this share is decided before the rest of the links is read
BOUND_ROWS = 20_000  # ranks that bounds of stretches are read off


def seeded(seed: str, *parts: str | Column) -> Column:
    """The digest that orders rows: seed and parts joined by colons; a null part counts as empty."""
    text = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(":", F.lit(seed), *text), 256)


def queue_pairs(events: DataFrame, by: list[str], order: list[str], kind: str, call: str, response: str) -> DataFrame:
    """Rows of calls and responses with ``number`` (the k-th matched of its kind) and ``matched``.

    Under each key (conversation and call id, or name where there is no id) a response answers the earliest call that
    still waits; with none waiting it stays unmatched. Calls and matched responses of equal key and number belong
    together. The responses unmatched so far are the largest excess of responses over calls so far, so windows tell all
    without a fold. ``order`` must be total.
    """
    rows = events.where(F.col(kind).isin(call, response))
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_call = (F.col(kind) == call).cast("long")
    counted = rows.withColumns({"__calls": F.sum(is_call).over(so_far), "__replies": F.sum(1 - is_call).over(so_far)})
    lost = counted.withColumn("__lost", F.greatest(F.lit(0).cast("long"), F.max(F.col("__replies") - F.col("__calls")).over(so_far)))
    lost = lost.withColumn("__before", F.coalesce(F.lag("__lost").over(Window.partitionBy(*by).orderBy(*order)), F.lit(0)))
    reply = F.col(kind) == response
    answered = F.max(F.when(reply, F.col("__replies") - F.col("__lost"))).over(Window.partitionBy(*by))
    number = F.when(~reply, F.col("__calls")).when(F.col("__lost") == F.col("__before"), F.col("__replies") - F.col("__lost"))
    matched = F.when(reply, F.col("__lost") == F.col("__before")).otherwise(F.col("__calls") <= F.coalesce(answered, F.lit(0)))
    return lost.withColumns({"number": number, "matched": matched}).drop("__calls", "__replies", "__lost", "__before")


def capped_greedy(rows: DataFrame, members: DataFrame, cap: int | Column, cap_of: DataFrame | None = None, first: int = FIRST_ROWS) -> DataFrame:
    """(id, taken): rows visited by ``rank``, each taken unless one of its groups already has as many as its cap.

    ``rows`` has (id, rank), ids and ranks unique; ``members`` (id, group), repeats counting once and null groups being
    none; ``cap`` is a number or an expression of ``group``, and ``cap_of`` (group, cap) overrides it for single groups. A
    row in no group is taken.

    Instead of one visit after another, the first ``first`` rows are decided, then ``GROWTH`` times as many, and so on.
    Before a stretch is decided it loses the rows of groups that the stretches before have filled. For that only the links of
    the first of ``EARLY`` rows are kept as they are; all others meet the groups that those have filled as they are read, and
    only what is left of them is kept. Within a stretch each round decides all rows whose groups are full (left out) or
    cannot fill up before them (taken); the first open row is always decided, so rounds end. Rows that each wait for the
    one before are the worst case, a round for every second one; in an order that has nothing to do with the groups rounds
    are few.
    """
    rows, members = rows.select("id", "rank"), members.where(F.col("group").isNotNull()).select("id", "group")
    cap, cap_of = F.lit(cap).cast("long"), None if cap_of is None else cut(cap_of.select("group", "cap"))
    placed, early, last = _stretches(rows, first)
    taken = []  # links of taken rows, a null group for rows in none
    parts = [(0, early), (early, last)] if 0 < early < last else [(0, last)]
    for begin, end in parts:
        own = placed.where(F.col("stretch").between(begin, end - 1))
        links = _open(own, members, cap, cap_of, taken)
        for k in range(begin, end):
            part = links.where(F.col("stretch") == k)
            if k > begin:
                part = _open(part.select("id", "rank", "stretch").distinct(), part, cap, cap_of, taken)
            taken += _decided(part)
    known = reduce(DataFrame.unionByName, taken).select("id").distinct().withColumn("taken", F.lit(True))
    return rows.select("id").join(known, "id", "left").select("id", F.coalesce("taken", F.col("id").isNull()).alias("taken"))


def _stretches(rows: DataFrame, first: int) -> tuple[DataFrame, int, int]:
    """``rows`` with the number of their ``stretch`` from 0 on, how many of the stretches are early ones, and how many there are.

    Bounds are read off the ranks of some ``BOUND_ROWS`` rows, so stretches are about as long as meant; any are right.
    """
    total, ends = rows.count(), []
    end = max(first, total // LEAST)
    while end < total:
        ends, end = [*ends, end], end * GROWTH
    if not ends:
        return rows.withColumn("stretch", F.lit(0)), 0, 1
    seen = rows if total <= BOUND_ROWS else rows.sample(BOUND_ROWS / total, seed=1)
    at = lambda e: F.get("ranks", (F.size("ranks") * (e / total)).cast("int") - 1)
    names = [f"bound{i}" for i in range(len(ends))]
    bounds = seen.agg(F.sort_array(F.collect_list("rank")).alias("ranks")).select(*[at(e).alias(n) for n, e in zip(names, ends)])
    bounds = F.broadcast(cut(bounds))  # one row
    below = reduce(Column.__add__, [F.coalesce((F.col(n) < F.col("rank")).cast("int"), F.lit(0)) for n in names])
    return rows.join(bounds).select("id", "rank", below.alias("stretch")), sum(e <= total // EARLY for e in ends), len(ends) + 1


def _open(rows: DataFrame, members: DataFrame, cap: Column, cap_of: DataFrame | None, taken: list[DataFrame]) -> DataFrame:
    """(id, rank, stretch, group, room): the links of those of ``rows`` none of whose groups is full; a null group for a row in none."""
    room, links = cap, members.select("id", "group")
    if cap_of is not None:
        links, room = links.join(cap_of, "group", "left"), F.coalesce(F.col("cap").cast("long"), room)
    if taken:
        # Room counts rows taken later in rank too: those were taken only where every open row before them had its room left.
        used = reduce(DataFrame.unionByName, taken).groupBy("group").agg(F.count("*").alias("used"))
        links = links.join(used, "group", "left")
        room = room - F.coalesce("used", F.lit(0))
    links = links.withColumn("room", room)
    links = links.select("id", F.when(F.col("room") > 0, F.col("group")).alias("group"), "room")  # of a full group no more is needed
    full = F.max(F.coalesce(F.col("room") <= 0, F.lit(False))).over(Window.partitionBy("id"))
    own = rows.join(links, "id", "left").withColumn("full", full).where("NOT full")
    return cut(own.select("id", "rank", "stretch", "group", "room").distinct(), OPEN_ROWS)


def _decided(opened: DataFrame) -> list[DataFrame]:
    """(id, group) of the rows of a stretch that are taken, a frame a round."""
    taken, left = [opened.where("group IS NULL").select("id", "group")], opened.where("group IS NOT NULL")
    whole, own = Window.partitionBy("group"), Window.partitionBy("id")
    nth = F.row_number().over(whole.orderBy("rank"))
    full, free = F.max(F.col("room") <= 0).over(own), F.min(F.col("nth") <= F.col("room")).over(own)
    while left.take(1):
        judged = cut(left.withColumn("nth", nth).withColumn("taken", F.when(full, False).when(free, True)).drop("nth"), OPEN_ROWS)
        taken.append(judged.where("taken").select("id", "group"))
        if not judged.where("taken IS NULL").take(1):
            break
        used = F.count(F.when(F.col("taken"), 1)).over(whole)  # by group, as the next round's order is
        left = judged.withColumn("room", F.col("room") - used).where("taken IS NULL").drop("taken")
    return taken


def round_robin(rows: DataFrame, key: str, group: str, seed: str, required: int, visits: int = 1) -> DataFrame:
    """(key, group, visit, round, place) of a schedule of ``required`` places: each round takes one row of each group left.

    A group's rows come in a new seeded order in each of its ``visits``; within a round groups come in a seeded order.
    Rounds beyond ``required`` cannot be reached, so what is numbered globally is one row a round, at most ``required``.
    """
    visited = rows.select(key, group, F.explode(F.sequence(F.lit(1), F.lit(visits))).alias("visit"))
    turn = F.row_number().over(Window.partitionBy(group).orderBy("visit", seeded(seed, "visit", key), key))
    turns = visited.withColumn("round", turn).where(F.col("round") <= required)
    sizes = turns.groupBy("round").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("round").orderBy(seeded(seed, "round", group), group))
    placed = turns.withColumn("at", at).join(sizes.withColumn("start", start), "round")
    return placed.withColumn("place", F.col("start") + F.col("at")).where(F.col("place") <= required).select(key, group, "visit", "round", "place")


def coverage_picks(rows: DataFrame, key: str, stratum: str, chosen: DataFrame, seed: str, n: int) -> DataFrame:
    """(key, stratum, place, probability) of ``n`` picks, each from the strata that have the fewest so far.

    ``chosen`` (key) are picked already and count for their strata. A pick's probability, given those before it, is one
    over the strata at the least count times the rows left in its own.
    """
    marked = rows.join(chosen.select(key).distinct().withColumn("old", F.lit(1)), key, "left")
    had = F.count("old").over(Window.partitionBy(stratum))
    left = marked.withColumn("had", had).where("old IS NULL")
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(seeded(seed, key), key))
    left = left.withColumns({"nth": nth, "left": F.count("*").over(Window.partitionBy(stratum))})
    left = left.where(F.col("nth") <= n).withColumn("level", F.col("had") + F.col("nth"))
    sizes = left.groupBy("level").agg(F.count("*").alias("strata"))
    start = F.coalesce(F.sum("strata").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("level").orderBy(seeded(seed, "level", stratum), stratum))
    placed = left.withColumn("at", at).join(sizes.withColumn("start", start), "level").withColumn("place", F.col("start") + F.col("at"))
    eligible, remaining = F.col("strata") - F.col("at") + 1, F.col("left") - F.col("nth") + 1
    return placed.where(F.col("place") <= n).select(key, stratum, "place", (1 / (eligible * remaining)).alias("probability"))


TASK_DRAWS = 1_000_000  # draws of a bootstrap that one task makes about


def macro_bootstrap(rows: DataFrame, stratum: str, group: str, task: str, value: str, resamples: int, seed: str) -> DataFrame:
    """One row: difference, lower_95, upper_95, groups, drawn: a macro mean over tasks and its percentile interval.

    Whole groups are drawn with replacement within their stratum, the same draws for every task; a draw that omits a
    task is left out (``drawn`` counts the others). Null values are ignored; null strata, groups and tasks count as one
    each. Every group makes one draw a resample in its own place, so the draws are spread like the groups, whose numbers
    come from ranges; draws meet the sums of the groups that they hit in one join.
    """
    stats = cut(rows.groupBy(stratum, group, task).agg(F.sum(value).alias("s"), F.count(value).alias("n")))
    groups = numbered(stats.select(stratum, group).distinct(), [stratum], [group], "k").withColumn("k", F.col("k") - 1)
    sizes = groups.groupBy(F.col(stratum).alias("__f")).agg(F.count("*").alias("size"))
    groups = cut(groups.join(sizes, F.col(stratum).eqNullSafe(F.col("__f"))).select(stratum, group, "k", "size"))
    number = F.conv(F.substring(seeded(seed, "r", stratum, "k"), 1, 8), 16, 10).cast("long")
    # few rows make all the draws, and numbered groups lie in as few partitions as their bytes need; from those bytes
    # Spark would also take the draws for small and broadcast them, so the join is told to sort
    parts = max(groups.sparkSession.sparkContext.defaultParallelism, -(-groups.count() * resamples // TASK_DRAWS))
    draws = groups.repartition(parts, stratum, "k").select(stratum, "size", "k", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    draws = draws.select(F.col(stratum).alias("__f"), (number % F.col("size")).alias("__k"), "r")
    names = groups.select(F.col(stratum).alias("__f"), F.col(group).alias("__g"), F.col("k").alias("__k"))
    same = F.col(stratum).eqNullSafe(F.col("__f")) & F.col(group).eqNullSafe(F.col("__g"))
    summed = stats.join(names, same).select("__f", "__k", F.col(task).alias("__t"), "s", "n").alias("x")
    hit = F.col("d.__f").eqNullSafe(F.col("x.__f")) & (F.col("d.__k") == F.col("x.__k"))
    drawn = draws.alias("d").join(summed.hint("merge"), hit).select("r", F.col("__t").alias(task), "s", "n")
    each = drawn.groupBy("r", task).agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    means = each.groupBy("r").agg(F.avg("m").alias("m"), F.count("m").alias("tasks"))
    point = stats.groupBy(task).agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m")).agg(F.avg("m").alias("difference"), F.count("m").alias("all"))
    ends = means.join(F.broadcast(point)).where("tasks = all").groupBy("difference").agg(  # one row
        F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("*").alias("drawn")
    )
    total = groups.agg(F.count("*").alias("groups"))
    return ends.join(F.broadcast(total)).select("difference", F.col("q")[0].alias("lower_95"), F.col("q")[1].alias("upper_95"), "groups", "drawn")  # one row


def backward_induction(edges: DataFrame, worlds: int, horizon: int) -> DataFrame:
    """(remaining, node, action, utility, best): expected returns over equally likely worlds, in units of worlds**-remaining.

    ``edges`` has unique (node, world, action, next, reward) rows with integer rewards; an action counts where every
    world has it. Values are exact integers scaled by ``worlds ** remaining``; ties go to the least action. A node without
    actions, or with none remaining, is worth nothing. One join a level, no level is revisited.
    """
    whole = Window.partitionBy("node", "action")
    edges = cut(edges.withColumn("__n", F.count("*").over(whole)).where(F.col("__n") == worlds).drop("__n"))
    out, values = None, None
    for left in range(1, horizon + 1):
        gain = F.col("reward").cast("long") * worlds ** (left - 1)
        if values is not None:
            later = values.select(F.col("node").alias("next"), "value")
            paid = edges.join(later, "next", "left").withColumn("u", gain + F.coalesce("value", F.lit(0)))
        else:
            paid = edges.withColumn("u", gain)
        q = paid.groupBy("node", "action").agg(F.sum("u").alias("utility"))
        order = Window.partitionBy("node").orderBy(F.desc("utility"), "action")
        q = cut(q.withColumn("best", F.row_number().over(order) == 1))
        values = q.where("best").select("node", F.col("utility").alias("value"))
        level = q.select(F.lit(left).alias("remaining"), "node", "action", "utility", "best")
        out = level if out is None else out.unionByName(level)
    return out
