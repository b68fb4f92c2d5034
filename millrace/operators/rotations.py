"""Round robin over overlapping groups, with caps that hold across them.

Each group has a queue of its rows in a seeded order. In every round the groups with rows left come in a seeded order,
and each takes the first row of its queue whose caps still have room; rows passed over leave the queue for good.

One turn after another would be as many steps as rows. Instead every place in a queue is a claim, and a claim's turn is
known within bounds: as if all open claims before it in its queue failed, or all succeeded. A claim fails when caps are
used up by claims that come before it at their latest, and succeeds when even all that may come before it leave room.
Claims that no cap contests succeed at once. Of the claims open, the one whose turn is first can always be decided, so
rounds end; those decided leave the state, which is the contested claims alone. The schedule is that of the plain turns.

Each round of joins decides about one round of turns, whatever the number of groups; a schedule of few rounds is cheap,
however many rows wait. Claims that come after the places required leave as soon as that is certain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordinals import numbered
from millrace.operators.schedules import seeded
from millrace.runtime import cut

STATE_ROWS = 100_000  # claims that a partition of the state holds about
_CLAIM = ["part", "group", "pos"]


def _turn(seed: str, number: Column) -> Column:
    """When a group has its turn of this number: by the round, then by the groups' seeded order in it."""
    order = seeded(seed, F.lit("round"), F.col("part"), number, F.col("group"))
    named = {"part": F.col("part"), "round": number, "order": order, "group": F.col("group")}
    return F.named_struct(*[x for k, v in named.items() for x in (F.lit(k), v)])


def _verdicts(state: DataFrame, seed: str) -> DataFrame:
    """(claim, most, taken) of the open claims that can be decided; ``most`` is the last round that it may be."""
    before = Window.partitionBy("part", "group").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda status: F.coalesce(F.count_if(F.col("status") == status).over(before), F.lit(0))
    timed = state.withColumn("least", F.col("base") + count("taken") + 1).withColumn("most", F.col("least") + count("open"))
    timed = timed.select(*_CLAIM, "status", "most", F.inline("caps"), _turn(seed, F.col("least")).alias("first"), _turn(seed, F.col("most")).alias("last"))
    open_ = F.col("status") == "open"
    # Of equal turns, questions come before what they count.
    may = F.named_struct(F.lit("at"), F.col("first"), F.lit("kind"), F.lit(1))
    does = F.named_struct(F.lit("at"), F.col("last"), F.lit("kind"), F.lit(2))
    fails = F.named_struct(F.lit("at"), F.col("first"), F.lit("kind"), F.lit(0))
    wins = F.named_struct(F.lit("at"), F.col("last"), F.lit("kind"), F.lit(-1))
    events = F.when(open_, F.array(may, fails, wins)).otherwise(F.array(may, does))
    spread = timed.select(*_CLAIM, "most", "cap_key", "cap", (F.col("first") < F.col("last")).alias("loose"), F.inline(events))
    so_far = Window.partitionBy("cap_key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = spread.select(
        *_CLAIM,
        "most",
        "cap",
        "kind",
        F.coalesce(F.count_if(F.col("kind") == 2).over(so_far), F.lit(0)).alias("before"),
        # A claim whose turn is open counts itself among those that may come before its latest.
        (F.coalesce(F.count_if(F.col("kind") == 1).over(so_far), F.lit(0)) - F.col("loose").cast("long")).alias("may_be"),
    )
    each = seen.where("kind < 1").groupBy(*_CLAIM, "most").agg(
        F.bool_or((F.col("kind") == 0) & (F.col("before") >= F.col("cap"))).alias("fails"),
        F.bool_and((F.col("kind") == 0) | (F.col("may_be") < F.col("cap"))).alias("wins"),
    )
    return each.where("fails or wins").select(*_CLAIM, "most", (~F.col("fails")).alias("taken"))


def _settled(claims: DataFrame) -> DataFrame:
    """Mark taken claims that meet no open one under any cap: they are ``gone``, and only move others' turns."""
    contested = claims.where("status = 'open'").select(F.explode("caps.cap_key").alias("cap_key")).distinct()
    mine = claims.where("status = 'taken'").select(*_CLAIM, F.explode("caps.cap_key").alias("cap_key"))
    stay = mine.join(contested, "cap_key", "left_semi").select(*_CLAIM).distinct().withColumn("stays", F.lit(True))
    status = F.when((F.col("status") == "taken") & F.col("stays").isNull(), "gone").otherwise(F.col("status"))
    return claims.join(stay, _CLAIM, "left").withColumn("status", status).drop("stays")


def _last_round(taken: DataFrame, required: int) -> tuple[int, int] | None:
    """(part, round) by which ``required`` turns are certain, None if they are not yet."""
    rounds = taken.groupBy("part", "most").agg(F.count("*").alias("n"))
    so_far = Window.orderBy("part", "most").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a round
    found = rounds.orderBy("part", "most").limit(required).withColumn("n", F.sum("n").over(so_far)).where(F.col("n") >= required)
    first = found.agg(F.min(F.struct("part", "most")).alias("at")).first()["at"]
    return first and (first["part"], first["most"])


def _without_gone(claims: DataFrame) -> DataFrame:
    """Drop claims that are gone; the later claims of their groups remember how many there were."""
    before = Window.partitionBy("part", "group").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.count_if(F.col("status") == "gone").over(before), F.lit(0))
    return claims.withColumn("base", F.col("base") + gone).where("status <> 'gone'")


def rotating_groups(
    members: DataFrame,
    key: str,
    group: str,
    seed: str,
    required: int | None = None,
    visits: int = 1,
    coverage_first: bool = False,
    shared: dict[str, int] | None = None,
) -> DataFrame:
    """(place, key, group, pass, round): a schedule of ``required`` places, all that can be had if None.

    ``members`` has (key, group) rows, a row in as many groups as it likes; repeats count once and rows with a null key or
    group do not count. No row has more than ``visits`` places over all its groups. With ``coverage_first`` there are
    ``visits`` passes, each of which gives every row one place. ``shared`` names further columns of ``members``, one value
    a row, and how many places each of their values may have, in all passes together; nulls have no cap.

    Raises ValueError if there are fewer than ``required`` places. An empty table gives no places. A group's contested
    claims pass one sorted window a round, which spills; whatever no cap contests passes none.
    """
    shared = shared or {}
    pairs = members.where(F.col(key).isNotNull() & F.col(group).isNotNull())
    pairs = pairs.groupBy(F.col(key).alias("key"), F.col(group).alias("group")).agg(F.count("*").alias("times"), *[F.max(c).alias(f"cap_{i}") for i, c in enumerate(shared)])
    if coverage_first and shared:
        raise ValueError("passes with shared caps would depend on each other")
    turns = F.sequence(F.lit(1), F.lit(visits))
    claims = pairs.select("*", F.explode(turns).alias("visit")).withColumn("part", F.col("visit") if coverage_first else F.lit(1))
    claims = claims.withColumn("shuffled", seeded(seed, F.lit("visit"), F.col("visit").cast("string"), F.col("key")))
    if required is not None and not shared:
        # Before the last place required, a group's queue has given at most so many places and passed over at most so many
        # claims, since each of these is of a row that has had a place, once a visit: nothing behind them comes to its turn.
        queue = F.row_number().over(Window.partitionBy("part", "group").orderBy("visit", "shuffled", "key"))
        claims = cut(claims.withColumn("queue", queue).where(F.col("queue") <= 2 * max(required, 0)).drop("queue"))
    claims = numbered(claims, ["part", "group"], ["visit", "shuffled", "key"], "pos")
    cap = lambda name, value, room: F.struct(F.concat(F.lit(f"{name}:"), value).alias("cap_key"), F.lit(room).cast("long").alias("cap"))
    own = cap("row", F.concat_ws(":", F.col("part").cast("string"), F.col("key").cast("string")), 1 if coverage_first else visits)
    others = [cap(f"shared {i}", F.col(f"cap_{i}").cast("string"), n) for i, n in enumerate(shared.values())]
    caps = F.filter(F.array(own, *others), lambda c: c["cap_key"].isNotNull())
    claims = cut(claims.select(*_CLAIM, "key", caps.alias("caps")))
    # A claim is contested if any of its caps may be used up.
    used = claims.select(*_CLAIM, F.inline("caps")).withColumn("asked", F.count("*").over(Window.partitionBy("cap_key")))
    contested = used.groupBy(*_CLAIM).agg(F.bool_or(F.col("asked") > F.col("cap")).alias("contested"))
    status = F.when(F.col("contested"), "open").otherwise("gone")
    begun = cut(claims.join(contested, _CLAIM).select(*_CLAIM, "caps", status.alias("status"), F.lit(0).cast("long").alias("base")))
    taken = [begun.where("status = 'gone'").select(*_CLAIM, F.col("pos").alias("most"))]
    state = cut(_without_gone(begun), STATE_ROWS)
    while state.where("status = 'open'").take(1):
        last = required and _last_round(reduce(DataFrame.unionByName, taken), required)
        if last:  # places beyond are not asked for, and later turns change nothing before them
            state = state.where((F.col("part") < last[0]) | ((F.col("part") == last[0]) & (F.col("base") < last[1])))
        decided = cut(_verdicts(state, seed), STATE_ROWS)
        taken.append(decided.where("taken").select(*_CLAIM, "most"))
        if last and not decided.take(1):
            break
        known = state.join(decided.drop("most"), _CLAIM, "left").where("status = 'taken' or coalesce(taken, true)")
        known = known.withColumn("status", F.when(F.col("taken"), "taken").otherwise(F.col("status"))).drop("taken")
        state = cut(_without_gone(_settled(known)), STATE_ROWS)
    all_taken = reduce(DataFrame.unionByName, taken).select(*_CLAIM)
    rounds = numbered(all_taken, ["part", "group"], ["pos"], "round")
    placed = rounds.withColumn("order", seeded(seed, F.lit("round"), F.col("part"), F.col("round"), F.col("group")))
    placed = cut(numbered(placed, [], ["part", "round", "order", "group"], "place"))
    if required is not None:
        if placed.count() < required:
            raise ValueError("the groups' rows are used up before the places required")
        placed = placed.where(F.col("place") <= required)
    return placed.join(claims.select(*_CLAIM, "key"), _CLAIM).select("place", F.col("key").alias(key), F.col("group").alias(group), F.col("part").alias("pass"), "round")
