"""Ordered, stateful operators: prefixes, returns, ledgers, state machines, calls and responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RULES = 10_000  # bounds the broadcast of first_matching_rule


def history_prefix(turns: DataFrame, by: str, order: str, item: Column) -> DataFrame:
    """Add ``history`` (the items before a row, in order) and ``depth`` (how many)."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumns({"history": F.collect_list(item).over(before), "depth": F.count(item).over(before)})


def returns_to_go(steps: DataFrame, by: str, order: str, reward: str) -> DataFrame:
    """Add ``returns``: the sum of the rewards from a row to the end of its episode."""
    after = Window.partitionBy(by).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return steps.withColumn("returns", F.sum(reward).over(after))


def pair_calls(turns: DataFrame, by: str, order: str, role: str, call: str, response: str) -> DataFrame:
    """Each call row with the order of the next row of its conversation, when that is a response (else null)."""
    w = Window.partitionBy(by).orderBy(order)
    paired = turns.withColumn("answer", F.when(F.lead(role).over(w) == response, F.lead(order).over(w)))
    return paired.where(F.col(role) == call)


def discounted_advantages(steps: DataFrame, by: str, order: str, reward: str, value: str, gamma: float, decay: float) -> DataFrame:
    """(by, order, advantage): generalised advantages, folded from the end of each episode; the value after it is 0.

    Rows of equal order go by reward, then value.
    """
    rows = steps.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(reward).cast("double").alias("r"), F.col(value).cast("double").alias("v")))).alias("x"))
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("adv"), F.array().cast("array<double>").alias("out"))

    def back(a: Column, x: Column) -> Column:
        adv = x["r"] + gamma * a["next"] - x["v"] + gamma * decay * a["adv"]
        return F.struct(x["v"].alias("next"), adv.alias("adv"), F.array_append(a["out"], adv).alias("out"))

    folded = rows.select(by, "x", F.reverse(F.aggregate(F.reverse("x"), start, back)["out"]).alias("adv"))
    return folded.select(by, F.explode(F.arrays_zip("x", "adv")).alias("z")).select(by, F.col("z.x.o").alias(order), F.col("z.adv").alias("advantage"))


def ledger(events: DataFrame, by: str, order: list[str], action: str, quantity: str, initial: int = 0) -> DataFrame:
    """(by, stock, reserved, available, rejected) after the events in order.

    ``receive`` adds stock; ``ship`` and ``reserve`` need as much available (stock less reserved), ``release`` as much
    reserved; what is impossible is rejected whole. Other actions change nothing.
    """
    item = [F.col(action).alias("a"), F.col(quantity).cast("long").alias("q")]
    rows = events.select(F.col(by).alias("k"), *item, *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    places = [f"o{i}" for i in range(len(order))]
    rows = rows.repartition("k").sortWithinPartitions("k", *places, "a", "q").select("k", "a", "q")

    def step(s: tuple, e: tuple) -> tuple:
        stock, reserved, rejected = s
        a, q = e
        free = None if stock is None else stock - reserved
        if a in ("ship", "reserve") and (q is None or free is None or q > free) or a == "release" and (q is None or q > reserved):
            return stock, reserved, rejected + 1
        if a == "receive":
            stock = None if stock is None or q is None else stock + q
        elif a == "ship":
            stock -= q
        elif a in ("reserve", "release"):
            reserved += q if a == "reserve" else -q
        return stock, reserved, rejected

    schema = f"k {rows.schema['k'].dataType.simpleString()}, stock long, reserved long, rejected long"
    state = rows.mapInArrow(_folded((initial, 0, 0), step, ["stock", "reserved", "rejected"], [pa.int64()] * 3), schema)
    return state.select(F.col("k").alias(by), "stock", "reserved", (F.col("stock") - F.col("reserved")).alias("available"), "rejected")


def _folded(start: tuple, step: Callable, names: list[str], types: list[pa.DataType]) -> Callable:
    """Folds rows (k, ...) that come sorted by k: one row a run of equal k, in the memory of one state and one batch."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kind = None, None, None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            keys, *items = (c.to_pylist() for c in batch.columns)
            for k, *e in zip(keys, *items, strict=True):
                if state is None or k != key:
                    if state is not None:
                        done.append((key, *state))
                    key, state = k, start
                state = step(state, tuple(e))
            yield _rows(done, kind)
        if state is not None:
            yield _rows([(key, *state)], kind)

    def _rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = [[r[i] for r in done] for i in range(len(names) + 1)]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [kind, *types], strict=True)], ["k", *names])

    return fold


def state_machine(events: DataFrame, by: str, order: list[str], event: str, initial: str, transitions: dict[tuple[str, str], str]) -> DataFrame:
    """(by, state) after the events in order; events without a transition from the current state are ignored."""
    names = sorted({initial, *(a for a, _ in transitions), *transitions.values()})
    at = {x: i for i, x in enumerate(names)}
    same = tuple(range(len(names)))
    moves = {e: tuple(at[transitions.get((x, e), x)] for x in names) for _, e in transitions}
    rows = events.select(F.col(by).alias("k"), F.col(event).cast("string").alias("e"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    sort = ["k", *[f"o{i}" for i in range(len(order))], "e"]
    # Blocks of the order: one key's events meet in many tasks, each of which gives where every state leads.
    blocks = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).select("k", "e")
    fold = _folded((same,), lambda s, x: (tuple(moves[x[0]][i] for i in s[0]),) if x[0] in moves else s, ["to"], [pa.list_(pa.int32())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        for x in fold(batches):
            yield x.append_column("block", pa.array([block] * x.num_rows, pa.int32()))

    maps = blocks.mapInArrow(mapped, f"k {rows.schema['k'].dataType.simpleString()}, to array<int>, block int")
    lists = maps.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("block", "to"))).alias("x"))  # one map a block
    last = F.aggregate("x", F.lit(at[initial]), lambda s, x: F.get(x["to"], s))
    return lists.select(F.col("k").alias(by), F.get(F.array(*map(F.lit, names)), last).alias("state"))


def first_matching_rule(rows: DataFrame, key: str, rules: DataFrame, condition: Column, default: str) -> DataFrame:
    """(key, result): the result of the first rule (by ``position``) that holds for the row, or the default.

    ``condition`` refers to the row as ``r`` and to the rule as ``p``. Rules are broadcast; more than ``MAX_RULES`` raise.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    hit = rows.alias("r").join(F.broadcast(rules).alias("p"), condition, "left")
    return hit.groupBy(F.col(f"r.{key}").alias(key)).agg(F.coalesce(F.min_by("p.result", "p.position"), F.lit(default)).alias("result"))


def business_deadline(starts: DataFrame, start: str, days: int, holidays: DataFrame, horizon: int) -> DataFrame:
    """Add ``deadline``: the day ``days`` business days after ``start``; weekends and ``holidays`` (day) never count.

    Looks ``horizon`` days ahead, which must cover the days asked for; distinct start days are expanded, not rows.
    """
    each = starts.select(start).distinct().withColumn("day", F.explode(F.sequence(F.date_add(start, 1), F.date_add(start, horizon))))
    open_days = each.where(F.weekday("day") < 5).join(holidays.select("day"), "day", "left_anti")
    order = Window.partitionBy(start).orderBy("day")
    nth = open_days.withColumn("n", F.row_number().over(order)).where(F.col("n") == days).select(start, F.col("day").alias("deadline"))
    return starts.join(nth, start, "left")
