"""Acquisition of observations: exact integrals over all paths of a policy, and picks that adapt to what is left.

A policy that may buy one of a few observations, again and again, and then reports a probability, goes through the
lattice of subsets of what it holds. Its probability mass is carried through the lattice one level at a time, as an array
with an entry a subset, so every path counts with its exact weight and none is sampled or listed.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.operators.ordinals import numbered


def lattice_mass(buy: Column, bits: int) -> Column:
    """Mass that reaches each mask of ``bits`` observations, from an array (by mask) of arrays of purchase probabilities.

    An entry of the result is the sum over the masks one purchase short of it; what is held already is not bought again,
    whatever its probability says.
    """
    masks = range(1 << bits)

    def level(mass: Column, held: int) -> Column:
        entries = []
        for m in masks:
            if m.bit_count() != held:
                entries.append(F.get(mass, F.lit(m)))
                continue
            came = [F.get(mass, F.lit(m ^ 1 << b)) * F.get(F.get(buy, F.lit(m ^ 1 << b)), F.lit(b)) for b in range(bits) if m >> b & 1]
            entries.append(reduce(lambda a, b: a + b, came))
        return F.array(*entries)

    # Each level is bound before the next reads it several times.
    def up(mass: Column, held: int) -> Column:
        if held > bits:
            return mass
        return let(level(mass, held), lambda x: up(x, held + 1))

    return up(F.array(*[F.lit(1.0 if m == 0 else 0.0) for m in masks]), 1)


def integrate_paths(cases: DataFrame, policies: DataFrame, reports: list[float], bits: int, case_id: str = "case_id", duplicates: tuple[int, ...] = ()) -> DataFrame:
    """(case_id, mass, brier, spent, purchases, duplicate, terminal_mean, reward, valid): exact expectations of a policy.

    ``cases`` has (case_id, outcome, costs): the outcome 0 or 1 and an array of ``bits`` prices. ``policies`` has
    (case_id, mask, stop, buy) rows, one a mask: the probabilities of each of ``reports`` and of buying each observation,
    which together add up to one; what is held cannot be bought, and counts as nothing. ``mass`` is the sum over all masks
    of the mass that stops there, one where the policy is proper; ``duplicates`` are the observations that repeat others.

    ``valid`` is false where a reachable mask has no policy, or its probabilities do not add up to one; the other columns
    are then null. Cases without any policy are kept, rows of policies without a case are left out. An empty table gives
    an empty result.
    """
    size = 1 << bits
    known = policies.where(F.col("mask").between(0, size - 1))
    entry = F.struct(F.col("mask").cast("int").alias("mask"), F.col("stop").alias("stop"), F.col("buy").alias("buy"))
    # At most one entry a mask: repeated rows of a mask count once, the least.
    once = known.groupBy(case_id, "mask").agg(F.min(entry).alias("e"))
    table = once.groupBy(case_id).agg(F.map_from_entries(F.collect_list(F.struct("e.mask", F.struct("e.stop", "e.buy")))).alias("policy"))
    # Merged by sorting: Spark takes the maps for as small as the columns they are made of, and would broadcast them all.
    held = cases.join(table.hint("merge"), case_id, "left")
    masks = F.sequence(F.lit(0), F.lit(size - 1))
    of = lambda m: F.try_element_at("policy", m)
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    free = lambda m, b: F.shiftright(m, b).bitwiseAND(1) == 0
    legal = lambda m: F.array(*[F.when(free(m, b), F.coalesce(F.get(of(m)["buy"], F.lit(b)), F.lit(0.0))).otherwise(0.0) for b in range(bits)])
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    rows = held.withColumns(
        {
            "__buy": F.transform(masks, legal),
            "__stop": F.transform(masks, lambda m: F.coalesce(of(m)["stop"], zeros(len(reports)))),
        }
    )
    rows = rows.withColumn("__mass", lattice_mass(F.col("__buy"), bits))
    total = F.transform(masks, lambda m: add(F.get("__buy", m)) + add(F.get("__stop", m)))
    proper = F.forall(F.zip_with("__mass", total, lambda w, t: F.struct(w.alias("w"), t.alias("t"))), lambda x: (x["w"] == 0) | (F.abs(x["t"] - 1) <= 1e-9))
    over = lambda f: add(F.transform(masks, lambda m: F.get("__mass", m) * f(m)))
    report = F.array(*map(F.lit, reports))
    error = F.transform(report, lambda r: F.pow(r - F.col("outcome"), F.lit(2)))
    dot = lambda a, b: add(F.zip_with(a, b, lambda x, y: x * y))
    bought = F.array(*[F.lit(float(b in duplicates)) for b in range(bits)])
    out = rows.select(
        case_id,
        (F.col("policy").isNotNull() & proper).alias("valid"),
        over(lambda m: add(F.get("__stop", m))).alias("mass"),
        over(lambda m: dot(F.get("__stop", m), error)).alias("brier"),
        over(lambda m: dot(F.get("__buy", m), F.col("costs"))).alias("spent"),
        over(lambda m: add(F.get("__buy", m))).alias("purchases"),
        over(lambda m: dot(F.get("__buy", m), bought)).alias("duplicate"),
        over(lambda m: dot(F.get("__stop", m), report)).alias("terminal_mean"),
    ).withColumn("reward", 1 - F.col("brier") - F.col("spent"))
    values = ["mass", "brier", "spent", "purchases", "duplicate", "terminal_mean", "reward"]
    return out.select(case_id, "valid", *[F.when(F.col("valid"), F.col(c)).alias(c) for c in values])


def adaptive_places(rows: int, seed: str, n: int, share: Fraction, weight: Fraction) -> list[tuple[int, int, int, Fraction]]:
    """(pick, remaining, rank, probability) of ``n`` draws without replacement from rows ranked from 1 on.

    Each draw is from a mixture: ``weight`` is spread over the first ``share`` of the rows that remain (rounded up), the
    rest over all of them. Draws are seeded numbers below 2**64 and compared exactly, so receipts are fractions.
    """
    if n > rows:
        raise ValueError("fewer rows than picks")
    taken: list[int] = []  # ranks, ascending
    out = []
    for t in range(n):
        left = rows - t
        top = max(1, -(-share.numerator * left // share.denominator))
        low = (1 - weight) / left
        high = low + weight / top
        u = Fraction(int(hashlib.sha256(f"{seed}:pick:{t}".encode()).hexdigest()[:16], 16), 1 << 64)
        at = u // high if u < top * high else top + (u - top * high) // low
        rank = min(int(at), left - 1) + 1
        for gone in taken:  # the ranks of what has left are skipped
            rank += gone <= rank
        taken = sorted([*taken, rank])
        out.append((t + 1, left, rank, high if at < top else low))
    return out


def adaptive_picks(
    rows: DataFrame, key: str, score: str, chosen: DataFrame, seed: str, n: int, share: Fraction = Fraction(1, 5), weight: Fraction = Fraction(3, 4)
) -> DataFrame:
    """(key, pick, remaining, score, numerator, denominator): ``n`` seeded picks that favour the highest scores left.

    ``rows`` has unique keys; those of ``chosen`` are picked already. With ``remaining`` rows left, a pick is one of their
    top ``share`` by (score descending, key) with probability ``weight``, and any of them with the rest; its probability,
    given the picks before, is exact, and over all rows that remain such probabilities add up to one.

    The order does not change while rows leave, so a pick is a place in it: rows are ranked once, over many tasks, and the
    ``n`` places, a parameter, are drawn beside them. Null scores come last; NaN counts as null; rows with null keys are
    left out. Raises ValueError if fewer than ``n`` rows are left.
    """
    value = F.col(score).cast("double")
    open_ = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.when(~F.isnan(value), value).alias("score"))
    open_ = open_.join(chosen.select(F.col(key).alias("k")).distinct(), "k", "left_anti")
    ranked = numbered(open_.withColumn("least", F.coalesce(-F.col("score"), F.lit(float("inf")))), [], ["least", "k"], "rank")
    made = adaptive_places(ranked.count(), seed, n, share, weight)
    places = [(t, left, rank, str(p.numerator), str(p.denominator)) for t, left, rank, p in made]
    drawn = rows.sparkSession.createDataFrame(places, "pick int, remaining long, rank long, numerator string, denominator string")
    return ranked.join(drawn, "rank").select(F.col("k").alias(key), "pick", "remaining", "score", "numerator", "denominator")
