"""Joins of tables that belong together by position, or by a digest of nested public context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordinals import file_positions
from millrace.runtime import cut


def positional_join(left: DataFrame, right: DataFrame, same: list[str], values: list[str]) -> DataFrame:
    """``left`` with ``position`` and the columns ``values`` of the row of ``right`` at the same position.

    Both frames read files; positions follow file names, blocks and rows, and are joined by number, so no side is held or
    sorted as a whole. Raises ValueError if the lengths differ, if ids (the first of ``same``) repeat or there are none, or
    if any column of ``same`` differs at any position; a null equals a null.
    """
    a = cut(file_positions(left))
    b = cut(file_positions(right).select("position", *[F.col(c).alias(f"__{c}") for c in (*same, *values)]))
    one, other = a.count(), b.count()
    if one != other:
        raise ValueError(f"{one} rows, but {other} at their side")
    if not one or a.groupBy(same[0]).count().where("count > 1").take(1):
        raise ValueError("no rows, or repeated ids")
    both = a.join(b, "position")
    differs = ~F.lit(True)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    if both.where(differs).take(1):
        raise ValueError("identities differ at the same position")
    return both.select(*left.columns, "position", *[F.col(f"__{c}").alias(c) for c in values])


def join_on_context(decisions: DataFrame, forecasts: DataFrame, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """((decision_id, reason), (reason, n)): which decisions have a forecast for every one of their options.

    ``decisions`` has (decision_id, option, context, worlds, cost, utility), one row an option, ``forecasts`` (context,
    worlds, value): ``context`` is the digest of what is public, ``worlds`` an array. Reasons: ``missing_exact_public_forecast``
    if any option has none, ``different_underlying_world_population`` if any has one of other worlds (as sets), else null.
    Raises ValueError if a context has two forecasts, or an admitted option's value less its cost is not its utility.
    """
    if forecasts.groupBy("context").count().where("count > 1").take(1):
        raise ValueError("two forecasts for one context")
    sorted_set = lambda c: F.array_sort(F.array_distinct(c))
    known = forecasts.select("context", sorted_set("worlds").alias("__of"), "value")
    joined = decisions.join(known, "context", "left").withColumn("__mine", sorted_set("worlds"))
    each = joined.groupBy("decision_id").agg(
        F.bool_or(F.col("__of").isNull()).alias("missing"),
        F.bool_or(~F.col("__of").eqNullSafe(F.col("__mine"))).alias("other"),
        F.bool_or(F.abs(F.col("value") - F.col("cost") - F.col("utility")) > tolerance).alias("disagrees"),
    )
    reason = F.when(F.col("missing"), "missing_exact_public_forecast").when(F.col("other"), "different_underlying_world_population")
    judged = cut(each.select("decision_id", reason.alias("reason"), "disagrees"))
    if judged.where("reason is null and disagrees").take(1):
        raise ValueError("a forecast and a decision state different results")
    return judged.select("decision_id", "reason"), judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def exact_marginals(rows: DataFrame, group: str, weight: str, dimensions: list[str]) -> DataFrame:
    """(group, of, value, numerator, denominator): exact shares of whole weights, of each dimension and of all together.

    Sums of whole numbers are exact and merge before the shuffle; a share is reduced to lowest terms. The joint rows have
    ``of`` = ``joint`` and the values joined by blanks. Shares of a group and ``of`` add up to one exactly: that is tested
    against the group's total, and a group without weight, or with a negative or null one, raises ValueError.
    """
    whole = rows.withColumn("__w", F.col(weight).cast("decimal(38,0)"))
    bad = F.bool_or(F.col("__w").isNull() | (F.col("__w") < 0) | (F.col("__w") != F.col(weight)))
    totals = cut(whole.groupBy(group).agg(F.sum("__w").alias("total"), bad.alias("bad")))
    if totals.where("bad or total = 0").take(1):
        raise ValueError("weights must be whole, and some of each group above zero")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    of = lambda name, value: F.struct(F.lit(name).alias("of"), value.alias("value"))
    parts = F.array(*[of(c, text(c)) for c in dimensions], of("joint", F.concat_ws(" ", *map(text, dimensions))))
    sums = whole.select(group, "__w", F.inline(parts)).groupBy(group, "of", "value").agg(F.sum("__w").alias("__n"))
    keyed = sums.join(totals.select(F.col(group).alias("__g"), "total"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    return cut(keyed.select(group, "of", "value", lowest_terms(F.col("__n"), F.col("total")).alias("f"))).select(
        group, "of", "value", F.col("f.numerator").alias("numerator"), F.col("f.denominator").alias("denominator")
    )


def lowest_terms(numerator: Column, denominator: Column) -> Column:
    """(numerator, denominator) of two whole decimals in lowest terms, the denominator above zero."""

    @F.arrow_udf("struct<numerator: decimal(38,0), denominator: decimal(38,0)>")
    def reduce_(a, b):
        import math
        from decimal import Decimal

        import pyarrow as pa

        pairs = [(int(x), int(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        made = [(Decimal(x // g), Decimal(y // g)) for x, y in pairs for g in [math.gcd(x, y)]]
        kind = pa.decimal128(38, 0)
        return pa.StructArray.from_arrays([pa.array([m[0] for m in made], kind), pa.array([m[1] for m in made], kind)], ["numerator", "denominator"])

    return reduce_(numerator, denominator)
