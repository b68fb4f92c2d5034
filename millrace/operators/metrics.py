"""Metrics over prediction rows: id, group_id, task, target (0 or 1), p (probability of 1), choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordinals import numbered
from millrace.runtime import cut

FLOOR = 1e-12


def row_scores(rows: DataFrame) -> DataFrame:
    """Add accuracy, log_loss (of the target's probability, floored) and brier (over both options)."""
    hit = F.when(F.col("target") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return rows.withColumns(
        {
            "accuracy": (F.col("choice") == F.col("target")).cast("double"),
            "log_loss": -F.log(F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), hit))),
            "brier": 2 * F.pow(1 - hit, 2),
        }
    )


def means(scored: DataFrame, *by: str) -> DataFrame:
    """Row means of the scores and the row count per group."""
    return scored.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("accuracy", "log_loss", "brier")])


def macro_means(scored: DataFrame, task: str = "task") -> DataFrame:
    """Equal-task means: the mean over tasks of each task's mean."""
    return means(scored, task).agg(F.count("*").alias("tasks"), *[F.avg(c).alias(c) for c in ("accuracy", "log_loss", "brier")])


def paired(base: DataFrame, trained: DataFrame) -> DataFrame:
    """Inner join of two prediction sets on id; rows that differ in group, task or target, or lack a partner, raise."""
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("group_id", "task", "target")]
    agreed = F.col("b.id").isNotNull() & F.col("t.id").isNotNull() & same[0] & same[1] & same[2]
    joined = base.alias("b").join(trained.alias("t"), F.col("b.id") == F.col("t.id"), "full")
    checked = joined.where(F.when(agreed, True).otherwise(F.raise_error(F.lit("prediction sets do not match")).isNull()))
    pick = lambda s: [F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("accuracy", "log_loss", "brier")]
    return checked.select(F.col("b.id").alias("id"), F.col("b.group_id").alias("group_id"), F.col("b.task").alias("task"), *pick("b"), *pick("t"))


def bin_floor(p: Column, bins: int) -> Column:
    """floor(p * bins), 1.0 in the last bin."""
    return F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1))


def bin_edges(p: Column, bins: int) -> Column:
    """Bin by comparison with the edges i / bins: an edge belongs to the bin above, 1.0 to the last."""
    n = F.lit(0)
    for i in range(1, bins):
        n = n + (p >= i / bins).cast("int")
    return n


def bin_closed_above(p: Column, bins: int) -> Column:
    """Bin by the edges i / bins, an edge belonging to the bin below."""
    n = F.lit(0)
    for i in range(1, bins):
        n = n + (p > i / bins).cast("int")
    return n


def reliability(rows: DataFrame, bin_of: Column, *by: str) -> DataFrame:
    """Per bin: rows, mean forecast, share of ones and their gap."""
    return (
        rows.withColumn("bin", bin_of)
        .groupBy(*by, "bin")
        .agg(F.count("*").alias("n"), F.avg("p").alias("forecast"), F.avg(F.col("target").cast("double")).alias("observed"))
        .withColumn("gap", F.abs(F.col("forecast") - F.col("observed")))
    )


def expected_calibration_error(bins: DataFrame, *by: str) -> DataFrame:
    """Count-weighted mean gap."""
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def risk_coverage(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per confidence threshold: coverage and the accuracy of the rows covered (null for none)."""
    each = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    kept = F.greatest("p", 1 - F.col("p")) >= F.col("threshold")
    return each.groupBy("threshold").agg(
        F.avg(kept.cast("double")).alias("coverage"), F.avg(F.when(kept, F.col("accuracy"))).alias("selective_accuracy")
    )


def cost_workflow(rows: DataFrame, thresholds: list[float], inspection_costs: list[float]) -> DataFrame:
    """Per threshold and inspection cost: mean cost of acting on the forecast, of acting on the outcome, and regret.

    Acting costs the threshold, waiting costs one where the outcome is 1, inspecting costs its price plus the best of
    both once the outcome is known; the first of equal expected costs (act, wait, inspect) is taken.
    """
    grid = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn(
        "inspection", F.explode(F.array(*map(F.lit, inspection_costs)))
    )
    t, c, p, y = F.col("threshold"), F.col("inspection"), F.col("p"), F.col("target").cast("double")
    act, wait, look = t, p, c + p * F.least(t, F.lit(1.0))
    best = F.least(act, wait, look)
    paid = F.when(act == best, t).when(wait == best, y).otherwise(c + y * F.least(t, F.lit(1.0)))
    ideal = F.least(t, y)
    return grid.groupBy("threshold", "inspection").agg(
        F.avg(paid).alias("cost"), F.avg(ideal).alias("ideal"), F.avg(paid - ideal).alias("regret")
    )


def temperature_grid(rows: DataFrame, points: int = 201, low: float = 0.05, high: float = 20.0) -> DataFrame:
    """The temperature on a logarithmic grid with the least mean log loss (the first of equals): index, temperature, loss."""
    step = F.col("index") / (points - 1)
    grid = rows.withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("temperature", F.lit(low) * F.pow(F.lit(high / low), step))
    q = F.greatest(F.lit(FLOOR), F.least(F.lit(1 - FLOOR), F.col("p")))
    logit = F.log(q / (1 - q)) / F.col("temperature")
    scaled = 1 / (1 + F.exp(-logit))
    hit = F.when(F.col("target") == 1, scaled).otherwise(1 - scaled)
    losses = grid.groupBy("index", "temperature").agg(F.avg(-F.log(F.greatest(F.lit(FLOOR), hit))).alias("loss"))
    best = losses.agg(F.min(F.struct(F.round("loss", 12), "index", "temperature")).alias("b"))
    return best.select("b.index", "b.temperature", F.col("b.col1").alias("loss"))


def ablation_ceiling(rows: DataFrame, visible: list[str], target: str) -> DataFrame:
    """Rows, and the accuracy of the best constant answer per visible input."""
    counts = rows.groupBy(*visible, target).agg(F.count("*").alias("n"))
    best = counts.groupBy(*visible).agg(F.max("n").alias("best"), F.sum("n").alias("rows"))
    return best.agg(F.sum("rows").alias("rows"), (F.sum("best") / F.sum("rows")).alias("ceiling"))


def spread(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, sample deviation (0 for a single row), min and max."""
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def gates(candidate: DataFrame, original: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """Per key and metric: whether the candidate is at most the tolerance below the original."""
    joined = candidate.alias("c").join(original.alias("o"), key)
    out = [(F.col(f"c.{m}") >= F.col(f"o.{m}") - t).alias(f"{m}_passes") for m, t in tolerances.items()]
    return joined.select(key, *out)


def cluster_bootstrap(rows: DataFrame, group: str, value: str, resamples: int, seed: int = 41) -> DataFrame:
    """difference, lower_95, upper_95, rows, groups: groups resampled whole, with replacement.

    Draws are hashes of (seed, resample, draw), so results do not depend on partitioning. Each group makes one draw a
    resample in its own place, so draws are spread like the groups, and meets the groups by their numbers, which come
    from ranges. Null groups count as one, null values are ignored; no rows give nulls and zeros.
    """
    sums = rows.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    ranked = cut(numbered(sums, [], [group], "k").select((F.col("k") - 1).alias("k"), "s", "n"))
    total = ranked.agg(F.count("*").alias("groups"), F.sum("s").alias("all_s"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    draws = ranked.select(F.col("k").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    number = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "r", "d"), 256), 1, 8), 16, 10).cast("long")
    drawn = draws.join(F.broadcast(total.select("groups"))).select("r", (number % F.col("groups")).alias("k"))  # one row
    estimates = drawn.join(ranked, "k").groupBy("r").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("e"))
    ends = estimates.agg(F.percentile("e", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return total.join(F.broadcast(ends)).select(  # one row each
        (F.col("all_s") / F.nullif("rows", F.lit(0))).alias("difference"), F.col("q")[0].alias("lower_95"), F.col("q")[1].alias("upper_95"), "rows", "groups"
    )
