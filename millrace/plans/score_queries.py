"""Scores over groups, templates, contexts and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import records as R
from millrace.plans.registry import query
from millrace.sources.tables import table


@query(
    "multi_group_means",
    """WITH r AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END AS x, unnest(list_distinct([c_mktsegment, 'nation ' || (c_nationkey % 3), 'all'])) AS g FROM customer), m AS (SELECT g, count(*) AS n, avg(x) AS mean FROM r GROUP BY 1)
    SELECT g, n, round(mean, 6) AS mean, round((SELECT avg(mean) FROM m), 6) AS macro FROM m""",
)
def multi_group_means(spark, sf_dir):
    groups = F.array_distinct(F.array(F.col("c_mktsegment"), F.concat(F.lit("nation "), (F.col("c_nationkey") % 3).cast("string")), F.lit("all")))
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0).alias("x"), F.explode(groups).alias("g"))
    means = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    return means.join(F.broadcast(means.agg(F.avg("mean").alias("macro")))).select("g", "n", F.round("mean", 6).alias("mean"), F.round("macro", 6).alias("macro"))  # one row


@query(
    "input_frequencies",
    """WITH r AS (SELECT l_suppkey * 10 + l_linenumber AS input, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, l_discount * 5 AS f FROM lineitem), g AS (SELECT input, count(*) AS n, avg(y) AS world, max(f) - min(f) AS spread FROM r GROUP BY 1)
    SELECT world NOT IN (0, 1) AS ambiguous, count(*) AS rows, round(avg(pow(world - y, 2)), 6) AS world_brier, round(avg(pow(f - y, 2)), 6) AS model_brier, round(max(spread), 6) AS spread FROM r JOIN g USING (input) GROUP BY 1""",
)
def input_frequencies(spark, sf_dir):
    y = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    r = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("input"), y.alias("y"), (F.col("l_discount") * 5).alias("f"))
    # Sums per input tell both scores: no join back to the rows.
    g = r.groupBy("input").agg(F.count("*").alias("n"), F.avg("y").alias("world"), F.sum(F.pow(F.col("f") - F.col("y"), 2)).alias("model"), (F.max("f") - F.min("f")).alias("spread"))
    own = F.col("n") * F.col("world") * (1 - F.col("world"))  # sum of (world - y)^2, y being 0 or 1
    return g.groupBy((~F.col("world").isin(0.0, 1.0)).alias("ambiguous")).agg(
        F.sum("n").alias("rows"), F.round(F.sum(own) / F.sum("n"), 6).alias("world_brier"), F.round(F.sum("model") / F.sum("n"), 6).alias("model_brier"), F.round(F.max("spread"), 6).alias("spread")
    )


@query(
    "template_baseline",
    """WITH r AS (SELECT p_partkey, regexp_replace(p_brand || ' size ' || p_size % 9 || p_type, '\\d+(\\.\\d+)?', 'N', 'g') AS t, p_retailprice > 1200 AS yes FROM part), f AS (SELECT t, count(*) FILTER (yes) AS s, count(*) AS n FROM r WHERE p_partkey % 5 > 0 GROUP BY 1)
    SELECT p_partkey, round((coalesce(s, 0) + 1) / (coalesce(n, 0) + 2), 6) AS p, n IS NOT NULL AS seen, CASE WHEN (coalesce(s, 0) + 1) / (coalesce(n, 0) + 2) >= 0.5 THEN 'yes' ELSE 'none' END AS choice FROM r LEFT JOIN f USING (t) WHERE p_partkey % 5 = 0""",
)
def template_baseline(spark, sf_dir):
    command = F.concat("p_brand", F.lit(" size "), (F.col("p_size") % 9).cast("string"), "p_type")
    rows = table(spark, sf_dir, "part").select("p_partkey", R.command_template(command).alias("t"), (F.col("p_retailprice") > 1200).alias("yes"))
    known = rows.where("p_partkey % 5 > 0").groupBy("t").agg(F.count_if("yes").alias("s"), F.count("*").alias("n"))
    p = (F.coalesce("s", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)
    asked = rows.where("p_partkey % 5 = 0").join(known, "t", "left")
    return asked.select("p_partkey", F.round(p, 6).alias("p"), F.col("n").isNotNull().alias("seen"), F.when(p >= 0.5, "yes").otherwise("none").alias("choice"))


@query(
    "outcome_utilities",
    "SELECT p_partkey, round(0.5 * p_size / 50.0 + 1.0 * (1 - p_size / 50.0) * 0.6 - 0.2 * (1 - p_size / 50.0) * 0.4 - p_retailprice / 100000, 6) AS utility FROM part",
)
def outcome_utilities(spark, sf_dir):
    share = F.col("p_size") / 50.0
    outcomes = F.array(share, (1 - share) * 0.6, (1 - share) * 0.4)
    worth = F.array(F.lit(0.5), F.lit(1.0), F.lit(-0.2))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(R.expected_utility(outcomes, worth, F.col("p_retailprice") / 100000), 6).alias("utility"))


@query(
    "stop_decisions",
    """WITH d AS (SELECT l_discount * 10 AS p, l_tax * 12.5 AS q FROM lineitem), a AS (SELECT CASE WHEN p >= 0.5 THEN 'act' ELSE 'wait' END AS action, CASE WHEN q >= 0.5 THEN 'act' ELSE 'wait' END AS oracle, q FROM d)
    SELECT oracle, action, count(*) AS n, round(sum(abs(2 * q - 1) * (oracle <> action)::INT), 4) AS regret FROM a GROUP BY 1, 2""",
)
def stop_decisions(spark, sf_dir):
    p, q = F.col("l_discount") * 10, F.col("l_tax") * 12.5
    pick = lambda x: F.when(x >= 0.5, "act").otherwise("wait")
    a = table(spark, sf_dir, "lineitem").select(pick(p).alias("action"), pick(q).alias("oracle"), q.alias("q"))
    lost = F.when(F.col("oracle") != F.col("action"), F.abs(2 * F.col("q") - 1)).otherwise(0.0)
    return a.groupBy("oracle", "action").agg(F.count("*").alias("n"), F.round(F.sum(lost), 4).alias("regret"))


@query(
    "regime_means",
    "WITH c AS (SELECT l_returnflag AS regime, l_suppkey AS c, avg(l_discount) AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2) SELECT regime, round(avg(x), 6) AS by_case, round(sum(w * x) / sum(w), 6) AS by_context FROM c GROUP BY 1",
)
def regime_means(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("regime"), "l_suppkey").agg(F.avg("l_discount").alias("x"), F.sum("l_quantity").alias("w"))
    return c.groupBy("regime").agg(F.round(F.avg("x"), 6).alias("by_case"), F.round(F.sum(F.col("w") * F.col("x")) / F.sum("w"), 6).alias("by_context"))


@query(
    "error_parts",
    """WITH s AS (SELECT l_returnflag AS g, l_extendedprice * (0.9 - (1 - l_discount)) AS terminal, l_extendedprice * l_tax - l_extendedprice * 0.05 AS cost, l_extendedprice * (0.9 - (1 - l_discount)) + l_extendedprice * l_tax - l_extendedprice * 0.05 AS total FROM lineitem)
    SELECT g, round(avg(terminal), 3) AS terminal, round(avg(cost), 3) AS cost, round(avg(total), 3) AS total, count(*) FILTER (abs(terminal + cost - total) > 1e-6) AS unbalanced FROM s GROUP BY 1""",
)
def error_parts(spark, sf_dir):
    price = F.col("l_extendedprice")
    terminal, cost = price * (0.9 - (1 - F.col("l_discount"))), price * F.col("l_tax") - price * 0.05
    s = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), terminal.alias("terminal"), cost.alias("cost"), (terminal + price * F.col("l_tax") - price * 0.05).alias("total"))
    parts = [F.round(F.avg(x), 3).alias(x) for x in ("terminal", "cost", "total")]
    return s.groupBy("g").agg(*parts, F.count_if(F.abs(F.col("terminal") + F.col("cost") - F.col("total")) > 1e-6).alias("unbalanced"))


@query(
    "invariance_probes",
    """WITH p AS (SELECT l_orderkey AS g, max(l_discount) FILTER (l_linenumber = 1) AS base, max(l_discount) FILTER (l_linenumber = 2) AS copy, max(l_discount) FILTER (l_linenumber = 3) AS price FROM lineitem GROUP BY 1)
    SELECT count(*) AS groups, round(avg(abs(copy - base)), 6) AS copy_drift, round(avg(abs(price - base)), 6) AS price_drift, round(avg((price > base)::INT), 6) AS wrong_direction FROM p WHERE base IS NOT NULL AND copy IS NOT NULL AND price IS NOT NULL""",
)
def invariance_probes(spark, sf_dir):
    at = lambda i, name: F.max(F.when(F.col("l_linenumber") == i, F.col("l_discount"))).alias(name)
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(at(1, "base"), at(2, "copy"), at(3, "price")).dropna()
    drift = lambda x: F.round(F.avg(F.abs(F.col(x) - F.col("base"))), 6).alias(f"{x}_drift")
    return p.agg(F.count("*").alias("groups"), drift("copy"), drift("price"), F.round(F.avg((F.col("price") > F.col("base")).cast("int")), 6).alias("wrong_direction"))


@query(
    "threshold_recovery",
    "SELECT vec_id, round(list_avg(list_transform([0.1, 0.3, 0.5, 0.7, 0.9], lambda t: 1 / (1 + exp(-8 * (1 / (1 + exp(-embedding[1]::DOUBLE)) - t))))), 6) AS recovered FROM embeddings",
)
def threshold_recovery(spark, sf_dir):
    level = 1 / (1 + F.exp(-F.get("embedding", F.lit(0)).cast("double")))  # the model's first output
    rows = table(spark, sf_dir, "embeddings").select("vec_id", level.alias("x"), F.explode(F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7, 0.9)))).alias("t"))
    return rows.groupBy("vec_id").agg(F.round(F.avg(1 / (1 + F.exp(-8 * (F.col("x") - F.col("t"))))), 6).alias("recovered"))


@query(
    "sensor_posteriors",
    """WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.3 END AS prior, value > 50 AS a, event_type = 'click' AS b FROM events), l AS (SELECT event_id, prior * (CASE WHEN a THEN 0.8 ELSE 0.2 END) * (CASE WHEN b THEN 0.8 ELSE 0.2 END) AS y, (1 - prior) * (CASE WHEN a THEN 0.1 ELSE 0.9 END) * (CASE WHEN b THEN 0.1 ELSE 0.9 END) AS n FROM s)
    SELECT event_id, CASE WHEN y + n > 0 THEN round(y / (y + n), 6) END AS p FROM l""",
)
def sensor_posteriors(spark, sf_dir):
    prior = F.when(F.col("event_type") == "error", 1.0).otherwise(0.3)
    reports = F.array(F.coalesce(F.col("value") > 50, F.lit(False)), F.col("event_type") == "click")
    return table(spark, sf_dir, "events").select("event_id", F.round(R.two_sensor_posterior(prior, F.lit(0.8), F.lit(0.1), reports), 6).alias("p"))


@query("diversity_counts", "SELECT l_returnflag AS family, count(DISTINCT l_suppkey) AS roots, count(DISTINCT (l_suppkey, l_linenumber)) AS contexts, count(DISTINCT (l_suppkey, l_linenumber, l_linestatus)) AS goals FROM lineitem GROUP BY 1")
def diversity_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_linenumber", "l_linestatus").distinct()
    return lines.groupBy(F.col("l_returnflag").alias("family")).agg(
        F.count_distinct("l_suppkey").alias("roots"), F.count_distinct("l_suppkey", "l_linenumber").alias("contexts"), F.count("*").alias("goals")
    )


@query(
    "presentation_pairs",
    """WITH a AS (SELECT l_orderkey AS k, l_discount AS x FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_orderkey AS k, 0.1 - l_discount AS x FROM lineitem WHERE l_linenumber = 2)
    SELECT count(*) AS pairs, round(avg(abs(a.x - (0.1 - b.x))), 6) AS drift, count(*) FILTER ((a.x > 0.05) <> (0.1 - b.x > 0.05)) AS flips FROM a JOIN b USING (k)""",
)
def presentation_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    side = lambda i, x, name: lines.where(F.col("l_linenumber") == i).select("l_orderkey", x.alias(name))
    both = side(1, F.col("l_discount"), "x").join(side(2, 0.1 - F.col("l_discount"), "y"), "l_orderkey").withColumn("z", 0.1 - F.col("y"))
    flips = F.count_if((F.col("x") > 0.05) != (F.col("z") > 0.05))
    return both.agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs(F.col("x") - F.col("z"))), 6).alias("drift"), flips.alias("flips"))


@query(
    "conversation_audit",
    """WITH t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), c AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS replies, count(*) FILTER (role = before) AS repeated,
      count(*) FILTER (trim(text) = '') AS blank, count(*) FILTER (regexp_matches(text, '[0-9]')) AS numeric, max(length(text)) AS longest FROM t GROUP BY 1)
    SELECT count(*) AS conversations, sum(turns)::BIGINT AS turns, sum(users)::BIGINT AS users, sum(replies)::BIGINT AS replies, sum(repeated)::BIGINT AS repeated, sum(blank)::BIGINT AS blank, sum(numeric)::BIGINT AS numeric, count(*) FILTER (users <> replies) AS unanswered, max(longest) AS longest FROM c""",
)
def conversation_audit(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, sf_dir, "conversations").withColumn("before", before)
    c = t.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("replies"),
        F.count_if(F.col("role") == F.col("before")).alias("repeated"), F.count_if(F.trim("text") == "").alias("blank"), F.count_if(F.col("text").rlike("[0-9]")).alias("numeric"), F.max(F.char_length("text")).alias("longest"),
    )
    sums = [F.sum(x).alias(x) for x in ("turns", "users", "replies", "repeated", "blank", "numeric")]
    return c.agg(F.count("*").alias("conversations"), *sums, F.count_if(F.col("users") != F.col("replies")).alias("unanswered"), F.max("longest").cast("long").alias("longest"))
