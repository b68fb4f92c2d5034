"""Schedules, seeded selections, call queues, solved graphs and bootstraps over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import rules as R
from millrace.operators import schedules as S
from millrace.plans.registry import query
from millrace.plans.rule_queries import _EDGES
from millrace.sources.tables import table


@query(
    "queued_responses",
    """WITH e AS (SELECT user_id, event_id % 4 AS name, ts, event_id, event_type = 'click' AS c FROM events WHERE event_type IN ('click', 'view')),
    n AS (SELECT *, sum(c::INT) OVER w AS calls, sum((NOT c)::INT) OVER w AS replies FROM e WINDOW w AS (PARTITION BY user_id, name ORDER BY ts, event_id)),
    l AS (SELECT *, greatest(0, max(replies - calls) OVER (PARTITION BY user_id, name ORDER BY ts, event_id)) AS lost FROM n),
    m AS (SELECT *, lost = coalesce(lag(lost) OVER (PARTITION BY user_id, name ORDER BY ts, event_id), 0) AS fits FROM l),
    r AS (SELECT user_id, name, replies - lost AS number, event_id AS answer FROM m WHERE NOT c AND fits)
    SELECT m.event_id, answer FROM m LEFT JOIN r ON m.user_id = r.user_id AND m.name = r.name AND m.calls = r.number WHERE c""",
)
def queued_responses(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 4).alias("name"), "ts", "event_id", "event_type")
    rows = S.queue_pairs(events, ["user_id", "name"], ["ts", "event_id"], "event_type", "click", "view")
    answers = rows.where("matched and event_type = 'view'").select("user_id", "name", "number", F.col("event_id").alias("answer"))
    return rows.where("event_type = 'click'").join(answers, ["user_id", "name", "number"], "left").select("event_id", "answer")


@query("capped_selection")
def capped_selection(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    # what every row carries is short: digests as bytes, which sort as their hex does, and groups of a letter and a key
    rows = orders.select("id", F.struct(F.unhex(S.seeded("select", "id")).alias("h"), "id").alias("rank"))
    by_request = orders.select("id", F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("group"))
    by_server = lines.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("group"))
    cap = F.when(F.col("group").startswith("r"), 1).otherwise(8)  # a request has one place
    return S.capped_greedy(rows, by_request.unionByName(by_server), cap)


@query(
    "family_schedule",
    """WITH v AS (SELECT p_partkey, p_brand, visit FROM part, range(1, 3) t(visit)),
    t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY visit, sha256('plan:' || visit || ':' || p_partkey)) AS round FROM v),
    s AS (SELECT *, row_number() OVER (ORDER BY round, sha256('plan:' || round || ':' || p_brand)) AS place FROM t)
    SELECT p_partkey, p_brand, visit, round, place, (place - 1) // 8 AS step FROM s WHERE place <= 512""",
)
def family_schedule(spark, sf_dir):
    rows = S.round_robin(table(spark, sf_dir, "part"), "p_partkey", "p_brand", "plan", 512, visits=2)
    return rows.withColumn("step", F.floor((F.col("place") - 1) / 8))


@query(
    "seed_receipts",
    """SELECT o_orderkey, o_orderpriority, round(1 / (count(*) OVER w - row_number() OVER o + 1), 9) AS probability FROM orders
    WINDOW w AS (PARTITION BY o_orderpriority), o AS (PARTITION BY o_orderpriority ORDER BY sha256('first:' || o_orderkey)) QUALIFY row_number() OVER o <= 2""",
)
def seed_receipts(spark, sf_dir):
    own = Window.partitionBy("o_orderpriority")
    keyed = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", S.seeded("first", "o_orderkey").alias("h"))
    sizes = keyed.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    first = keyed.withColumn("k", F.row_number().over(own.orderBy("h"))).where("k <= 2")
    return first.join(sizes, "o_orderpriority").select("o_orderkey", "o_orderpriority", F.round(1 / (F.col("n") - F.col("k") + 1), 9).alias("probability"))


@query(
    "coverage_receipts",
    """WITH r AS (SELECT p_partkey, p_brand || ' ' || p_size % 3 AS s, p_partkey % 11 = 0 AS old FROM part), c AS (SELECT s, count(*) FILTER (old) AS had, count(*) FILTER (NOT old) AS n FROM r GROUP BY 1),
    f AS (SELECT r.*, had, n, row_number() OVER (PARTITION BY s ORDER BY sha256('cover:' || p_partkey)) AS nth FROM r JOIN c USING (s) WHERE NOT old),
    l AS (SELECT *, had + nth AS level, row_number() OVER (PARTITION BY had + nth ORDER BY sha256('cover:' || (had + nth) || ':' || s)) AS place_in, count(*) OVER (PARTITION BY had + nth) AS strata FROM f),
    p AS (SELECT *, row_number() OVER (ORDER BY level, place_in) AS place FROM l)
    SELECT p_partkey, s, place, round(1 / ((strata - place_in + 1) * (n - nth + 1)), 9) AS probability FROM p WHERE place <= 200""",
)
def coverage_receipts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", (F.col("p_size") % 3).cast("string")).alias("s"))
    picks = S.coverage_picks(rows, "p_partkey", "s", rows.where("p_partkey % 11 = 0"), "cover", 200)
    return picks.withColumn("probability", F.round("probability", 9))


@query(
    "design_block",
    """WITH t AS (SELECT p_type AS task, CASE WHEN min(p_size) % 2 = 0 THEN 2 ELSE 4 END AS k FROM part GROUP BY 1)
    SELECT task, fee, condition, repeat, sha256('block:' || task || ':' || fee || ':' || condition || ':' || repeat) AS position FROM t, range(0, 3) f(fee), range(0, k) c(condition), range(0, 8 // k) r(repeat)""",
)
def design_block(spark, sf_dir):
    """Every type of part with each fee and condition, eight places a fee however many conditions the type has."""
    tasks = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("task")).agg(F.when(F.min("p_size") % 2 == 0, 2).otherwise(4).alias("k"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    block = tasks.withColumn("fee", upto(F.lit(3))).withColumn("condition", upto(F.col("k"))).withColumn("repeat", upto(F.expr("int(8 div k)")))
    return block.select("task", "fee", "condition", "repeat", S.seeded("block", "task", "fee", "condition", "repeat").alias("position"))


_OPEN = _EDGES.replace("FROM part", "FROM part WHERE p_partkey % 6 <= 3 AND 3 < p_partkey % 6 + p_size % 9 AND p_retailprice < 1800")


@query(
    "constrained_routes",
    _OPEN
    + ", n AS (SELECT DISTINCT x::INT AS start, unnest([a, b, x::INT]) AS node FROM d, range(1, 6) q(x)), r(start, node, cost) USING KEY (start, node) AS (SELECT start, node, CASE WHEN start = node THEN 0 ELSE 1000000 END::BIGINT FROM n "
    "UNION SELECT r.start, d.b, min(r.cost + d.cost) FROM r JOIN d ON d.a = r.node JOIN recurring.r AS k ON k.start = r.start AND k.node = d.b WHERE r.cost + d.cost < k.cost GROUP BY 1, 2) SELECT start, node, cost FROM r WHERE cost < 1000000",
)
def constrained_routes(spark, sf_dir):
    # An edge opens at p_partkey % 6 for p_size % 9 hours; it is now 3, and the dear edges need a permission not held.
    opens = F.col("p_partkey") % 6
    usable = (opens <= 3) & (F.lit(3) < opens + F.col("p_size") % 9) & (F.col("p_retailprice") < 1800)
    edges = table(spark, sf_dir, "part").where(usable).select(F.col("p_size").alias("a"), ((F.col("p_partkey") * 7) % 50 + 1).cast("int").alias("b"), (F.col("p_partkey") % 20 + 1).alias("cost"))
    return R.least_costs(edges, spark.range(1, 6).select(F.col("id").cast("int").alias("start")))


_MOVES = """WITH e AS (SELECT user_id, event_type AS action, round(value)::BIGINT % 10 AS reward, coalesce(lag(event_type) OVER w, '') AS a, coalesce(lag(event_type, 2) OVER w, '') AS b, lead(event_type) OVER w IS NULL AS terminal
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(
    "history_transitions",
    _MOVES + " SELECT b || '>' || a AS node, action, CASE WHEN terminal THEN NULL ELSE a || '>' || action END AS next, count(*) AS times, min(reward) AS least, min(reward) < max(reward) AS contradicts FROM e GROUP BY ALL",
)
def history_transitions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    back = lambda n: F.coalesce(F.lag("event_type", n).over(w), F.lit(""))
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("action"), (F.round("value").cast("long") % 10).alias("reward"), back(1).alias("a"), back(2).alias("b"), F.lead("event_type").over(w).isNull().alias("terminal")
    )
    after = F.when(~F.col("terminal"), F.concat_ws(">", "a", "action"))
    return e.groupBy(F.concat_ws(">", "b", "a").alias("node"), "action", after.alias("next")).agg(
        F.count("*").alias("times"), F.min("reward").alias("least"), (F.min("reward") < F.max("reward")).alias("contradicts")
    )


_LEVEL = """q{n} AS (SELECT x.node, x.action, sum(x.reward * {scale} + coalesce(v.u, 0))::BIGINT AS u FROM x LEFT JOIN (SELECT node, max(u) AS u FROM q{m} GROUP BY 1) v ON v.node = x.next GROUP BY 1, 2),"""
_GRAPH = (
    """WITH p AS (SELECT p_size % 25 AS node, p_partkey % 2 AS world, p_partkey // 2 % 3 AS action, min(p_partkey * 7 % 25) AS next, min(p_partkey * 13 % 21 - 10) AS reward FROM part GROUP BY 1, 2, 3),
    x AS (SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY node, action) = 2), q0 AS (SELECT -1 AS node, 0 AS action, 0 AS u),"""
    + "".join(_LEVEL.format(n=n, m=n - 1, scale=2 ** (n - 1)) for n in (1, 2, 3))
    + "a AS (SELECT 1 AS remaining, * FROM q1 UNION ALL SELECT 2, * FROM q2 UNION ALL SELECT 3, * FROM q3)"
)


def _solved(spark, sf_dir):
    keys = [(F.col("p_size") % 25).alias("node"), (F.col("p_partkey") % 2).alias("world"), F.expr("p_partkey div 2 % 3").alias("action")]
    part = table(spark, sf_dir, "part")
    edges = part.groupBy(*keys).agg(F.min(F.col("p_partkey") * 7 % 25).alias("next"), F.min(F.col("p_partkey") * 13 % 21 - 10).alias("reward"))
    return S.backward_induction(edges, 2, 3)


@query("solved_graph", _GRAPH + " SELECT remaining, node, action, u AS utility, row_number() OVER (PARTITION BY remaining, node ORDER BY u DESC, action) = 1 AS best FROM a")
def solved_graph(spark, sf_dir):
    return _solved(spark, sf_dir)


@query(
    "graph_questions",
    _GRAPH
    + """, b AS (SELECT remaining, node, arg_min(action, (-u, action)) AS choice, max(u) AS value, max(u) FILTER (action = 0) - max(u) FILTER (action > 0) AS advantage FROM a GROUP BY 1, 2)
    SELECT remaining, node, 'action' AS kind, choice::VARCHAR AS answer FROM b UNION ALL SELECT remaining, node, 'advantage', CASE WHEN advantage > 0 THEN 'yes' ELSE 'no' END FROM b WHERE advantage IS NOT NULL UNION ALL SELECT remaining, node, 'value', value::VARCHAR FROM b""",
)
def graph_questions(spark, sf_dir):
    q = _solved(spark, sf_dir).groupBy("remaining", "node").agg(
        F.max(F.when(F.col("best"), F.col("action"))).alias("choice"), F.max("utility").alias("value"), (F.max(F.when(F.col("action") == 0, F.col("utility"))) - F.max(F.when(F.col("action") > 0, F.col("utility")))).alias("advantage")
    )
    ask = lambda kind, answer: F.struct(F.lit(kind).alias("kind"), answer.cast("string").alias("answer"))
    three = F.array(ask("action", F.col("choice")), ask("advantage", F.when(F.col("advantage") > 0, "yes").when(F.col("advantage") <= 0, "no")), ask("value", F.col("value")))
    return q.select("remaining", "node", F.explode(three).alias("q")).select("remaining", "node", "q.*").where("answer IS NOT NULL")


@query(
    "smoothed_transitions",
    """WITH r AS (SELECT p_size > 10 AS c0, p_retailprice > 950 AS c1, (p_partkey % 3 = 0)::INT AS y FROM part), m AS (SELECT mask, (mask % 2 = 0 OR c0) AND (mask < 2 OR c1) AS pass, c0, c1, y FROM r, range(0, 4) t(mask))
    SELECT mask, round((1 + sum(y)) / (2 + count(*)), 6) AS forecast, round((1 + count(*) FILTER (c0)) / (2 + count(*)), 6) AS first_check, round((1 + count(*) FILTER (c1)) / (2 + count(*)), 6) AS second_check FROM m WHERE pass GROUP BY 1""",
)
def smoothed_transitions(spark, sf_dir):
    r = table(spark, sf_dir, "part").select((F.col("p_size") > 10).alias("c0"), (F.col("p_retailprice") > 950).alias("c1"), (F.col("p_partkey") % 3 == 0).cast("int").alias("y"))
    cells = r.groupBy("c0", "c1").agg(F.count("*").alias("n"), F.sum("y").alias("y"))  # four rows
    seen = cells.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("(mask % 2 = 0 OR c0) AND (mask < 2 OR c1)")
    share = lambda hit: F.round((1 + F.coalesce(F.sum(hit), F.lit(0))) / (2 + F.sum("n")), 6)
    return seen.groupBy(F.col("mask").cast("long").alias("mask")).agg(
        share(F.col("y")).alias("forecast"), share(F.when(F.col("c0"), F.col("n"))).alias("first_check"), share(F.when(F.col("c1"), F.col("n"))).alias("second_check")
    )


def _bootstrap_sql(rows: str, seed: str) -> str:
    """The interval of (f, g, t, v) rows: stratum, group, task, value."""
    return f"""WITH v AS ({rows}), s AS (SELECT f, g, t, sum(v) AS s, count(v) AS n FROM v GROUP BY 1, 2, 3), g AS (SELECT f, g, row_number() OVER (PARTITION BY f ORDER BY g) - 1 AS k, count(*) OVER (PARTITION BY f) AS size FROM (SELECT DISTINCT f, g FROM s)),
    d AS (SELECT f, r, ('0x' || substr(sha256('{seed}:' || r || ':' || f || ':' || k), 1, 8))::UBIGINT % size AS k FROM g, range(0, 100) q(r)),
    e AS (SELECT r, t, sum(s) / sum(n) AS m FROM d JOIN g USING (f, k) JOIN s USING (f, g) GROUP BY 1, 2), m AS (SELECT r, avg(m) AS m, count(m) AS tasks FROM e GROUP BY 1),
    p AS (SELECT avg(m) AS difference, count(m) AS tasks FROM (SELECT t, sum(s) / sum(n) AS m FROM s GROUP BY 1))
    SELECT round(any_value(difference), 6) AS difference, round(quantile_cont(m.m, 0.025), 6) AS lower_95, round(quantile_cont(m.m, 0.975), 6) AS upper_95, (SELECT count(*) FROM g) AS groups, count(*) AS drawn FROM m JOIN p USING (tasks)"""


def _interval(rows, seed):
    out = S.macro_bootstrap(rows, "f", "g", "t", "v", 100, seed)
    return out.withColumns({c: F.round(c, 6) for c in ("difference", "lower_95", "upper_95")})


_CORRECT = "CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END"


def _orders(spark, sf_dir, stratum, task):
    correct = F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "orders").select(stratum.alias("f"), F.col("o_custkey").alias("g"), task.alias("t"), correct.alias("v"))


@query("family_intervals", _bootstrap_sql(f"SELECT o_custkey % 3 AS f, o_custkey AS g, o_orderpriority AS t, {_CORRECT} AS v FROM orders", "family"))
def family_intervals(spark, sf_dir):
    return _interval(_orders(spark, sf_dir, F.col("o_custkey") % 3, F.col("o_orderpriority")), "family")


_RARE = "CASE WHEN o_orderkey % 401 = 5 THEN 'rare' ELSE o_orderstatus END"


@query("complete_task_intervals", _bootstrap_sql(f"SELECT 'all' AS f, o_custkey AS g, {_RARE} AS t, {_CORRECT} AS v FROM orders", "complete"))
def complete_task_intervals(spark, sf_dir):
    return _interval(_orders(spark, sf_dir, F.lit("all"), F.when(F.col("o_orderkey") % 401 == 5, "rare").otherwise(F.col("o_orderstatus"))), "complete")


@query("equal_group_intervals", _bootstrap_sql("SELECT 'all' AS f, l_suppkey AS g, 'all' AS t, avg(l_discount - l_tax) AS v FROM lineitem GROUP BY 2", "equal"))
def equal_group_intervals(spark, sf_dir):
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("v"))
    return _interval(means.select(F.lit("all").alias("f"), "g", F.lit("all").alias("t"), "v"), "equal")


@query("environment_intervals", _bootstrap_sql("SELECT event_type AS f, user_id AS g, event_type AS t, avg(value) AS v FROM events GROUP BY 1, 2", "roots"))
def environment_intervals(spark, sf_dir):
    roots = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("f"), F.col("user_id").alias("g")).agg(F.avg("value").alias("v"))
    return _interval(roots.withColumn("t", F.col("f")), "roots")
