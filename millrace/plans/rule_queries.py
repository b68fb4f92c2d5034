"""Rule families over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import rules as R
from millrace.plans.registry import query
from millrace.sources.tables import table

_TRUTH = "CASE WHEN p AND n THEN 'Both supported and contradicted' WHEN p THEN 'Supported' WHEN n THEN 'Contradicted' ELSE 'Unknown' END"


@query("nation_lookup", "SELECT c_custkey, coalesce(n_name, 'Unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON n_nationkey = c_nationkey")
def nation_lookup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").withColumnRenamed("n_nationkey", "c_nationkey")
    return R.lookup(table(spark, sf_dir, "customer"), nations, "c_nationkey", "n_name").select("c_custkey", "n_name")


_ACCESS = """WITH pol AS (SELECT p_size AS role, p_brand AS resource, CASE WHEN p_partkey % 11 = 0 THEN 'deny' ELSE 'allow' END AS effect FROM part),
 rol AS (SELECT c_custkey AS u, (c_custkey % 50 + 1)::INT AS role FROM customer UNION ALL SELECT c_custkey, (c_custkey % 7 + 1)::INT FROM customer)"""


@query("access_control", _ACCESS + " SELECT u AS user, resource FROM rol JOIN pol USING (role) GROUP BY 1, 2 HAVING bool_or(effect = 'allow') AND NOT bool_or(effect = 'deny')")
def access_control(spark, sf_dir):
    policies = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("role"), F.col("p_brand").alias("resource"), F.when(F.col("p_partkey") % 11 == 0, "deny").otherwise("allow").alias("effect")
    )
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"))
    roles = users.withColumn("role", F.explode(F.array((F.col("user") % 50 + 1).cast("int"), (F.col("user") % 7 + 1).cast("int"))))
    return R.permitted(policies, roles)


@query(
    "free_intervals",
    """WITH c AS (SELECT o_custkey AS k, epoch(o_orderdate)::BIGINT // 86400 AS a, epoch(o_orderdate)::BIGINT // 86400 + 20 AS b FROM orders WHERE o_orderkey % 2 = 0),
    t AS (SELECT o_custkey AS k, epoch(o_orderdate)::BIGINT // 86400 AS a, epoch(o_orderdate)::BIGINT // 86400 + 30 AS b FROM orders WHERE o_orderkey % 2 = 1)
    SELECT k AS key, a AS start, b AS stop FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k = c.k AND c.a < t.b AND c.b > t.a)""",
)
def free_intervals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"))
    wanted = orders.where("o_orderkey % 2 = 0").select("key", F.col("day").alias("start"), (F.col("day") + 20).alias("stop"))
    booked = orders.where("o_orderkey % 2 = 1").select("key", F.col("day").alias("begin"), (F.col("day") + 30).alias("finish"))
    return R.free_candidates(wanted, booked, 30)


@query(
    "latest_evidence",
    f"""WITH e AS (SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS h, value FROM events), m AS (SELECT max(h) AS now FROM e),
    r AS (SELECT e.* FROM e, m WHERE now - h BETWEEN 0 AND 86400 * 3), l AS (SELECT user_id, max(h) AS h FROM r GROUP BY 1),
    s AS (SELECT user_id, bool_or(value >= 50) AS p, bool_or(value < 50) AS n FROM r JOIN l USING (user_id, h) GROUP BY 1)
    SELECT user_id, {_TRUTH} AS state FROM (SELECT DISTINCT user_id FROM e) LEFT JOIN s USING (user_id)""",
)
def latest_evidence(spark, sf_dir):
    hours = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    events = table(spark, sf_dir, "events").select("user_id", hours.alias("h"), "value")
    now = events.agg(F.max("h").alias("now"))
    return R.latest_state(events.join(F.broadcast(now)), "user_id", "h", "value", F.col("now"), 86400 * 3, 50.0)  # one row


@query(
    "claim_states",
    f"""WITH o AS (SELECT l_partkey AS claim, l_returnflag = 'R' AS holds FROM lineitem WHERE l_suppkey % 3 = 0 AND l_returnflag <> 'N'),
    s AS (SELECT claim, bool_or(holds) AS p, bool_or(NOT holds) AS n FROM o GROUP BY 1)
    SELECT p_partkey AS claim, {_TRUTH} AS state FROM part LEFT JOIN s ON claim = p_partkey""",
)
def claim_states(spark, sf_dir):
    trusted = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").join(trusted, "l_suppkey", "left_semi")
    sides = seen.groupBy(F.col("l_partkey").alias("claim")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("p"), F.bool_or(F.col("l_returnflag") != "R").alias("n"))
    claims = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim"))
    return claims.join(sides, "claim", "left").select("claim", R.truth(F.col("p"), F.col("n")).alias("state"))


@query(
    "best_parts",
    """WITH p AS (SELECT p_brand, p_name, p_size * 2 - (p_partkey % 7) AS u, p_retailprice <= 950 AS ok FROM part),
    m AS (SELECT p_brand, max(u) AS u FROM p WHERE ok GROUP BY 1), t AS (SELECT p.p_brand, p_name FROM p JOIN m USING (p_brand, u) WHERE ok)
    SELECT p_brand, coalesce(p_name, 'NONE') AS p_name FROM (SELECT DISTINCT p_brand FROM p) LEFT JOIN t USING (p_brand)""",
)
def best_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("u", F.col("p_size") * 2 - F.col("p_partkey") % 7)
    return R.best_of(parts, "p_brand", "p_name", "u", F.col("p_retailprice") <= 950)


@query(
    "incident_levels",
    "SELECT event_id, CASE WHEN event_type = 'error' AND value > 90 THEN 'critical' WHEN value >= 75 OR event_type = 'error' THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS level FROM events",
)
def incident_levels(spark, sf_dir):
    error, value = F.col("event_type") == "error", F.col("value")
    level = F.when(error & (value > 90), "critical").when((value >= 75) | error, "high").when(value >= 25, "medium").otherwise("low")
    return table(spark, sf_dir, "events").select("event_id", level.alias("level"))


@query(
    "list_memberships",
    "WITH l AS (SELECT l_returnflag AS name, l_partkey AS item FROM lineitem WHERE l_quantity > 45) SELECT item, count(DISTINCT name) AS lists FROM l GROUP BY 1",
)
def list_memberships(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_returnflag").alias("name"), F.col("l_partkey").alias("item"))
    return R.membership_counts(lists, "item", "name")


_EDGES = "WITH RECURSIVE d AS (SELECT p_size AS a, ((p_partkey * 7) % 50 + 1)::INT AS b, min(p_partkey % 20 + 1)::BIGINT AS cost FROM part GROUP BY 1, 2)"
_STARTS = "SELECT x::INT AS start, x::INT AS node"


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("a"), ((F.col("p_partkey") * 7) % 50 + 1).cast("int").alias("b"), (F.col("p_partkey") % 20 + 1).alias("cost"))


@query("reachable_nodes", _EDGES + f", r AS ({_STARTS} FROM range(1, 6) q(x) UNION SELECT r.start, d.b FROM r JOIN d ON d.a = r.node) SELECT start, node FROM r")
def reachable_nodes(spark, sf_dir):
    starts = spark.range(1, 6).select(F.col("id").cast("int").alias("start"))
    return R.reachable(_edges(spark, sf_dir), starts)


@query(
    "route_costs",
    _EDGES
    + f", n AS (SELECT DISTINCT x::INT AS start, unnest([a, b, x::INT]) AS node FROM d, range(1, 6) q(x)), r(start, node, cost) USING KEY (start, node) AS (SELECT start, node, CASE WHEN start = node THEN 0 ELSE 1000000 END::BIGINT FROM n "
    "UNION SELECT r.start, d.b, min(r.cost + d.cost) FROM r JOIN d ON d.a = r.node JOIN recurring.r AS k ON k.start = r.start AND k.node = d.b WHERE r.cost + d.cost < k.cost GROUP BY 1, 2) SELECT start, node, cost FROM r WHERE cost < 1000000",
)
def route_costs(spark, sf_dir):
    starts = spark.range(1, 6).select(F.col("id").cast("int").alias("start"))
    return R.least_costs(_edges(spark, sf_dir), starts)


@query(
    "unit_conversion_maxima",
    """WITH u(unit, num, den) AS (VALUES (0, 1, 1), (1, 254, 100), (2, 3048, 1000)), q AS (SELECT p_brand, p_partkey, p_size * num * 1000 // den AS v FROM part JOIN u ON unit = p_partkey % 3)
    SELECT p_brand, p_partkey FROM q QUALIFY v = max(v) OVER (PARTITION BY p_brand)""",
)
def unit_maxima(spark, sf_dir):
    units = spark.createDataFrame([(0, 1, 1), (1, 254, 100), (2, 3048, 1000)], "unit int, num int, den int")
    parts = table(spark, sf_dir, "part").join(F.broadcast(units), F.col("p_partkey") % 3 == F.col("unit"))  # three rows
    value = F.expr("p_size * num * 1000 div den")  # exact in integers
    return R.best_of(parts.withColumn("v", value), "p_brand", "p_partkey", "v", F.lit(True), none=None)


@query(
    "supplier_components",
    "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey - 1000000000 AS s, l_partkey AS p FROM lineitem), d AS (SELECT s AS a, p AS b FROM e UNION ALL SELECT p, s FROM e), n AS (SELECT DISTINCT a FROM d), "
    "c(node, component) USING KEY (node) AS (SELECT a, a FROM n UNION SELECT d.b, min(c.component) FROM c JOIN d ON d.a = c.node JOIN recurring.c AS r ON r.node = d.b WHERE c.component < r.component GROUP BY d.b) "
    "SELECT node + 1000000000 AS node, component + 1000000000 AS component FROM c WHERE node < 0",
)
def supplier_components(spark, sf_dir):
    return _supplier_components(table(spark, sf_dir, "lineitem"))


def _supplier_components(lines):
    from millrace.operators.components import connected_components

    pairs = lines.select("l_suppkey", "l_partkey").distinct()
    # A bipartite graph: suppliers below zero, so that the least node of a component is a supplier.
    edges = pairs.select((F.col("l_suppkey") - 1_000_000_000).alias("a"), F.col("l_partkey").alias("b"))
    found = connected_components(edges).where("node < 0")
    return found.select((F.col("node") + 1_000_000_000).alias("node"), (F.col("component") + 1_000_000_000).alias("component"))
