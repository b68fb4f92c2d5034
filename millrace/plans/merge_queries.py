"""Merging, attribution, inheritance, ownership and comparison of states over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import merges as M
from millrace.operators.components import connected_components
from millrace.plans.registry import query
from millrace.sources.tables import table


@query(
    "merged_rows",
    """SELECT l_partkey AS k, min(l_linestatus) AS role, min(l_returnflag || ':' || l_linenumber) AS signature, count(*) AS members,
      min(l_linestatus) <> max(l_linestatus) OR min(l_returnflag || ':' || l_linenumber) <> max(l_returnflag || ':' || l_linenumber) AS conflict FROM lineitem WHERE l_quantity > 49 GROUP BY 1""",
)
def merged_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 49")
    rows = lines.select(F.col("l_partkey").alias("k"), F.col("l_linestatus").alias("role"), F.concat_ws(":", "l_returnflag", "l_linenumber").alias("signature"))
    return M.merge_agreeing(rows, "k", "role", "signature")


@query("crossing_groups", "SELECT l_suppkey AS g, min(l_returnflag) AS first, max(l_returnflag) AS last FROM lineitem WHERE l_discount >= 0.1 AND l_tax >= 0.08 GROUP BY 1 HAVING min(l_returnflag) <> max(l_returnflag)")
def crossing_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_discount >= 0.1 and l_tax >= 0.08").select(F.col("l_suppkey").alias("g"), "l_returnflag")
    return M.crossing_groups(rows, "g", "l_returnflag")


@query(
    "token_overlaps",
    r"""WITH k AS (SELECT doc_id, source, sha256(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), ' ')) AS k FROM documents),
    o AS (SELECT DISTINCT k FROM k WHERE doc_id % 10 = 0), n AS (SELECT * FROM k WHERE doc_id % 10 <> 0 AND k NOT IN (SELECT k FROM o))
    SELECT k, min(doc_id) AS doc_id, count(*) AS copies, coalesce(min(source) <> max(source), false) AS conflict FROM n GROUP BY 1""",
)
def token_overlaps(spark, sf_dir):
    from millrace.functions.records import word_fingerprint

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_fingerprint(F.col("text")).alias("k"))
    old = docs.where("doc_id % 10 = 0").select("k").distinct()
    new = docs.where("doc_id % 10 <> 0").join(old, "k", "left_anti")
    conflict = F.coalesce(F.min("source") != F.max("source"), F.lit(False))
    return new.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), conflict.alias("conflict"))


@query(
    "averaged_forecasts",
    """WITH p AS (SELECT p_brand AS k, p_partkey, unnest([p_size / 97.0, 1 - p_size / 97.0, p_retailprice / 9973]) AS p, unnest([0, 1, 2]) AS pos FROM part),
    a AS (SELECT k, pos, avg(p) AS p FROM p GROUP BY 1, 2), m AS (SELECT p_brand AS k, count(*) AS members FROM part GROUP BY 1)
    SELECT k, members, round(max(p) FILTER (pos = 0), 6) AS yes, round(max(p) FILTER (pos = 1), 6) AS no, round(max(p) FILTER (pos = 2), 6) AS other FROM a JOIN m USING (k) GROUP BY 1, 2""",
)
def averaged_forecasts(spark, sf_dir):
    share = F.col("p_size") / 97
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.array(share, 1 - share, F.col("p_retailprice") / 9973).alias("v"))
    v = M.average_vectors(rows, "k", "v")
    return v.select("k", "members", *[F.round(F.get("v", F.lit(i)), 6).alias(n) for i, n in enumerate(("yes", "no", "other"))])


@query(
    "attributed_tools",
    """WITH n AS (SELECT c_custkey, c_mktsegment || '-' || c_nationkey || '-' || (c_custkey % 5) AS name, c_nationkey % 3 AS schema FROM customer),
    o AS (SELECT s_suppkey AS owner, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey || '-' || (s_suppkey % 5) ELSE (s_suppkey % 5)::VARCHAR END AS alias, s_nationkey % 3 AS schema FROM supplier),
    d AS (SELECT DISTINCT name, schema FROM n)
    SELECT name, schema, min(owner) AS owner FROM d JOIN o USING (schema) WHERE name = alias OR ends_with(name, '-' || alias) GROUP BY 1, 2 HAVING count(DISTINCT owner) = 1""",
)
def attributed_tools(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    names = c.select(F.concat_ws("-", "c_mktsegment", "c_nationkey", F.col("c_custkey") % 5).alias("name"), (F.col("c_nationkey") % 3).alias("schema"))
    last = (F.col("s_suppkey") % 5).cast("string")
    alias = F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws("-", "s_nationkey", last)).otherwise(last)
    owners = s.select(F.col("s_suppkey").alias("owner"), alias.alias("alias"), (F.col("s_nationkey") % 3).alias("schema"))
    return M.attribute(names, owners, "name", "alias", "owner", "schema")


@query(
    "strictest_roles",
    """WITH RECURSIVE n AS (SELECT p_partkey AS node, p_size % 4 AS role FROM part), d AS (SELECT p_partkey AS a, (p_partkey * 3) % (SELECT count(*) FROM part) + 1 AS b FROM part WHERE p_size > 40),
    e AS (SELECT a, b FROM d UNION SELECT b, a FROM d),
    c(node, component) USING KEY (node) AS (SELECT node, node FROM n UNION SELECT e.b, min(c.component) FROM c JOIN e ON e.a = c.node JOIN recurring.c AS r ON r.node = e.b WHERE c.component < r.component GROUP BY e.b)
    SELECT node, component, role, max(role) OVER (PARTITION BY component) AS usage FROM c JOIN n USING (node)""",
)
def strictest_roles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    count = part.agg(F.count("*").alias("n"))  # one row
    edges = part.where("p_size > 40").join(F.broadcast(count)).select(F.col("p_partkey").alias("a"), (F.col("p_partkey") * 3 % F.col("n") + 1).alias("b"))
    found = connected_components(edges)
    nodes = part.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 4).alias("role")).join(found, "node", "left")
    nodes = nodes.select("node", "role", F.coalesce("component", "node").alias("component"))
    return M.strictest_role(nodes, "component", "role", F.col("role")).select("node", "component", "role", "usage")


@query(
    "inherited_partitions",
    """WITH r AS (SELECT DISTINCT o_custkey AS g, o_orderkey AS m FROM orders), o AS (SELECT o_orderkey AS m, CASE WHEN o_custkey % 4 = 0 THEN 'train' WHEN o_orderkey % 50 = 0 THEN 'test' ELSE 'train' END AS part FROM orders WHERE o_orderkey % 3 = 0),
    s AS (SELECT g, min(part) AS low, max(part) AS high FROM r LEFT JOIN o USING (m) GROUP BY 1)
    SELECT g, CASE WHEN low = high THEN low END AS part, CASE WHEN low IS NULL THEN 'new' WHEN low = high THEN 'inherited' ELSE 'mixed' END AS status FROM s""",
)
def inherited_partitions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("m"))
    part = F.when(F.col("o_custkey") % 4 == 0, "train").when(F.col("o_orderkey") % 50 == 0, "test").otherwise("train")
    old = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("m"), part.alias("part"))
    return M.inherit_partition(rows, old, "g", "m", "part")


@query(
    "prefix_quotas",
    """WITH g AS (SELECT c_nationkey AS pool, o_custkey AS g, count(*) AS size FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT pool, g, size, greatest(0, least(size, 100 - coalesce(sum(size) OVER (PARTITION BY pool ORDER BY sha256('q:' || g), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken FROM g""",
)
def prefix_quotas(spark, sf_dir):
    pools = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("pool"))
    groups = table(spark, sf_dir, "orders").join(pools, "o_custkey").groupBy("pool", F.col("o_custkey").alias("g")).agg(F.count("*").alias("size"))
    order = [F.sha2(F.concat(F.lit("q:"), F.col("g").cast("string")), 256), F.col("g")]
    return M.fill_quota(groups, "pool", order, "size", F.lit(100))


@query("pairwise_overlaps", "WITH s AS (SELECT DISTINCT l_returnflag || l_linestatus AS n, l_partkey AS k FROM lineitem) SELECT a.n AS first, b.n AS second, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.n < b.n GROUP BY 1, 2")
def pairwise_overlaps(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("n"), F.col("l_partkey").alias("k"))
    return M.pairwise_overlap(sets, "n", "k")


TASK_LINES = 500_000  # lines that a task of owned_servers sorts about


@query("owned_servers")  # a test holds it against plain rounds
def owned_servers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    # lines are dealt out once by order and once by alias, over tasks in proportion to them: what one task holds stays the same
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // TASK_LINES))
    records = lines.repartition(tasks, "l_orderkey").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    records = records.select(F.col("l_orderkey").alias("record"), F.col("o_custkey").alias("request"), F.col("l_suppkey").alias("server"))
    aliases = lines.select(F.col("l_suppkey").alias("server"), (F.col("l_partkey") * 1000 + F.col("l_suppkey") % 7).alias("alias"))
    aliases = aliases.repartition(tasks, "alias")
    supplier = table(spark, sf_dir, "supplier")
    return M.owned_servers(records, aliases, supplier.select(F.col("s_suppkey").alias("server"), (F.col("s_nationkey") % 3).alias("priority")))


@query(
    "changed_rows",
    """WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'Z' WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 19 <> 0)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
    WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""",
)
def changed_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    status = F.when(F.col("o_orderkey") % 13 == 0, "Z").when(F.col("o_orderkey") % 17 == 0, None).otherwise(F.col("o_orderstatus"))
    a, b = orders.where("o_orderkey % 11 <> 0").alias("a"), orders.where("o_orderkey % 19 <> 0").withColumn("o_orderstatus", status).alias("b")
    both = a.join(b, F.col("a.o_orderkey") == F.col("b.o_orderkey"), "full")
    same = F.col("a.o_orderstatus").eqNullSafe(F.col("b.o_orderstatus")) & F.col("a.o_totalprice").eqNullSafe(F.col("b.o_totalprice")) & F.col("a.o_orderkey").eqNullSafe(F.col("b.o_orderkey"))
    change = F.when(F.col("b.o_orderkey").isNull(), "removed").when(F.col("a.o_orderkey").isNull(), "added").otherwise("changed")
    return both.where(~same).select(F.coalesce("a.o_orderkey", "b.o_orderkey").alias("o_orderkey"), change.alias("change"))


@query(
    "state_differences",
    """WITH want AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1), got AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 10 OR l_tax = 0 GROUP BY 1)
    SELECT k, n, 'missing' AS side FROM (FROM want EXCEPT ALL FROM got) UNION ALL SELECT k, n, 'extra' FROM (FROM got EXCEPT ALL FROM want)""",
)
def state_differences(spark, sf_dir):
    fits = lambda c: F.count(F.when(F.expr(c), 1))
    both = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        fits("l_quantity > 10").alias("want"), fits("l_quantity > 10 or l_tax = 0").alias("got")
    )  # a key has one row a state, or none: the bags differ where its counts do
    sides = F.array(F.struct(F.col("want").alias("n"), F.lit("missing").alias("side")), F.struct(F.col("got").alias("n"), F.lit("extra").alias("side")))
    return both.where("want <> got").select("k", F.explode(sides).alias("s")).where("s.n > 0").select("k", "s.n", "s.side")


@query(
    "united_rows",
    "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT p_partkey, p_name, NULL, NULL FROM part",
)
def united_rows(spark, sf_dir):
    t = lambda which, **columns: table(spark, sf_dir, which).select(*[F.col(c).alias(k) for k, c in columns.items()])
    parts = [t("supplier", id="s_suppkey", name="s_name", balance="s_acctbal"), t("customer", id="c_custkey", name="c_name", balance="c_acctbal", segment="c_mktsegment"), t("part", id="p_partkey", name="p_name")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


@query(
    "joined_access",
    """WITH a AS (SELECT c_custkey AS u, c_mktsegment AS s FROM customer WHERE c_acctbal > 5000), l AS (SELECT o_custkey AS u, o_orderpriority AS s FROM orders WHERE o_totalprice > 300000), b AS (SELECT o_custkey AS u FROM orders WHERE o_orderstatus = 'P')
    SELECT u, count(DISTINCT s) AS grounds FROM (SELECT u, s FROM a UNION SELECT u, s FROM l) x WHERE u NOT IN (SELECT u FROM b) GROUP BY 1""",
)
def joined_access(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    own = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("u"), F.col("c_mktsegment").alias("s"))
    listed = orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("u"), F.col("o_orderpriority").alias("s"))
    blocked = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("u")).distinct()
    return own.unionByName(listed).join(blocked, "u", "left_anti").groupBy("u").agg(F.count_distinct("s").alias("grounds"))


@query(
    "length_batches",
    """WITH d AS (SELECT doc_id, n_chars, ('0x' || left(sha256('e:' || doc_id), 6))::BIGINT % 8 AS bucket FROM documents)
    SELECT doc_id, bucket, (row_number() OVER (PARTITION BY bucket ORDER BY n_chars, doc_id) - 1) // 16 AS batch FROM d""",
)
def length_batches(spark, sf_dir):
    from pyspark.sql import Window

    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit("e:"), F.col("doc_id").cast("string")), 256), 1, 6), 16, 10).cast("long") % 8
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", bucket.alias("bucket"))
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("n_chars", "doc_id")) - 1
    return rows.select("doc_id", "bucket", F.floor(at / 16).cast("long").alias("batch"))
