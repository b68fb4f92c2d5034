"""Keys, labels, menus, distributions, manifests and checks over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import records as R
from millrace.functions.text import let
from millrace.plans.registry import query
from millrace.sources.tables import table

_WS = r"'\s+'"


@query("request_keys", f"SELECT conv_id, turn, sha256('\"' || trim(regexp_replace(text, {_WS}, ' ', 'g')) || '\"') AS k FROM conversations")
def request_keys(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.request_key(F.col("text")).alias("k"))


@query("command_templates", r"""SELECT regexp_replace(regexp_replace(text, '''[^'']*''|\"[^\"]*\"', 'S', 'g'), '\d+(\.\d+)?', 'N', 'g') AS t, count(*) AS n FROM conversations GROUP BY 1""")
def command_templates(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(R.command_template(F.col("text")).alias("t")).agg(F.count("*").alias("n"))


@query(
    "option_menus",
    "WITH m AS (SELECT l_orderkey, list_distinct(list(l_shipmode)) AS o FROM (SELECT l_orderkey, l_partkey::VARCHAR AS l_shipmode FROM lineitem) GROUP BY 1) SELECT l_orderkey, array_to_string(list_transform(list_sort(list_transform(o, lambda x: sha256('m:' || x) || x)), lambda x: x[65:]), ',') AS menu FROM m WHERE len(o) BETWEEN 2 AND 36",
)
def option_menus(spark, sf_dir):
    menus = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("o"))
    shuffled = R.hash_ordered(F.col("o"), F.lit("m"))
    return menus.where(R.valid_menu(F.col("o"))).select("l_orderkey", F.array_join(shuffled, ",").alias("menu"))


_SOFT = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"


@query("distribution_scores", _SOFT + " SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) AS entropy, round(list_sum(list_transform(p, lambda x: abs(x - 1.0::DOUBLE / len(p)))) / 2, 6) AS from_uniform FROM p")
def distribution_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("e"))
    p = e.select("vec_id", let(F.aggregate("e", F.lit(0.0), lambda a, y: a + y), lambda total: F.transform("e", lambda x: x / total)).alias("p"))
    ok = p.where(R.valid_distribution(F.col("p"))).withColumn("uniform", F.transform("p", lambda x: F.lit(1.0) / F.size("p")))
    return ok.select("vec_id", F.round(R.entropy(F.col("p")), 6).alias("entropy"), F.round(R.total_variation(F.col("p"), F.col("uniform")), 6).alias("from_uniform"))


@query("expected_brier", "SELECT vec_id, round(p * pow(1 - f, 2) + (1 - p) * pow(f, 2), 6) AS score FROM (SELECT vec_id, 1 / (1 + exp(-embedding[1]::DOUBLE)) AS p, 1 / (1 + exp(-embedding[2]::DOUBLE)) AS f FROM embeddings)")
def expected_brier(spark, sf_dir):
    logistic = lambda i: 1 / (1 + F.exp(-F.get("embedding", F.lit(i)).cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(R.expected_brier(logistic(1), logistic(0)), 6).alias("score"))


@query("foreign_key_violations", "SELECT 'orders' AS child, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)")
def violations(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.lit("orders").alias("child"))
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.lit("lineitem").alias("child"))
    names = spark.createDataFrame([("orders",), ("lineitem",)], "child string")
    return names.join(orders.unionByName(lines).groupBy("child").agg(F.count("*").alias("c")), "child", "left").select("child", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


@query("order_totals", "SELECT o_orderkey, round(coalesce((SELECT sum(l_quantity * l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.02), 0), 2) AS total FROM orders")
def order_totals(spark, sf_dir):
    return spark.sql(
        "SELECT o_orderkey, round(coalesce((SELECT sum(l_quantity * l_extendedprice) FROM {lines} "
        "WHERE l_orderkey = o_orderkey AND l_discount > 0.02), 0), 2) AS total FROM {orders}",
        lines=table(spark, sf_dir, "lineitem"),
        orders=table(spark, sf_dir, "orders"),
    )


@query("set_operations", "WITH r AS (SELECT DISTINCT l_partkey AS i FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_partkey AS i FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 48), n AS (SELECT DISTINCT l_partkey AS i FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 30) SELECT i, 'both' AS op FROM (SELECT i FROM r INTERSECT SELECT i FROM a) UNION ALL SELECT i, 'without' FROM ((SELECT i FROM r UNION SELECT i FROM a) EXCEPT SELECT i FROM n)")
def set_operations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    pick = lambda c: lines.where(c).select(F.col("l_partkey").alias("i")).distinct()
    r, a, n = pick("l_returnflag = 'R'"), pick("l_returnflag = 'A' AND l_quantity > 48"), pick("l_returnflag = 'N' AND l_quantity > 30")
    return r.intersect(a).withColumn("op", F.lit("both")).unionByName(r.union(a).distinct().subtract(n).withColumn("op", F.lit("without")))
