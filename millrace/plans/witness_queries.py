"""Witnesses, derived values and small scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import records as R
from millrace.functions import witness as W
from millrace.operators import dedup
from millrace.operators import ordered as O
from millrace.operators import rules
from millrace.operators import schedules as S
from millrace.operators import similarity
from millrace.plans.registry import query
from millrace.runtime import cut
from millrace.sources.tables import table


@query(
    "json_leaves",
    """WITH j AS (SELECT event_id, '{"user":{"id":' || user_id || ',"kind":"' || event_type || '"},"props":[' || props || ',null,true]}' AS j FROM events)
    SELECT event_id, fullkey AS path, CASE WHEN type = 'NULL' THEN NULL ELSE json_extract_string(atom, '$') END AS value, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind FROM j, json_tree(j) WHERE type NOT IN ('OBJECT', 'ARRAY')""",
)
def json_leaves(spark, sf_dir):
    nested = F.format_string('{"user":{"id":%d,"kind":"%s"},"props":[%s,null,true]}', "user_id", "event_type", "props")
    return W.json_leaves(table(spark, sf_dir, "events").select("event_id", nested.alias("j")), "event_id", "j")


@query(
    "documented_domains",
    """WITH d AS (SELECT p_partkey, [lower(regexp_replace(p_type, '[^A-Za-z]+', '_', 'g')), 'size', 'Bad-' || p_size] AS a FROM part), n AS (SELECT p_partkey, unnest(list_filter(a, lambda x: regexp_full_match(x, '[a-z_]+'))) AS n FROM d)
    SELECT p_partkey, unnest([n, '+' || n, '-' || n]) AS value FROM n""",
)
def documented_domains(spark, sf_dir):
    kind = F.lower(F.regexp_replace("p_type", "[^A-Za-z]+", "_"))
    text = F.concat(F.lit("Sorts the rows. Valid attributes: "), kind, F.lit(", size and Bad-"), F.col("p_size").cast("string"), F.lit(". Default: none."))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(W.documented_values(text)).alias("value"))


@query(
    "derived_times",
    """SELECT event_id, strftime(ts, '%H:%M') AS clock, strftime(ts::TIMESTAMP - to_minutes(event_id % 700), '%H:%M') AS before, strftime(ts::TIMESTAMP + to_minutes(event_id % 700), '%H:%M') AS after FROM events""",
)
def derived_times(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm").alias("clock"))
    both = W.shifted_times(F.col("clock"), F.col("event_id") % 700)
    return rows.withColumn("t", both).select("event_id", "clock", F.get("t", F.lit(0)).alias("before"), F.get("t", F.lit(1)).alias("after"))


@query(
    "derived_paths",
    """WITH r AS (SELECT p_partkey, '~/' || p_brand AS root, p_size % 2 = 0 AS z FROM part), p AS (SELECT p_partkey, z, unnest([root, root || '/a', root || '/b']) AS path FROM r)
    SELECT p_partkey, path FROM p UNION ALL SELECT p_partkey, path || '.zip' FROM p WHERE z""",
)
def derived_paths(spark, sf_dir):
    root = F.concat(F.lit("~/"), "p_brand", F.lit("//"))
    paths = W.derived_paths(root, F.array(F.lit("a"), F.lit("b")), F.col("p_size") % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(paths).alias("path"))


@query(
    "amount_witnesses",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN '$' || format('{:,}', floor(o_totalprice)::BIGINT) || '.50' END AS literal FROM orders""",
)
def amount_witnesses(spark, sf_dir):
    whole = F.floor("o_totalprice")
    said = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("fee $1.25, due $"), F.format_number(whole, 0), F.lit(".50 by Friday"))).otherwise(F.concat(F.lit("due "), F.format_number(whole, 0), F.lit(".50")))
    amount = whole.cast("decimal(20,2)") + F.lit("0.5").cast("decimal(3,2)")
    return table(spark, sf_dir, "orders").select("o_orderkey", W.amount_witness(said, amount).alias("literal"))


@query("reduced_ratios", "SELECT l_orderkey, l_linenumber, l_partkey // gcd(l_partkey, 360) AS num, 360 // gcd(l_partkey, 360) AS den FROM lineitem")
def reduced_ratios(spark, sf_dir):
    ratio = W.reduced(F.col("l_partkey"), F.lit(360))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("q")).select("l_orderkey", "l_linenumber", "q.*")


@query(
    "relative_dates",
    "SELECT o_orderkey, (o_orderdate::DATE - CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN (o_custkey % 30)::INT END)::VARCHAR AS day FROM orders",
)
def relative_dates(spark, sf_dir):
    kind = F.col("o_orderkey") % 4
    goal = F.when(kind == 0, "What came Today?").when(kind == 1, "what came yesterday").when(kind == 2, F.format_string("sales of the last %d days", F.col("o_custkey") % 30)).otherwise("all sales")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_sub(F.to_date("o_orderdate"), R.days_back(goal)).cast("string").alias("day"))


@query(
    "label_keys",
    "SELECT p_partkey, regexp_replace(lower(trim(p_type || '..')), '\\.+$', '') AS label, trim(regexp_replace(lower('  ' || p_brand || '   ' || p_type), '\\s+', ' ', 'g')) AS state FROM part",
)
def label_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", R.canonical_label(F.concat("p_type", F.lit(".. "))).alias("label"), R.state_key(F.concat(F.lit("  "), "p_brand", F.lit("  \t"), "p_type")).alias("state")
    )


@query("finite_values", "SELECT o_orderkey, CASE WHEN o_custkey % 7 > 1 THEN o_totalprice END AS value FROM orders")
def finite_values(spark, sf_dir):
    odd = F.when(F.col("o_custkey") % 7 == 0, float("nan")).when(F.col("o_custkey") % 7 == 1, float("-inf")).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.finite_or_null(odd).alias("value"))


@query(
    "canonical_boards",
    """WITH b AS (SELECT p_partkey, list_transform(range(0, 9), lambda i: (p_partkey // [1, 3, 9, 27, 81, 243, 729, 2187, 6561][i + 1]) % 3) AS b FROM part),
    f AS (SELECT p_partkey, b, unnest([[1,2,3,4,5,6,7,8,9],[3,6,9,2,5,8,1,4,7],[9,8,7,6,5,4,3,2,1],[7,4,1,8,5,2,9,6,3],[3,2,1,6,5,4,9,8,7],[9,6,3,8,5,2,7,4,1],[7,8,9,4,5,6,1,2,3],[1,4,7,2,5,8,3,6,9]]) AS f FROM b)
    SELECT p_partkey, min(array_to_string(list_transform(f, lambda i: b[i]), '')) AS board FROM f GROUP BY 1""",
)
def canonical_boards(spark, sf_dir):
    cells = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.floor(F.col("p_partkey") / F.pow(F.lit(3), i)) % 3)
    rows = table(spark, sf_dir, "part").select("p_partkey", cells.alias("b"))
    return rows.select("p_partkey", F.array_join(F.transform(R.canonical_board(F.col("b"), 3), lambda x: x.cast("string")), "").alias("board"))


@query(
    "paraphrased_questions",
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Which segment does this customer belong to?' WHEN 1 THEN 'Is ' || c_mktsegment || ' the segment of this customer?' ELSE 'Does the balance exceed zero?' END AS question FROM customer",
)
def paraphrased_questions(spark, sf_dir):
    wording = F.create_map(F.lit("choice"), F.lit("Which segment does this customer belong to?"), F.lit("check"), F.lit("Is {} the segment of this customer?"), F.lit("balance"), F.lit("Does the balance exceed zero?"))
    task = F.get(F.array(F.lit("choice"), F.lit("check"), F.lit("balance")), (F.col("c_custkey") % 3).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.replace(wording[task], F.lit("{}"), F.col("c_mktsegment")).alias("question"))


@query(
    "later_choices",
    """WITH t AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, count(*) FILTER (role = 'user') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS users FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, CASE WHEN role = 'system' AND users > 0 THEN 'late_system_turn' WHEN role = 'user' AND users > 0 THEN 'second_request' WHEN role = 'assistant' AND users = 0 THEN 'call_before_request' WHEN role = 'assistant' AND before = 'assistant' THEN 'call_before_response' END AS reason FROM t)
    SELECT conv_id, count(*) AS turns, arg_min(reason, turn) FILTER (reason IS NOT NULL) AS reason FROM r GROUP BY 1""",
)
def later_choices(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    users = F.count(F.when(F.col("role") == "user", 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), users.alias("users"))
    reason = R.first_reason(
        late_system_turn=(F.col("role") == "system") & (F.col("users") > 0),
        second_request=(F.col("role") == "user") & (F.col("users") > 0),
        call_before_request=(F.col("role") == "assistant") & (F.col("users") == 0),
        call_before_response=(F.col("role") == "assistant") & (F.col("before") == "assistant"),
    )
    failed = t.withColumn("reason", reason).groupBy("conv_id")
    return failed.agg(F.count("*").alias("turns"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("turn"))).alias("reason"))


@query(
    "task_vocabularies",
    """SELECT p_brand, count(*) AS instances, count(DISTINCT trim(p_type)) AS labels, CASE WHEN count(DISTINCT trim(p_type)) NOT BETWEEN 2 AND 36 THEN 'open_vocabulary' WHEN max(length(trim(p_type))) > 160 THEN 'long_label' END AS reason FROM part GROUP BY 1""",
)
def task_vocabularies(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.trim("p_type").alias("label"))
    sizes = rows.groupBy("p_brand").agg(F.count("*").alias("instances"), F.count_distinct("label").alias("labels"), F.max(F.length("label")).alias("longest"))
    return sizes.select("p_brand", "instances", "labels", R.first_reason(open_vocabulary=~F.col("labels").between(2, 36), long_label=F.col("longest") > 160).alias("reason"))


@query(
    "legacy_keys",
    """WITH k AS (SELECT 'documents' AS kind, sha256(coalesce(text, '')) AS key FROM documents UNION ALL SELECT 'benchmark', sha256(coalesce(text, '')) FROM benchmark UNION ALL SELECT 'conversations', sha256(coalesce(text, '')) FROM conversations),
    g AS (SELECT key, list_sort(list(DISTINCT kind)) AS kinds, count(*) AS rows FROM k GROUP BY 1) SELECT array_to_string(kinds, '+') AS kinds, count(*) AS keys, sum(rows)::BIGINT AS rows FROM g GROUP BY 1""",
)
def legacy_keys(spark, sf_dir):
    one = lambda name: table(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    keys = one("documents").unionByName(one("benchmark")).unionByName(one("conversations"))
    seen = keys.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("kind")), "+").alias("kinds"), F.count("*").alias("rows"))  # three kinds
    return seen.groupBy("kinds").agg(F.count("*").alias("keys"), F.sum("rows").alias("rows"))


@query(
    "closed_facts",
    """WITH f AS (SELECT p_partkey AS object, unnest(['brand ' || p_brand[-1:], 'size ' || p_size % 4]) AS fact FROM part), a AS (SELECT object, fact FROM f UNION SELECT object, 'kept' FROM f GROUP BY object HAVING count(*) FILTER (fact IN ('brand 1', 'size 2')) = 2),
    b AS (SELECT * FROM a UNION SELECT object, 'shown' FROM a WHERE fact = 'kept' UNION SELECT object, 'not shown' FROM a WHERE fact = 'size 3') SELECT * FROM b UNION SELECT object, 'sold' FROM b GROUP BY object HAVING count(*) FILTER (fact IN ('shown', 'brand 1')) = 2""",
)
def closed_facts(spark, sf_dir):
    facts = F.array(F.concat(F.lit("brand "), F.right("p_brand", F.lit(1))), F.concat(F.lit("size "), (F.col("p_size") % 4).cast("string")))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object"), F.explode(facts).alias("fact"))
    implied = [(1, ["brand 1", "size 2"], "kept"), (2, ["kept"], "shown"), (3, ["size 3"], "not shown"), (4, ["shown", "brand 1"], "sold")]
    return rules.closure(known, spark.createDataFrame(implied, "rule int, needs array<string>, then string"))


@query(
    "runnable_parts",
    "WITH a AS (SELECT p_partkey, [p_size % 3, 3 + p_size % 5, 8 + p_partkey % 2] AS a FROM part) SELECT p_partkey, list_has_all(a, [1, 8]) AND NOT list_has_any(a, [5, 6]) AS runnable FROM a",
)
def runnable_parts(spark, sf_dir):
    have = F.array(F.col("p_size") % 3, 3 + F.col("p_size") % 5, (8 + F.col("p_partkey") % 2).cast("int"))
    ints = lambda *x: F.array(*map(F.lit, x))
    return table(spark, sf_dir, "part").select("p_partkey", rules.runnable(have, ints(1, 8), ints(5, 6)).alias("runnable"))


@query(
    "text_digests",
    "SELECT doc_id, sha256(coalesce(text, '')) AS raw FROM documents",
)
def text_digests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return dedup.enrich(docs).select("doc_id", F.col("raw_sha256").alias("raw"))


@query(
    "discounted_advantages",
    """WITH RECURSIVE s AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS r, l_discount AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC, l_discount DESC) AS k FROM lineitem),
    a AS (SELECT l_orderkey, l_linenumber, k, v, r - v AS adv FROM s WHERE k = 1 UNION ALL SELECT s.l_orderkey, s.l_linenumber, s.k, s.v, s.r + 0.9 * a.v - s.v + 0.9 * 0.8 * a.adv FROM a JOIN s ON s.l_orderkey = a.l_orderkey AND s.k = a.k + 1)
    SELECT l_orderkey, l_linenumber, round(adv, 6) AS advantage FROM a""",
)
def discounted_advantages(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem")
    out = O.discounted_advantages(steps, "l_orderkey", "l_linenumber", "l_quantity", "l_discount", 0.9, 0.8)
    return out.withColumn("advantage", F.round("advantage", 6))


@query("first_come_documents")
def first_come_documents(spark, sf_dir):
    """Of distinct shingle sets in order of id, those not near (0.8) any accepted before: each near pair is a group of one place."""
    known, classes = similarity.shingle_classes(table(spark, sf_dir, "documents"))
    pairs = cut(similarity.similar_classes(classes, 80))
    members = pairs.select(F.explode(F.array("left_id", "right_id")).alias("id"), F.concat_ws(":", "left_id", "right_id").alias("group"))
    rows = known.where("key = rep").select(F.col("rep").alias("id"), F.col("rep").alias("rank")).distinct()  # not of the sets
    return S.capped_greedy(rows, members, 1)
