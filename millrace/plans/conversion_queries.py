"""Conversion of source rows into questions, with ordered reasons for what is left out.

Nulls fail no check unless a check says so; every source row is in exactly one class, and empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import records as R
from millrace.plans.registry import query
from millrace.sources.tables import table


@query(
    "opening_calls",
    """WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role <> 'system'),
    c AS (SELECT conv_id, count(*) AS n, max(role) FILTER (pos = 1) AS r1, max(role) FILTER (pos = 2) AS r2, max(text) FILTER (pos = 1) AS request, max(text) FILTER (pos = 2) AS reply FROM t GROUP BY 1)
    SELECT conv_id, n AS turns, CASE WHEN n < 2 THEN 'no_reply' WHEN r1 <> 'user' THEN 'first_turn_not_a_request' WHEN r2 <> 'assistant' THEN 'second_turn_not_a_reply'
      WHEN trim(request) = '' THEN 'empty_request' WHEN trim(reply) = '' THEN 'empty_reply' WHEN request = reply THEN 'reply_repeats_request' END AS reason FROM c""",
)
def opening_calls(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    t = turns.withColumn("at", at)
    pick = lambda c, i: F.max(F.when(F.col("at") == i, F.col(c)))
    c = t.groupBy("conv_id").agg(F.count("*").alias("turns"), pick("role", 1).alias("r1"), pick("role", 2).alias("r2"), pick("text", 1).alias("request"), pick("text", 2).alias("reply"))
    reason = R.first_reason(
        no_reply=F.col("turns") < 2,
        first_turn_not_a_request=F.col("r1") != "user",
        second_turn_not_a_reply=F.col("r2") != "assistant",
        empty_request=F.trim("request") == "",
        empty_reply=F.trim("reply") == "",
        reply_repeats_request=F.col("request") == F.col("reply"),
    )
    return c.select("conv_id", "turns", reason.alias("reason"))


@query(
    "first_calls",
    """WITH k AS (SELECT conv_id, min(turn) AS call FROM conversations WHERE role = 'assistant' AND regexp_matches(text, '[0-9]') GROUP BY 1),
    f AS (SELECT conv_id, min_by(text, turn) AS question FROM conversations GROUP BY 1),
    u AS (SELECT c.conv_id, count(*) FILTER (role = 'user') AS users, max(text) FILTER (role = 'user') AS asked FROM conversations c JOIN k USING (conv_id) WHERE turn < call GROUP BY 1)
    SELECT f.conv_id, CASE WHEN call IS NULL THEN 'no_call' WHEN coalesce(users, 0) <> 1 THEN 'unsupported_history'
      WHEN trim(regexp_replace(asked, '\\s+', ' ', 'g')) <> trim(regexp_replace(question, '\\s+', ' ', 'g')) THEN 'question_history_mismatch' END AS reason, call
    FROM f LEFT JOIN k USING (conv_id) LEFT JOIN u USING (conv_id)""",
)
def first_calls(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    is_call = (F.col("role") == "assistant") & F.col("text").rlike("[0-9]")
    first = rows.groupBy("conv_id").agg(F.min(F.when(is_call, F.col("turn"))).alias("call"), F.min_by("text", "turn").alias("question"))
    before = rows.join(first.select("conv_id", "call"), "conv_id").where("turn < call and role = 'user'")
    users = before.groupBy("conv_id").agg(F.count("*").alias("users"), F.max("text").alias("asked"))
    reason = R.first_reason(
        no_call=F.col("call").isNull(),
        unsupported_history=F.coalesce("users", F.lit(0)) != 1,
        question_history_mismatch=R.request_key(F.col("asked")) != R.request_key(F.col("question")),
    )
    return first.join(users, "conv_id", "left").select("conv_id", reason.alias("reason"), "call")


_TASKS = """WITH t AS (SELECT c_mktsegment || '-' || c_nationkey AS name, any_value(c_mktsegment) AS license, any_value(c_nationkey) AS nation, min(c_acctbal) AS low,
      count(*) AS size, count(DISTINCT regexp_replace(lower(trim(right(c_name, 2))), '\\.+$', '')) AS labels, min(c_name) AS definition FROM customer GROUP BY 1)"""


@query(
    "task_eligibility",
    _TASKS
    + """ SELECT name, CASE WHEN name = 'BUILDING-3' THEN 'manual_quality_exclusion' WHEN n_regionkey = 4 THEN 'official_excluded_task' WHEN n_regionkey IS NULL THEN 'missing_official_split'
      WHEN nation >= 20 THEN 'not_english' WHEN license NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'license_not_allowlisted' WHEN trim(definition) = '' THEN 'missing_source'
      WHEN low < -990 THEN 'not_bounded' WHEN labels NOT BETWEEN 2 AND 36 THEN 'insufficient_distinct_labels' WHEN size < 3 THEN 'missing_instruction' WHEN nation % 7 = 6 THEN 'generative' END AS reason
    FROM t LEFT JOIN nation ON n_nationkey = nation""",
)
def task_eligibility(spark, sf_dir):
    label = R.canonical_label(F.substring("c_name", -2, 2))
    tasks = table(spark, sf_dir, "customer").groupBy(F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("name")).agg(
        F.first("c_mktsegment").alias("license"), F.first("c_nationkey").alias("nation"), F.min("c_acctbal").alias("low"),
        F.count("*").alias("size"), F.count_distinct(label).alias("labels"), F.min("c_name").alias("definition"),
    )
    split = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_regionkey")
    reason = R.first_reason(
        manual_quality_exclusion=F.col("name") == "BUILDING-3",
        official_excluded_task=F.col("n_regionkey") == 4,
        missing_official_split=F.col("n_regionkey").isNull(),
        not_english=F.col("nation") >= 20,
        license_not_allowlisted=~F.col("license").isin("BUILDING", "MACHINERY", "HOUSEHOLD"),
        missing_source=F.trim("definition") == "",
        not_bounded=F.col("low") < -990,
        insufficient_distinct_labels=~F.col("labels").between(2, 36),
        missing_instruction=F.col("size") < 3,
        generative=F.col("nation") % 7 == 6,
    )
    return tasks.join(split, "nation", "left").select("name", reason.alias("reason"))


@query(
    "instance_conversion",
    """SELECT d.doc_id, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty_input' WHEN coalesce(quality, 0) + coalesce(toxic, 0) = 0 THEN 'empty_target' END AS reason,
      CASE WHEN quality = 1 AND toxic = 1 THEN least(a, b) || ',' || greatest(a, b) WHEN quality = 1 THEN a WHEN toxic = 1 THEN b ELSE '' END AS targets
    FROM documents d LEFT JOIN labels USING (doc_id), (SELECT 'answer_' || left(sha256('good'), 16) AS a, 'answer_' || left(sha256('toxic'), 16) AS b)""",
)
def instance_conversion(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    spoken = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit(" Good.")), F.when(F.col("toxic") == 1, F.lit("Toxic"))))
    ids = F.transform(spoken, lambda x: F.concat(F.lit("answer_"), F.substring(F.sha2(R.canonical_label(x), 256), 1, 16)))
    targets = F.array_sort(F.array_distinct(ids))
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t\n\r]+", "") == ""
    reason = R.first_reason(empty_input=blank, empty_target=F.size(targets) == 0)
    return rows.select("doc_id", reason.alias("reason"), F.array_join(targets, ",").alias("targets"))


@query(
    "option_descriptions",
    """WITH l AS (SELECT DISTINCT unnest([left(c_name, 1), left(c_name, 1) || '.', c_mktsegment, right(c_name, 1)]) AS label FROM customer)
    SELECT label, CASE WHEN regexp_full_match(label, '[A-Z]\\.?') THEN 'The answer marked ' || rtrim(label, '.') || ' in the supplied state' ELSE label END AS description FROM l""",
)
def option_descriptions(spark, sf_dir):
    initial = F.substring("c_name", 1, 1)
    labels = table(spark, sf_dir, "customer").select(F.explode(F.array(initial, F.concat(initial, F.lit(".")), F.col("c_mktsegment"), F.substring("c_name", -1, 1))).alias("label"))
    return labels.distinct().select("label", R.option_description(F.col("label")).alias("description"))


@query(
    "task_slices",
    "SELECT CASE WHEN starts_with(p_type, 'STANDARD') THEN 'standard' WHEN regexp_matches(p_type, '^(SMALL|MEDIUM)') THEN 'sized' WHEN regexp_matches(p_type, '^.* BRASS') THEN 'brass' ELSE 'other' END AS slice, count(*) AS n FROM part GROUP BY 1",
)
def task_slices(spark, sf_dir):
    named = R.prefix_slice(F.col("p_type"), standard="STANDARD", sized="SMALL|MEDIUM", brass=".* BRASS")
    return table(spark, sf_dir, "part").groupBy(named.alias("slice")).agg(F.count("*").alias("n"))


@query(
    "source_aliases",
    r"""WITH k AS (SELECT p_partkey, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(p_name || ' and ' || p_brand || '/' || p_brand, '\s+and\s+|[,;/+]|\s'),
      lambda x: regexp_replace(lower(trim(x)), '[^a-z0-9]+', '_', 'g')), lambda x: regexp_matches(x, '[a-z0-9]')))) AS k FROM part) SELECT k AS source, count(*) AS tasks FROM k GROUP BY 1""",
)
def source_aliases(spark, sf_dir):
    value = F.concat("p_name", F.lit(" and "), "p_brand", F.lit("/"), "p_brand")
    keys = table(spark, sf_dir, "part").select("p_partkey", F.explode(R.source_keys(value)).alias("source"))
    return keys.groupBy("source").agg(F.count("*").alias("tasks"))


@query(
    "word_fingerprints",
    r"SELECT doc_id, sha256(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), ' ')) AS k FROM documents",
)
def word_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.word_fingerprint(F.col("text")).alias("k"))


@query(
    "canonical_digests",
    """SELECT c_custkey, sha256('{"balance":' || CAST(floor(c_acctbal) AS BIGINT) || ',"name":' || to_json(c_name) || ',"nation":' || c_nationkey || ',"segment":' || to_json(c_mktsegment || '"é') || '}') AS k FROM customer""",
)
def canonical_digests(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    whole = R.canonical_object(name=F.col("c_name"), balance=F.floor("c_acctbal").cast("long"), nation=F.col("c_nationkey"), segment=F.concat("c_mktsegment", F.lit('"é')))
    return c.select("c_custkey", F.sha2(whole, 256).alias("k"))


@query(
    "usage_guard",
    """WITH m AS (SELECT o_orderkey, o_custkey % 3 AS role, sha256(o_orderkey || ':' || o_orderstatus) AS k FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT CASE WHEN m.k IS NULL THEN 'not_in_manifest' WHEN m.k <> sha256(o.o_orderkey || ':' || CASE WHEN o.o_orderkey % 7 = 0 THEN 'X' ELSE o.o_orderstatus END) THEN 'row_changed'
      WHEN m.role <> 1 THEN 'other_role' ELSE 'allowed' END AS verdict, count(*) AS n FROM orders o LEFT JOIN m USING (o_orderkey) GROUP BY 1""",
)
def usage_guard(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    digest = lambda status: F.sha2(F.concat_ws(":", "o_orderkey", status), 256)
    manifest = orders.where("o_orderkey % 5 <> 0").select("o_orderkey", (F.col("o_custkey") % 3).alias("role"), digest(F.col("o_orderstatus")).alias("known"))
    now = F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    rows = orders.select("o_orderkey", digest(now).alias("k")).join(manifest, "o_orderkey", "left")
    verdict = R.first_reason(not_in_manifest=F.col("known").isNull(), row_changed=F.col("known") != F.col("k"), other_role=F.col("role") != 1)
    return rows.groupBy(F.coalesce(verdict, F.lit("allowed")).alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "length_limits",
    r"SELECT source, CASE WHEN len(regexp_extract_all(coalesce(text, ''), '\S+')) > 400 THEN 'over_400_words' ELSE 'kept' END AS verdict, count(*) AS n FROM documents GROUP BY 1, 2",
)
def length_limits(spark, sf_dir):
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))
    verdict = F.coalesce(R.first_reason(over_400_words=words > 400), F.lit("kept"))
    return table(spark, sf_dir, "documents").groupBy("source", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "balanced_pairs",
    """SELECT l_orderkey, CASE WHEN count(*) <> 2 THEN 'not_two_rows' WHEN count(DISTINCT l_returnflag) <> 2 THEN 'same_answer' WHEN min(l_linestatus) <> max(l_linestatus) THEN 'other_state'
      WHEN min(l_shipdate) > max(l_shipdate) - INTERVAL 20 DAY THEN 'balanced' ELSE 'far_apart' END AS verdict FROM lineitem GROUP BY 1""",
)
def balanced_pairs(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_distinct("l_returnflag").alias("answers"), F.min("l_linestatus").alias("s1"), F.max("l_linestatus").alias("s2"),
        F.min("l_shipdate").alias("d1"), F.max("l_shipdate").alias("d2"),
    )
    verdict = R.first_reason(not_two_rows=F.col("n") != 2, same_answer=F.col("answers") != 2, other_state=F.col("s1") != F.col("s2"), far_apart=F.col("d1") <= F.expr("d2 - INTERVAL 20 DAYS"))
    return g.select("l_orderkey", F.coalesce(verdict, F.lit("balanced")).alias("verdict"))


@query(
    "missing_cells",
    "SELECT b AS p_brand, s::INT AS p_size FROM (SELECT DISTINCT p_brand AS b FROM part), range(1, 51) r(s) WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_brand = b AND p_size = s AND p_partkey % 2 = 0)",
)
def missing_cells(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    expected = part.select("p_brand").distinct().select("p_brand", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("p_size"))
    return expected.join(part.where("p_partkey % 2 = 0").select("p_brand", "p_size"), ["p_brand", "p_size"], "left_anti")


@query(
    "graph_checks",
    """WITH e AS (SELECT p_size AS a, ((p_partkey * 7) % 60 + 1)::INT AS b FROM part) SELECT 'dangling' AS fault, count(*) AS n FROM e WHERE b NOT IN (SELECT a FROM e)
    UNION ALL SELECT 'loop', count(*) FROM e WHERE a = b UNION ALL SELECT 'repeated', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM e GROUP BY a, b)""",
)
def graph_checks(spark, sf_dir):
    e = table(spark, sf_dir, "part").select(F.col("p_size").alias("a"), ((F.col("p_partkey") * 7) % 60 + 1).cast("int").alias("b"))
    count = lambda df, name, n: df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("fault"), "n")
    dangling = e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
    repeated = e.groupBy("a", "b").agg(F.count("*").alias("m"))
    return count(dangling, "dangling", F.count("*")).unionByName(count(e.where("a = b"), "loop", F.count("*"))).unionByName(count(repeated, "repeated", F.sum(F.col("m") - 1)))


@query(
    "expanded_questions",
    """WITH q AS (SELECT c_custkey, c_nationkey AS good, (c_nationkey + 1 + c_custkey % 24) % 25 AS wrong FROM customer)
    SELECT c_custkey || ':choice' AS id, 'choice' AS kind, good AS asked, good::VARCHAR AS answer FROM q UNION ALL SELECT c_custkey || ':yes', 'binary', good, 'yes' FROM q UNION ALL SELECT c_custkey || ':no', 'binary', wrong, 'no' FROM q""",
)
def expanded_questions(spark, sf_dir):
    right = F.col("c_nationkey").cast("long")
    wrong = F.pmod(right + 1 + F.col("c_custkey") % 24, F.lit(25))
    make = lambda name, kind, asked, answer: F.struct(F.concat_ws(":", "c_custkey", F.lit(name)).alias("id"), F.lit(kind).alias("kind"), asked.cast("long").alias("asked"), answer.alias("answer"))
    three = F.array(make("choice", "choice", right, right.cast("string")), make("yes", "binary", right, F.lit("yes")), make("no", "binary", wrong, F.lit("no")))
    return table(spark, sf_dir, "customer").select(F.explode(three).alias("q")).select("q.*")


@query(
    "typed_answers",
    """WITH e AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: exp(x::DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
    SELECT vec_id, round(p[1], 6) AS p_yes, list_position(p, list_max(p)) - 1 AS choice, round(p[2] + 2 * p[3] + 3 * p[4] + 4 * p[5], 6) AS score FROM p""",
)
def typed_answers(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: F.exp(x.cast("double"))).alias("e"))  # five options
    p = e.select("vec_id", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))
    score = F.aggregate(F.transform("p", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    choice = F.array_position("p", F.array_max("p")) - 1
    return p.select("vec_id", F.round(F.get("p", F.lit(0)), 6).alias("p_yes"), choice.cast("long").alias("choice"), F.round(score, 6).alias("score"))


@query(
    "visible_views",
    "SELECT o_orderkey, m::INT AS mask, concat_ws(',', CASE WHEN m & 1 > 0 THEN o_orderstatus END, CASE WHEN m & 2 > 0 THEN o_orderpriority END) AS seen FROM orders, range(0, 4) r(m)",
)
def visible_views(spark, sf_dir):
    masks = table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("items"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("mask"))
    return masks.select("o_orderkey", "mask", F.array_join(R.visible(F.col("items"), F.col("mask")), ",").alias("seen"))


@query(
    "validation_scalars",
    "SELECT l_returnflag AS part, u.name, u.value FROM (SELECT l_returnflag, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) UNPIVOT (value FOR name IN (discount, tax, n)) u",
)
def validation_scalars(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"), F.count("*").cast("double").alias("n"))
    return g.unpivot(["l_returnflag"], ["discount", "tax", "n"], "name", "value").withColumnRenamed("l_returnflag", "part")
