"""Schemas, shared codecs, components of mixed keys, aligned joins, rotations and path integrals over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import folded_words
from millrace.operators import acquisition, aligned, mixed_components, rotations, sharing
from millrace.operators.json_schema import validate
from millrace.operators.ordinals import numbered
from millrace.plans.registry import query
from millrace.sources.tables import table

#: Of the calls made of events: one schema a type of event, in both dialects.
_SCHEMAS = {
    "click": """{"type": "object", "properties": {"amount": {"type": "number", "maximum": 150}, "props": {"required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10}}}}, "required": ["amount", "props"]}""",
    "view": """{"$schema": "https://json-schema.org/draft/2020-12/schema", "properties": {"tags": {"prefixItems": [{"enum": ["a", "b"]}], "items": {"pattern": "^[a-c]$"}, "uniqueItems": true, "contains": {"const": "c"}}}, "required": ["tags"]}""",
    "purchase": """{"oneOf": [{"properties": {"amount": {"minimum": 40}}}, {"properties": {"props": {"properties": {"k": {"maximum": 50}}}}}], "not": {"properties": {"user": {"multipleOf": 7}}}}""",
    "signup": """{"if": {"properties": {"amount": {"exclusiveMaximum": 60}}}, "then": {"properties": {"user": {"minimum": 5}}}, "else": {"properties": {"tags": {"minItems": 3}}}, "additionalProperties": false, "properties": {"amount": true, "props": true, "tags": true, "user": {"type": ["integer", "null"]}}}""",
    "error": """{"type": "object", "properties": {"amount": {"$ref": "#/definitions/amount"}}}""",
}


def _calls(spark, sf_dir):
    """Events as calls with JSON arguments: an amount, the event's own properties, tags made of the number, the user."""
    tags = F.transform(F.sequence(F.lit(0), F.col("event_id") % 4), lambda i: F.substring(F.lit("abcd"), ((F.col("event_id") + i * 3) % 4 + 1).cast("int"), F.lit(1)))
    arguments = F.to_json(F.struct(F.col("value").alias("amount"), F.from_json("props", "k long").alias("props"), tags.alias("tags"), F.col("user_id").alias("user")))
    return table(spark, sf_dir, "events").select("event_id", "event_type", arguments.alias("instance"))


@query(
    "schema_violations",
    """WITH e AS (SELECT event_id, event_type AS t, value AS amount, (props->>'k')::BIGINT AS k, user_id AS u, [substr('abcd', ((event_id + i * 3) % 4 + 1)::INT, 1) FOR i IN range(0, event_id % 4 + 1)] AS tags FROM events),
    v AS (SELECT *, CASE t WHEN 'click' THEN amount <= 150 AND k >= 10
      WHEN 'view' THEN tags[1] IN ('a', 'b') AND len(list_filter(tags[2:], lambda x: x NOT IN ('a', 'b', 'c'))) = 0 AND len(list_distinct(tags)) = len(tags) AND list_contains(tags, 'c')
      WHEN 'purchase' THEN (amount >= 40) <> (k <= 50) AND u % 7 <> 0
      WHEN 'signup' THEN CASE WHEN amount < 60 THEN u >= 5 ELSE len(tags) >= 3 END END AS ok FROM e)
    SELECT event_id, CASE WHEN t = 'error' THEN 'unsupported_schema_reference' WHEN NOT ok THEN 'schema_violation' END AS reason FROM v""",
)
def schema_violations(spark, sf_dir):
    schemas = spark.createDataFrame(list(_SCHEMAS.items()), "event_type string, schema string")
    return validate(_calls(spark, sf_dir), schemas, "event_id", "event_type")


def _memberships(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    groups = F.array(F.concat(F.lit("brand "), "p_brand"), F.concat(F.lit("size "), (F.col("p_size") % 10).cast("string")))
    return part.select("p_partkey", F.explode(groups).alias("group"))


@query("overlapping_rotation")
def overlapping_rotation(spark, sf_dir):
    """A schedule of 80 places over the brands and sizes of all parts, no part more than twice."""
    return rotations.rotating_groups(_memberships(spark, sf_dir), "p_partkey", "group", "rotate", 80, visits=2)


_REPORTS = [0.1, 0.5, 0.9]
_POLICY = """c AS (SELECT p_partkey AS id, (p_partkey % 3 = 0)::INT AS y, [0.01 * (p_size % 7), 0.02, 0.01 * (p_partkey % 5)] AS costs, p_size AS s FROM part),
    w AS (SELECT id, m, [1 + (s + m + i) % 5 FOR i IN range(0, 3)] AS stop, [CASE WHEN m >> b & 1 = 1 THEN 0 ELSE (s + 3 * m + 5 * b) % 4 END FOR b IN range(0, 3)] AS buy FROM c, range(0, 8) q(m)),
    p AS (SELECT id, m, [x / (list_sum(stop) + list_sum(buy)) FOR x IN stop] AS stop, [x / (list_sum(stop) + list_sum(buy)) FOR x IN buy] AS buy FROM w)"""


@query(
    "path_integrals",
    f"""WITH RECURSIVE {_POLICY},
    r(id, m, mass, spent) AS (SELECT id, 0::BIGINT, 1.0::DOUBLE, 0.0::DOUBLE FROM c UNION ALL
      SELECT r.id, r.m | (1 << b), r.mass * p.buy[b + 1], r.spent + c.costs[b + 1] FROM r JOIN p ON p.id = r.id AND p.m = r.m JOIN c ON c.id = r.id, range(0, 3) q(b) WHERE p.buy[b + 1] > 0)
    SELECT r.id, round(sum(mass * list_sum(p.stop)), 9) AS mass, round(sum(mass * (p.stop[1] * (0.1 - y) ** 2 + p.stop[2] * (0.5 - y) ** 2 + p.stop[3] * (0.9 - y) ** 2)), 9) AS brier,
      round(sum(mass * list_sum(p.stop) * r.spent), 9) AS spent, round(sum(mass * list_sum(p.stop) * bit_count(r.m)), 9) AS purchases, round(sum(mass * list_sum(p.stop)) FILTER (r.m >= 4), 9) AS duplicate
    FROM r JOIN p ON p.id = r.id AND p.m = r.m JOIN c ON c.id = r.id GROUP BY 1""",
)
def path_integrals(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    prices = F.array(F.lit(0.01) * (F.col("p_size") % 7), F.lit(0.02), F.lit(0.01) * (F.col("p_partkey") % 5))
    cases = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 == 0).cast("int").alias("outcome"), prices.alias("costs"))
    at = part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("mask"))
    stop = F.array(*[1 + (F.col("s") + F.col("mask") + i) % 5 for i in range(3)])
    buy = F.array(*[F.when(F.shiftright("mask", b).bitwiseAND(1) == 1, 0).otherwise((F.col("s") + 3 * F.col("mask") + 5 * b) % 4) for b in range(3)])
    weighed = at.select("id", "mask", stop.alias("stop"), buy.alias("buy"))
    total = F.aggregate(F.concat("stop", "buy"), F.lit(0), lambda a, x: a + x)
    share = lambda c: F.transform(c, lambda x: x / F.col("total"))
    policies = weighed.withColumn("total", total).select("id", "mask", share("stop").alias("stop"), share("buy").alias("buy"))
    out = acquisition.integrate_paths(cases, policies, _REPORTS, 3, "id", duplicates=(2,))
    return out.select("id", *[F.round(c, 9).alias(c) for c in ("mass", "brier", "spent", "purchases", "duplicate")])


@query("adaptive_receipts")
def adaptive_receipts(spark, sf_dir):
    """A hundred parts picked by how uncertain a forecast is, with the exact probability of each pick."""
    forecast = F.col("p_size") / 51
    part = table(spark, sf_dir, "part").select("p_partkey", F.round(4 * forecast * (1 - forecast), 9).alias("score"))
    return acquisition.adaptive_picks(part, "p_partkey", "score", part.where("p_partkey % 13 = 0"), "adapt", 100)


def _bundles(spark, sf_dir):
    """A conversation as one JSON value: its turns, the texts said before each, and who spoke."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    before = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.filter("turns", lambda x: x["turn"] < t["turn"]).alias("history")))
    return turns.select("conv_id", F.to_json(F.struct("turns", before.alias("prompts"))).alias("bundle"))


@query("shared_bundles")
def shared_bundles(spark, sf_dir):
    """Each conversation's bundle with its repeated parts in a catalog, its sizes, and whether it comes back."""
    bundles = _bundles(spark, sf_dir)
    made = sharing.encode_shared(bundles.where("conv_id is not null"), "conv_id", "bundle", ("bundle",)).select("conv_id", "bundle", F.col("text").alias("shared"))
    back = sharing.decode_shared(made, "conv_id", "shared", ("bundle", "shared")).select("conv_id", "bundle", "shared", F.col("text").alias("back"))
    sized = sharing.decode_columns(back, "conv_id", "bundle", ("shared", "back")).withColumnRenamed("text", "plain")
    return sized.select("conv_id", F.length("plain").alias("before"), F.length("shared").alias("after"), F.size(F.from_json(F.get_json_object("shared", "$['$catalog']"), "array<string>")).alias("entries"), (F.col("back") == F.col("plain")).alias("same"))


@query("column_records")
def column_records(spark, sf_dir):
    """Each order's lines as JSON records, and as columns where that is shorter."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))).alias("lines"))
    made = sharing.encode_columns(lines.where("l_orderkey is not null"), "l_orderkey", "lines", ("lines",)).select("l_orderkey", "lines", F.col("text").alias("made"))
    back = sharing.decode_columns(made, "l_orderkey", "made", ("lines", "made")).select("l_orderkey", "lines", "made", F.col("text").alias("back"))
    sized = sharing.decode_columns(back, "l_orderkey", "lines", ("made", "back")).withColumnRenamed("text", "plain")
    return sized.select("l_orderkey", F.length("plain").alias("before"), F.length("made").alias("after"), (F.col("back") == F.col("plain")).alias("same"))


@query(
    "source_members",
    """WITH RECURSIVE n AS (SELECT p_partkey AS p, unnest([p_brand || p_size % 5, p_type || p_retailprice::INT % 3]) AS k FROM part), e AS (SELECT DISTINCT a.p AS a, b.p AS b FROM n a JOIN n b USING (k)),
    c(p, c) USING KEY (p) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT e.b, min(c.c) FROM c JOIN e ON e.a = c.p JOIN recurring.c AS o ON o.p = e.b WHERE c.c < o.c GROUP BY 1),
    i AS (SELECT c, p, row_number() OVER (PARTITION BY c ORDER BY p) AS k, length(p::VARCHAR) || ':' || p AS item FROM c),
    b AS (SELECT c, (k - 1) // 1024 AS block, sha256(string_agg(item, '' ORDER BY k)) AS item FROM i GROUP BY 1, 2),
    d AS (SELECT c, CASE WHEN count(*) = 1 THEN any_value(item) ELSE sha256(string_agg(item, '' ORDER BY block)) END AS item FROM b GROUP BY 1)
    SELECT p AS p_partkey, 'source-' || substr(item, 1, 24) AS component FROM c JOIN d USING (c)""",
)
def source_members(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    keys = F.array(F.concat("p_brand", (F.col("p_size") % 5).cast("string")), F.concat("p_type", (F.round("p_retailprice").cast("int") % 3).cast("string")))
    return mixed_components.source_components(part, "p_partkey", keys)


@query("document_partitions")
def document_partitions(spark, sf_dir):
    """Documents with their copies and marked passages in one split; a fifth of the sources, by hash, is reserved."""
    docs = table(spark, sf_dir, "documents")
    of = F.when(F.crc32("source") % 10 == 0, "test").when(F.crc32("source") % 10 == 1, "challenge").otherwise("train")
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Passage: "), "text", F.lit("\nQuestion: which language is it?"))).otherwise(F.col("text"))
    rows = docs.select("doc_id", F.lit("language").alias("task"), marked.alias("state"), F.col("lang").alias("target"), of.alias("partition"))
    return mixed_components.document_partitions(rows, "doc_id", "task", "state", "target", "partition", "splits")


@query(
    "positional_predictions",
    """WITH n AS (SELECT row_number() OVER () AS position, o_orderkey, o_custkey, o_totalprice FROM (FROM orders))
    SELECT o_orderkey, position, o_totalprice AS price FROM n""",
)
def positional_predictions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    values = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    return aligned.positional_join(orders, values, ["o_orderkey", "o_custkey"], ["price"]).select("o_orderkey", "position", "price")


@query(
    "exact_shares",
    """WITH r AS (SELECT o_custkey % 20 AS g, o_orderstatus AS outcome, o_orderpriority AS cost, 1 + o_orderkey % 9 AS w FROM orders), t AS (SELECT g, sum(w)::BIGINT AS n FROM r GROUP BY 1),
    s AS (SELECT g, 'outcome' AS of, outcome AS value, sum(w)::BIGINT AS w FROM r GROUP BY 1, 3 UNION ALL SELECT g, 'cost', cost, sum(w)::BIGINT FROM r GROUP BY 1, 3 UNION ALL SELECT g, 'joint', outcome || ' ' || cost, sum(w)::BIGINT FROM r GROUP BY 1, 3)
    SELECT g, of, value, w // gcd(w, n) AS numerator, n // gcd(w, n) AS denominator FROM s JOIN t USING (g)""",
)
def exact_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("g"), F.col("o_orderstatus").alias("outcome"), F.col("o_orderpriority").alias("cost"), (1 + F.col("o_orderkey") % 9).alias("w"))
    out = aligned.exact_marginals(rows, "g", "w", ["outcome", "cost"])
    return out.withColumns({c: F.col(c).cast("long") for c in ("numerator", "denominator")})


_CONTEXT = "sha256(CASE WHEN l_quantity % 2 = 0 THEN 'even' ELSE 'odd' END || ':' || l_partkey % 40 || ':' || (l_linenumber - 1) % 3)"


@query(
    "forecast_contexts",
    f"""WITH l AS (SELECT *, {_CONTEXT} AS context FROM lineitem), f AS (SELECT context, 1 AS x FROM l WHERE l_partkey % 40 <> 7 GROUP BY 1),
    j AS (SELECT l_orderkey, f.context IS NULL AS missing, l_partkey % 40 = 11 AND l_suppkey % 2 = 0 AS other FROM l LEFT JOIN f USING (context))
    SELECT l_orderkey, CASE WHEN bool_or(missing) THEN 'missing_exact_public_forecast' WHEN bool_or(other) THEN 'different_underlying_world_population' END AS reason FROM j GROUP BY 1""",
)
def forecast_contexts(spark, sf_dir):
    bucket = F.col("l_partkey") % 40
    context = F.sha2(F.concat_ws(":", F.when(F.col("l_quantity") % 2 == 0, "even").otherwise("odd"), bucket.cast("string"), ((F.col("l_linenumber") - 1) % 3).cast("string")), 256)
    lines = table(spark, sf_dir, "lineitem").withColumns({"context": context, "bucket": bucket})
    worlds = lambda other: F.array(F.lit("w1"), F.when(other, "w3").otherwise("w2"), F.lit("w1"))
    forecasts = lines.where("bucket <> 7").groupBy("context").agg(F.min((F.col("bucket") % 3).cast("double")).alias("value")).select("context", worlds(F.lit(False)).alias("worlds"), "value")
    cost = F.col("l_linenumber").cast("double")
    decisions = lines.select(F.col("l_orderkey").alias("decision_id"), F.col("l_linenumber").alias("option"), "context", worlds((F.col("bucket") == 11) & (F.col("l_suppkey") % 2 == 0)).alias("worlds"), cost.alias("cost"), ((F.col("bucket") % 3).cast("double") - cost).alias("utility"))
    judged, _ = aligned.join_on_context(decisions, forecasts)
    return judged.select(F.col("decision_id").alias("l_orderkey"), "reason")


@query("folded_keys")
def folded_keys(spark, sf_dir):
    """Documents of one text up to Unicode form, case and punctuation."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce(folded_words(F.col("text")), F.lit("")), 256).alias("key"))
    groups = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    return keyed.join(groups, "key").select("doc_id", "first", "copies")


@query("numbered_lines", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS number FROM lineitem")
def numbered_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber")
    return numbered(lines, ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "number")
