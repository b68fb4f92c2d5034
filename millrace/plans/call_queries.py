"""Conversations with tool calls, made of orders and parts as JSON texts, and what questions come of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.calls import error_shaped
from millrace.operators import conversations
from millrace.plans.registry import query
from millrace.sources.tables import spread, table

_TOOLS = """[{"name": "price", "description": "Prices an order.", "parameters": {"type": "object", "properties": {"amount": {"type": "number", "maximum": 400000}, "status": {"enum": ["O", "F"]}}, "required": ["amount", "status"]}},
  {"name": "ship", "description": "Ships an order.", "parameters": {"$schema": "https://json-schema.org/draft/2020-12/schema", "properties": {"to": {"type": "integer", "minimum": 3}}, "required": ["to"]}}]"""


def _dialogues(spark, sf_dir):
    """Orders as conversations: a request, a call to price the order, its answer, a call to ship it, its answer.

    What remains of a key by 11 decides which of the calls' rules a conversation breaks, if any; its price, status and
    customer whether the arguments keep their schemas. Reading one takes far longer than reading its order.
    """
    case = F.col("o_orderkey") % 11
    key = F.col("o_orderkey").cast("string")
    user = F.format_string('{"role":"user","content":"Please handle  order %s"}', key)
    price = F.format_string('{"amount": %s, "status": "%s"}', F.col("o_totalprice").cast("string"), "o_orderstatus")
    modern = lambda i, name, arguments: F.format_string('{"role":"assistant","content":null,"tool_calls":[{"id":"%s","type":"function","function":{"name":"%s","arguments":%s}}]}', i, F.lit(name), arguments)
    call = modern(F.concat(F.lit("a"), key), "price", F.concat(F.lit('"'), F.regexp_replace(price, '"', r'\\"'), F.lit('"')))
    reply = F.format_string('{"role":"tool","tool_call_id":"%s","content":"done"}', F.concat(F.when(case == 1, "x").otherwise("a"), key))
    old = F.format_string('{"role":"assistant","function_call":{"name":"%s","arguments":{"to":%s}}}', F.when(case == 2, "send").otherwise("ship"), F.col("o_custkey").cast("string"))
    back = F.lit('{"role":"function","name":"ship","content":{"ok":true}}')
    both = F.lit('{"role":"assistant","function_call":{"name":"ship"},"tool_calls":[{"id":"q","function":{"name":"ship"}}]}')
    two = F.lit('{"role":"assistant","tool_calls":[{"id":"q","function":{"name":"ship"}},{"id":"r","function":{"name":"ship"}}]}')
    parts = F.concat_ws(
        ",",
        F.when(case == 3, back), F.when(case == 4, two), F.when(case == 5, both), user, F.when(case == 6, user), F.when(case != 7, call),
        F.when(~case.isin(7, 8), reply), F.when(case != 7, old), F.when(~case.isin(7, 9), back),
    )
    text = F.when(case == 10, F.concat(F.lit("["), parts)).otherwise(F.concat(F.lit("["), parts, F.lit("]")))
    question = F.concat(F.lit("Please handle order "), key)
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", text.alias("messages"), question.alias("question"), F.lit(_TOOLS).alias("tools"))


@query(
    "single_first_calls",
    """SELECT o_orderkey, CASE o_orderkey % 11 WHEN 10 THEN 'invalid_messages' WHEN 3 THEN 'orphan_preceding_response' WHEN 5 THEN 'ambiguous_call_representation' WHEN 4 THEN 'parallel_first_calls'
      WHEN 6 THEN 'unsupported_clarification_history' WHEN 7 THEN 'no_tool_call' END AS reason, CASE WHEN reason IS NULL THEN 'Please handle  order ' || o_orderkey END AS state, CASE WHEN reason IS NULL THEN 'price' END AS name,
      CASE WHEN reason IS NULL THEN o_orderstatus END AS status FROM orders""",
)
def single_first_calls(spark, sf_dir):
    found = conversations.first_tool_calls(_dialogues(spark, sf_dir), "o_orderkey", "messages", "question")
    return found.select("o_orderkey", "reason", "state", "name", F.try_variant_get(F.try_parse_json("arguments"), "$.status", "string").alias("status"))


_LATER = """WITH v AS (SELECT o_orderkey, o_orderkey % 11 AS c, o_totalprice <= 400000 AND o_orderstatus IN ('O', 'F') AS priced, o_custkey >= 3 AS shipped FROM orders),
    r AS (SELECT o_orderkey, CASE WHEN c = 10 THEN 'invalid_messages' WHEN c = 3 THEN 'orphan_response' WHEN c = 4 THEN 'nonserial_or_pre_user_call' WHEN c = 5 THEN 'ambiguous_call_representation'
      WHEN c = 6 THEN 'unsupported_clarification_history' WHEN c = 7 THEN NULL WHEN NOT priced THEN 'argument_schema_violation' WHEN c = 1 THEN 'response_identity_mismatch' WHEN c = 8 THEN 'nonserial_or_pre_user_call'
      WHEN c = 2 THEN 'undeclared_call' WHEN NOT shipped THEN 'argument_schema_violation' WHEN c = 9 THEN 'unanswered_final_call' END AS reason FROM v)"""


@query("serial_call_verdicts", _LATER + " SELECT o_orderkey, reason FROM r")
def serial_call_verdicts(spark, sf_dir):
    return conversations.later_tool_calls(_dialogues(spark, sf_dir), "o_orderkey", "messages", "question", "tools")[1]


@query("later_tool_calls", _LATER + " SELECT o_orderkey, 3::INT AS at, 'ship' AS name, 1 AS preceding FROM r WHERE reason IS NULL AND o_orderkey % 11 <> 7")
def later_tool_calls(spark, sf_dir):
    return conversations.later_tool_calls(_dialogues(spark, sf_dir), "o_orderkey", "messages", "question", "tools")[0].drop("history")


def _transcripts(spark, sf_dir):
    """Parts as transcripts with one tool; what remains of a key by 9 decides what the assistant says."""
    case = F.col("p_partkey") % 9
    system = F.concat(F.lit("You may use this function - "), F.when(case == 0, "none").otherwise(F.format_string('{"name": "find %s", "description": "Finds parts", "parameters": {"size": %s}}', "p_brand", F.col("p_size").cast("string"))), F.when(case == 1, " {}").otherwise(" "))
    said = (
        F.when(case == 2, F.format_string('<functioncall> {"name": "find %s", "arguments": \'{"size": %s}\'} <|endoftext|>', "p_brand", F.col("p_size").cast("string")))
        .when(case == 3, F.format_string('Let me look. <functioncall> {"name": "find Brand#1", "arguments": {"size": %s}} <|endoftext|>', F.col("p_size").cast("string")))
        .when(case == 4, "<functioncall> find it <|endoftext|>")
        .when(case == 5, "Which size do you need?")
        .when(case == 6, "I'm sorry, but I can't do that.")
        .otherwise(F.concat(F.lit("Please wait for "), "p_type"))
    )
    opening = F.when(case == 8, "ASSISTANT: Hello. ").otherwise("")
    chat = F.concat(opening, F.lit("USER: Find "), "p_name", F.lit("\n\n\nASSISTANT: "), said, F.lit("\n\nFUNCTION RESPONSE: {}\n\nASSISTANT: Is that all?\n"))
    return table(spark, sf_dir, "part").select("p_partkey", system.alias("system"), chat.alias("chat"))


@query(
    "transcript_choices",
    """WITH c AS (SELECT *, p_partkey % 9 AS c FROM part), r AS (SELECT *, CASE WHEN c = 0 THEN 'no_function' WHEN c = 1 THEN 'multiple_or_trailing_function_schemas' WHEN c = 8 THEN 'invalid_initial_turns'
      WHEN c = 4 THEN 'unsupported_call_format' WHEN c = 3 AND p_brand <> 'Brand#1' THEN 'call_function_mismatch' WHEN c = 7 THEN 'unclassified_noncall_response' END AS reason FROM c)
    SELECT p_partkey, reason, CASE WHEN reason IS NULL THEN CASE WHEN c IN (2, 3) THEN 'tool' WHEN c = 5 THEN 'clarify' ELSE 'respond' END END AS choice, CASE WHEN reason IS NULL THEN 'Find ' || p_name END AS state,
      CASE WHEN reason IS NULL THEN 'find ' || p_brand END AS tool FROM r""",
)
def transcript_choices(spark, sf_dir):
    return conversations.transcript_choices(_transcripts(spark, sf_dir), "p_partkey", "system", "chat")


_MARKER = "Here is a list of functions in JSON format that you can invoke:"


@query(
    "listed_tool_calls",
    """WITH c AS (SELECT *, c_custkey % 10 AS c FROM customer), r AS (SELECT *, CASE c WHEN 0 THEN 'unknown_tool_list_format' WHEN 1 THEN 'fewer_than_two_candidates' WHEN 2 THEN 'duplicate_tool_names' WHEN 3 THEN 'first_turn_not_a_tool_call'
      WHEN 4 THEN 'not_a_single_tool_result' WHEN 5 THEN 'target_missing_from_candidates' WHEN 6 THEN 'call_result_name_mismatch' WHEN 7 THEN 'not_a_single_simple_call' WHEN 8 THEN 'unsupported_call_syntax' END AS reason FROM c)
    SELECT c_custkey, reason, CASE WHEN reason IS NULL THEN 'Balance of ' || c_name END AS state, CASE WHEN reason IS NULL THEN 'get/' || c_mktsegment END AS target,
      CASE WHEN reason IS NULL THEN 'Reads it.' || chr(10) || 'Tool schema: {"nation": ' || c_nationkey || '}' END AS first_option FROM r""",
)
def listed_tool_calls(spark, sf_dir):
    case = F.col("c_custkey") % 10
    name = F.concat(F.lit("get/"), F.col("c_mktsegment"))
    tool = F.format_string('{"name": "%s", "nation": %s, "description": "Reads it."}', name, F.col("c_nationkey").cast("string"))
    other = F.when(case == 2, tool).otherwise('{"name": "put", "description": "Writes it."}')
    tools = F.concat(F.lit("["), F.concat_ws(", ", tool, F.when(case != 1, other)), F.lit("]"))
    system = F.concat(F.when(case == 0, "Functions:").otherwise(_MARKER), F.lit("\n"), tools, F.lit("\nUse them well."))
    result = F.format_string('{"name": "%s"}', F.when(case == 5, "delete").otherwise(name))
    results = F.concat(F.lit("["), F.concat_ws(",", result, F.when(case == 4, result)), F.lit("]"))
    call = F.concat(F.lit("["), F.when(case == 6, "put").otherwise(name), F.when(case == 7, "(of=max(1, 2))]").when(case == 8, "(of=]").otherwise("(of='x', n=[1, 2])]"))
    said = [F.struct(F.lit(who).alias("from"), what.alias("value")) for who, what in (("user", F.concat(F.lit("Balance of "), "c_name")), ("assistant", call), ("tool", results))]
    turns = F.to_json(F.array(*[F.struct(F.when((case == 3) & F.lit(i == 1), "user").otherwise(s["from"]).alias("from"), s["value"].alias("value")) for i, s in enumerate(said)]))
    rows = table(spark, sf_dir, "customer").select("c_custkey", system.alias("system"), turns.alias("turns"))
    found = conversations.listed_tool_calls(rows, "c_custkey", "system", "turns", _MARKER)
    return found.select("c_custkey", "reason", "state", "target", F.get("options", F.lit(0))["description"].alias("first_option"))


@query(
    "error_responses",
    """SELECT event_type, count(*) AS responses, count(*) FILTER (event_type = 'error' OR (event_type = 'click' AND value > 50) OR (event_type = 'view' AND user_id % 2 = 1)) AS errors FROM events GROUP BY 1""",
)
def error_responses(spark, sf_dir):
    kind = F.col("event_type")
    error = F.when(kind == "error", '[{"error": {"code": 1}}]').when((kind == "click") & (F.col("value") > 50), '{"a": [[{"is_error": true}]]}').when(kind == "view", F.format_string('{"error": %s}', (F.col("user_id") % 2).cast("string")))
    text = F.concat(F.lit('{"error": null, "props": '), "props", F.lit(', "result": '), F.coalesce(error, F.lit('{"isError": "no", "error": []}')), F.lit("}"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("responses"), F.sum(error_shaped(text).cast("long")).alias("errors"))
