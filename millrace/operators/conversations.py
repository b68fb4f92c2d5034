"""Questions made of conversations with tool calls, each source row with a reason where none can be made of it.

A conversation is one text, and its messages are judged within its row: nothing of it is shuffled or written on the way
to a verdict. Reasons are those of the first message that is at fault: what comes before it is known to be in order, so
what a message is judged by is whether a user has spoken and the last call or response, however long the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import calls as C
from millrace.functions.records import first_reason, request_key
from millrace.functions.text import let
from millrace.operators.json_schema import IN_ROW, SMALL_NODES, compiled, keeps, validate, value_trees
from millrace.runtime import cut

_EDGES = r"^\s+|\s+$"
_TURN = r"(?:^|\s)(USER|ASSISTANT|FUNCTION RESPONSE):\s*"
_QUOTED = r"""^\{"name": "([^"\\]*)", "arguments": '[^'\\]*(?:\\.[^'\\]*)*'\}$"""
_UNABLE = r"(?i)\b(can't|cannot|unable|don't have|do not have|not able|not equipped|no access)\b"


def first_tool_calls(rows: DataFrame, row: str, messages: str, question: str) -> DataFrame:
    """(row, reason, state, name, arguments): the only call of a conversation's first calling message, and its request.

    Reasons, else null: ``invalid_messages``, ``orphan_preceding_response``, ``ambiguous_call_representation``,
    ``parallel_first_calls``, ``unsupported_clarification_history`` unless one user message of text comes before it,
    ``question_history_mismatch`` unless that is the question, ``no_tool_call``. Rows are judged each for itself, without
    a shuffle: repeated ids stay, null texts are invalid, an empty table stays empty; other columns go.
    """

    def judged(all_: Column) -> Column:
        first = F.get(F.filter(all_, lambda m: m["role"].isin("tool", "function") | m["ambiguous"] | (F.size(m["calls"]) > 0)), F.lit(0))
        users = F.filter(all_, lambda m: (m["role"] == "user") & (m["at"] < first["at"]))
        return F.struct(first.alias("first"), F.size(users).alias("users"), F.get(users, F.lit(0)).alias("user"))

    read = rows.select(F.col(row), F.col(question).alias("__question"), C.message_array(F.col(messages)).alias("__messages"))
    found = read.select(row, "__question", F.col("__messages").isNull().alias("__broken"), let(F.col("__messages"), judged).alias("j"))
    reason = first_reason(
        invalid_messages=F.col("__broken"),
        no_tool_call=F.col("j.first").isNull(),
        orphan_preceding_response=F.col("j.first.role").isin("tool", "function"),
        ambiguous_call_representation=F.col("j.first.ambiguous"),
        parallel_first_calls=F.size("j.first.calls") > 1,
        unsupported_clarification_history=(F.col("j.users") != 1) | ~F.col("j.user.content_kind").eqNullSafe("string"),
        question_history_mismatch=~request_key(F.col("j.user.content")).eqNullSafe(request_key(F.col("__question"))),
    )
    kept = found.withColumn("reason", reason)
    shown = lambda c: F.when(F.col("reason").isNull(), c)
    call = F.get(F.col("j.first.calls"), F.lit(0))
    return kept.select(row, "reason", shown(F.col("j.user.content")).alias("state"), shown(call["name"]).alias("name"), shown(call["arguments"]).alias("arguments"))


def _offered(rows: DataFrame, tools: str) -> tuple[DataFrame, DataFrame]:
    """One row a tool of each distinct list (set, place, name, schema), and per list why it is not used."""
    lists = rows.select(F.coalesce(F.col(tools), F.lit("")).alias("text")).distinct().select(F.sha2("text", 256).alias("set"), "text")
    items = lists.select("set", C.json_items(C.json_value(F.col("text"))).alias("items"))
    names = F.transform("items", lambda t: F.when(C.json_kind(t, "$.name") == "string", F.try_variant_get(t, "$.name", "string")))
    fault = first_reason(
        invalid_tools=F.col("items").isNull(),
        invalid_tool_schema=F.exists(names, lambda n: n.isNull()) | F.exists("items", lambda t: ~C.json_kind(t, "$.parameters").eqNullSafe("object")),
        duplicate_tool_names=F.size(F.array_distinct(names)) < F.size(names),
    )
    judged = cut(items.withColumn("fault", fault))
    tool = judged.where("fault is null").select("set", F.posexplode("items").alias("place", "tool"))
    name = F.try_variant_get("tool", "$.name", "string")
    return tool.select("set", "place", name.alias("name"), F.to_json(F.try_variant_get("tool", "$.parameters", "variant")).alias("schema")), judged.select("set", "fault")


def later_tool_calls(rows: DataFrame, row: str, messages: str, question: str, tools: str) -> tuple[DataFrame, DataFrame]:
    """Calls made after earlier responses, of conversations whose calls are serial, answered and keep their schemas.

    Gives ``choices`` (row, at, name, preceding, history), one row a call with ``preceding`` answered calls before it, and
    ``verdicts`` (row, reason), one row a conversation; those with a reason have no choices. ``history`` is an order-bound
    digest of the answered calls before: equal for equal ones. ``tools`` is a JSON array of tools with ``parameters``.

    Reasons of the tools come first: ``invalid_tools``, ``invalid_tool_schema``, ``duplicate_tool_names``, then those of
    the first tool whose schema is not used (see ``validate``); then ``invalid_messages``; then that of the first message
    at fault: ``late_or_invalid_system_message``, ``unsupported_clarification_history``, ``question_history_mismatch``,
    ``ambiguous_call_representation``, ``nonserial_or_pre_user_call``, ``undeclared_call``, ``nonobject_arguments``,
    ``argument_schema_violation``, ``invalid_call_identity``, ``orphan_response``, ``response_identity_mismatch``,
    ``unsupported_response_content``, ``unsupported_message_role``; at last ``unanswered_final_call`` and
    ``missing_user``. Ids must be unique and not null. Empty tables give empty results; other columns go.
    """
    offered, faults = _offered(rows, tools)
    schemas = cut(offered.select("*", F.concat_ws(":", "set", "name").alias("schema_id")))
    made, size, depth = compiled(schemas, "schema_id", "schema")
    tool = schemas.join(made, "schema_id").groupBy("set").agg(
        F.min(F.when(F.col("reason").isNotNull(), F.struct("place", "reason")))["reason"].alias("unused"),
        F.sort_array(F.collect_list(F.struct("place", "name", (F.col("depth") > IN_ROW).alias("deep"), "nodes"))).alias("tools"),
    )
    lists = cut(faults.join(tool, "set", "left").select("set", F.coalesce("fault", "unused").alias("head"), *[F.col(f"tools.{c}").alias(a) for c, a in (("name", "names"), ("deep", "deep"), ("nodes", "nodes"))]))
    # Few lists of tools serve many conversations: joined by shuffles, those of one list would be one task's.
    small = F.broadcast if size <= SMALL_NODES and lists.count() <= SMALL_NODES else (lambda df: df)

    def judged(*more: str) -> DataFrame:
        read = rows.select(F.col(row).alias("row"), F.sha2(F.coalesce(F.col(tools), F.lit("")), 256).alias("set"), F.col(question).alias("question"), F.col(messages).alias("messages"))
        read = read.join(small(lists.select("set", "head", "names")), "set", "left")
        walk = F.when(F.col("head").isNull(), let(C.message_array(F.col("messages")), lambda m: _walked(m, F.col("names"), F.col("question"), bool(more))))
        read = read.select("row", "set", "head", walk.alias("w"))
        read = read.select("row", "set", F.coalesce("head", "w.reason").alias("reason"), F.coalesce("w.calls", F.array()).alias("calls"), *[F.col(f"w.{c}").alias(c) for c in more])
        # Of the tools, only what the first step needs goes to Python and back; their nodes come after.
        read = read.select("*", value_trees(F.transform("calls", lambda c: c["arguments"])).alias("trees")).join(small(lists.drop("head")), "set", "left")
        place = lambda c: F.array_position("names", c["name"]).cast("int") - 1
        kept = lambda i, k: F.get("deep", k) | F.coalesce(keeps(F.get("trees", i), F.get("nodes", k), min(depth, IN_ROW)), F.lit(False))
        violated = F.exists(F.transform("calls", lambda c, i: let(place(c), lambda k: kept(i, k))), lambda x: ~x)
        if depth > IN_ROW:
            deep = read.select("row", "set", F.explode(F.filter("calls", lambda c: F.get("deep", place(c)))).alias("c"))
            deep = deep.select(F.struct("row", "c.at").alias("key"), F.concat_ws(":", "set", "c.name").alias("schema_id"), F.col("c.arguments").alias("instance"))
            broken = validate(deep, schemas, "key", "schema_id").where("reason is not null").select("key.row", F.lit(True).alias("broken")).distinct()
            read, violated = read.join(broken, "row", "left"), F.coalesce("broken", violated)
        return read.select("row", F.when(violated, "argument_schema_violation").otherwise(F.col("reason")).alias("reason"), *more)

    # Where nothing is at fault, calls and responses alternate.
    # An inner explode would be asked beforehand whether it has rows, and the walk be done again for that.
    steps = judged("steps").where("reason is null").select("row", F.posexplode_outer("steps").alias("place", "s"))
    steps = steps.select("row", "s.*", F.expr("place div 2").alias("preceding"))
    before = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    part = F.xxhash64("preceding", "made", "said").cast("decimal(38,0)")
    steps = steps.withColumn("history", F.coalesce(F.sum(part).over(before), F.lit(0)).cast("string"))
    choices = steps.where("has_calls and preceding > 0").select("row", "at", F.col("made.name").alias("name"), "preceding", "history")
    return choices.withColumnRenamed("row", row), judged().withColumnRenamed("row", row)


_LAST = f"struct<call: boolean, modern: boolean, made: {C.CALL}>"


def _walked(messages: Column, names: Column, question: Column, with_steps: bool) -> Column:
    """(reason, calls[, steps]) of one conversation's messages, but for whether arguments keep their schemas.

    ``calls`` (at, name, arguments) has those that have no fault before them: their arguments decide first. ``steps`` has
    all calls and responses.
    """
    made_by = lambda m: F.get(m["calls"], F.lit(0))
    answers = lambda m: m["role"].isin("tool", "function")
    calling = lambda m: F.size(m["calls"]) > 0

    def step(state: Column, m: Column, again: Column) -> Column:
        made, last, asked = made_by(m), state["last"], state["asked"]
        is_user, is_answer, has_calls = m["role"] == "user", answers(m), calling(m)
        pending = F.coalesce(last["call"], F.lit(False))
        called = first_reason(
            nonserial_or_pre_user_call=~asked | (F.size(m["calls"]) != 1) | pending,
            undeclared_call=~F.coalesce(F.array_contains(names, made["name"]), F.lit(False)),
            nonobject_arguments=~C.is_object(C.json_value(made["arguments"])),
            # An id that occurs again is at fault from its second time on.
            invalid_call_identity=m["modern"] & (F.coalesce(made["call_id"], F.lit("")).eqNullSafe("") | (m["at"] == again)),
        )
        fits = F.when(last["modern"], (m["role"] == "tool") & m["response_to"].eqNullSafe(last["made"]["call_id"])).otherwise(
            (m["role"] == "function") & m["name"].eqNullSafe(last["made"]["name"])
        )
        answered = first_reason(
            orphan_response=~pending, response_identity_mismatch=~fits, unsupported_response_content=~F.coalesce(m["content_kind"].isin("string", "object", "array"), F.lit(False))
        )
        late = asked | ~m["content_kind"].eqNullSafe("string")
        requested = first_reason(unsupported_clarification_history=late, question_history_mismatch=~request_key(m["content"]).eqNullSafe(request_key(question)))
        fault = F.when(m["role"] == "system", F.when(late, "late_or_invalid_system_message")).when(is_user, requested).when(m["ambiguous"], "ambiguous_call_representation")
        fault = fault.when(has_calls, called).when(is_answer, answered).otherwise(F.lit("unsupported_message_role"))
        event = F.when(is_answer | has_calls, F.struct(has_calls.alias("call"), m["modern"].alias("modern"), made.alias("made")))
        moved = F.struct(
            (asked | F.coalesce(is_user, F.lit(False))).alias("asked"), F.coalesce(event, last).alias("last"),
            let(fault, lambda r: F.when(r.isNotNull(), F.struct(m["at"].alias("at"), r.alias("reason")))).alias("fault"),
        )
        silent = m["role"].eqNullSafe("assistant") & ~m["ambiguous"] & ~has_calls
        return F.when(state["fault"].isNotNull() | silent, state).otherwise(moved)

    def found(state: Column) -> Column:
        at, reason = state["fault"]["at"], state["fault"]["reason"]
        end = F.when(messages.isNull(), "invalid_messages").when(at.isNotNull(), reason).when(state["last"]["call"], "unanswered_final_call").when(~state["asked"], "missing_user")
        # An identity is judged after the arguments of its call.
        calls = F.filter(messages, lambda m: calling(m) & (at.isNull() | (m["at"] < at) | ((m["at"] == at) & (reason == "invalid_call_identity"))))
        calls = F.transform(calls, lambda m: F.struct(m["at"].alias("at"), made_by(m)["name"].alias("name"), made_by(m)["arguments"].alias("arguments")))
        steps = F.transform(
            F.filter(messages, lambda m: answers(m) | calling(m)),
            lambda m: F.struct(m["at"].alias("at"), calling(m).alias("has_calls"), made_by(m).alias("made"), F.when(answers(m), m["content"]).alias("said")),
        )
        return F.struct(end.alias("reason"), calls.alias("calls"), *[steps.alias("steps")] * with_steps)

    ids = F.transform(F.filter(messages, lambda m: m["modern"] & made_by(m)["call_id"].isNotNull()), lambda m: F.struct(made_by(m)["call_id"].alias("id"), m["at"].alias("at")))
    again = let(F.sort_array(ids), lambda s: F.array_min(F.transform(F.filter(s, lambda x, i: x["id"] == F.get(s, i - 1)["id"]), lambda x: x["at"])))
    start = F.struct(F.lit(False).alias("asked"), F.lit(None).cast(_LAST).alias("last"), F.lit(None).cast("struct<at: int, reason: string>").alias("fault"))
    return let(let(again, lambda first: F.aggregate(messages, start, lambda state, m: step(state, m, first))), found)


def transcript_choices(rows: DataFrame, row: str, system: str, chat: str) -> DataFrame:
    """(row, reason, choice, state, tool): what an assistant does first about a transcript's opening request.

    The system text ends in one tool's JSON; turns are marked ``USER:``, ``ASSISTANT:`` and ``FUNCTION RESPONSE:``. The
    choice is ``tool`` where the assistant's turns before any other hold ``<functioncall>`` with the offered name,
    ``clarify`` where they hold a question mark, ``respond`` where they say that something cannot be done. Reasons, else
    null: ``no_function``, ``multiple_or_trailing_function_schemas`` (anything but one JSON value), ``invalid_function``,
    ``invalid_initial_turns``, ``unsupported_call_format`` (neither JSON nor a name with arguments in single quotes),
    ``call_function_mismatch``, ``unclassified_noncall_response``. White space is ASCII's. A null text counts as empty.
    Rows are judged each for itself, without a shuffle or Python; other columns go.
    """
    trimmed = lambda c: F.regexp_replace(c, _EDGES, "")
    at = F.instr("system", "{")
    read = rows.select(F.col(row).alias("row"), F.coalesce(F.col(system), F.lit("")).alias("system"), F.coalesce(F.col(chat), F.lit("")).alias("chat"))
    read = read.select("*", at.alias("brace"), C.json_value(trimmed(F.expr("substring(system, instr(system, '{'))"))).alias("tool"))
    read = read.select("*", F.regexp_extract_all("chat", F.lit(_TURN), 1).alias("roles"), F.split("chat", _TURN, -1).alias("pieces"))
    stop = F.array_position(F.transform(F.slice("roles", F.lit(2), F.size("roles")), lambda r: r != "ASSISTANT"), True)
    said = F.slice("pieces", F.lit(3), F.when(stop > 0, (stop - 1).cast("int")).otherwise(F.size("roles")))
    text = F.concat_ws("\n", F.transform(said, trimmed))
    read = read.select("row", "brace", "tool", "roles", trimmed(F.get("pieces", F.lit(1))).alias("state"), text.alias("text"))
    call = trimmed(F.substring_index(F.regexp_replace("text", r"(?s)^.*?<functioncall>", ""), "<|endoftext|>", 1))
    read = read.select("*", F.contains("text", F.lit("<functioncall>")).alias("calls"), call.alias("call"))
    spoken = C.json_value(F.col("call"))
    quoted = F.nullif(F.regexp_extract("call", _QUOTED, 1), F.lit(""))
    named = F.when(C.json_kind(spoken, "$.name") == "string", F.try_variant_get(spoken, "$.name", "string")).when(spoken.isNull(), quoted)
    string = lambda field: C.json_kind(F.col("tool"), f"$.{field}").eqNullSafe("string")
    asks, unable = F.contains("text", F.lit("?")), F.col("text").rlike(_UNABLE)
    reason = first_reason(
        no_function=F.col("brace") == 0,
        multiple_or_trailing_function_schemas=F.col("tool").isNull(),
        invalid_function=~string("name") | ~string("description"),
        invalid_initial_turns=~F.coalesce((F.get("roles", F.lit(0)) == "USER") & (F.get("roles", F.lit(1)) == "ASSISTANT"), F.lit(False)),
        unsupported_call_format=F.col("calls") & spoken.isNull() & quoted.isNull(),
        call_function_mismatch=F.col("calls") & ~named.eqNullSafe(F.try_variant_get("tool", "$.name", "string")),
        unclassified_noncall_response=~F.col("calls") & ~asks & ~unable,
    )
    choice = F.when(F.col("calls"), "tool").when(asks, "clarify").otherwise("respond")
    kept = read.select("row", reason.alias("reason"), choice.alias("choice"), "state", F.try_variant_get("tool", "$.name", "string").alias("tool"))
    shown = [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("choice", "state", "tool")]
    return kept.select(F.col("row").alias(row), "reason", *shown)


def listed_tool_calls(rows: DataFrame, row: str, system: str, turns: str, marker: str) -> DataFrame:
    """(row, reason, state, options, target): the first call of a conversation whose system text lists its tools as JSON.

    ``turns`` is a JSON array of ``from`` and ``value``: a request, a call ``[name(key=value)]``, its result. ``options``
    has a tool's name and description each, the rest of its JSON written after the description. Reasons, else null, in
    order: ``unknown_tool_list_format``, ``invalid_tool_list``, ``fewer_than_two_candidates``, ``invalid_tool_schema``,
    ``duplicate_tool_names``, ``first_turn_not_a_tool_call``, ``not_a_single_tool_result``,
    ``target_missing_from_candidates``, ``call_result_name_mismatch``, ``unsupported_call_syntax``,
    ``not_a_single_simple_call``. Rows are judged each for itself; a null text has the reason of an empty one.
    """
    after = F.when(F.contains(F.col(system), F.lit(marker)), F.expr("substring(__s, instr(__s, __m) + length(__m))"))
    read = rows.select(F.col(row), F.col(system), F.col(system).alias("__s"), F.lit(marker).alias("__m"), C.json_value(F.col(turns)).alias("turns"))
    read = read.select(row, "turns", after.isNull().alias("unmarked"), C.json_value(C.leading_json(after)).alias("listed"))
    read = read.select("*", C.json_items(F.col("listed")).alias("tools"), C.json_items(F.col("turns")).alias("said"))
    turn = lambda i, field: F.try_variant_get(F.get("said", F.lit(i)), f"$.{field}", "string")
    read = read.select("*", *[turn(i, "from").alias(f"from{i}") for i in range(3)], *[turn(i, "value").alias(f"value{i}") for i in range(3)])
    read = read.withColumn("results", C.json_items(C.json_value(F.col("value2"))))
    names = F.transform("tools", lambda t: F.try_variant_get(t, "$.name", "string"))
    selected = F.try_variant_get(F.get("results", F.lit(0)), "$.name", "string")
    read = read.select("*", names.alias("names"), selected.alias("target"))
    read = read.withColumn("call_fault", C.call_fault(F.col("target"), F.col("value1")))
    string = lambda t, field: C.json_kind(t, f"$.{field}").eqNullSafe("string")
    reason = F.coalesce(
        first_reason(
            unknown_tool_list_format=F.col("unmarked"),
            invalid_tool_list=F.col("listed").isNull(),
            fewer_than_two_candidates=F.col("tools").isNull() | (F.size("tools") < 2),
            invalid_tool_schema=F.exists("tools", lambda t: ~string(t, "name") | ~string(t, "description")),
            duplicate_tool_names=F.size(F.array_distinct("names")) < F.size("names"),
            first_turn_not_a_tool_call=~F.coalesce((F.col("from0") == "user") & (F.col("from1") == "assistant") & (F.col("from2") == "tool"), F.lit(False)),
            not_a_single_tool_result=F.col("results").isNull() | (F.size("results") != 1),
            target_missing_from_candidates=~F.coalesce(F.array_contains("names", F.col("target")), F.lit(False)),
        ),
        "call_fault",
    )
    judged = read.withColumn("reason", reason)
    shown = lambda c: F.when(F.col("reason").isNull(), c)
    return judged.select(row, "reason", shown(F.col("value0")).alias("state"), C.tool_options(shown(F.to_json(F.col("tools")))).alias("options"), shown(F.col("target")).alias("target"))
