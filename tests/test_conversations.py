"""Conversations with tool calls against plain walks of their messages."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import calls as C
from millrace.operators import conversations, json_schema

TOOLS = [
    {"name": "a", "description": "A", "parameters": {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}},
    {"name": "b", "description": "B", "parameters": {}},
]


def key(text):
    return " ".join(text.split())


def message(r):
    """A message that mostly keeps the rules, at times with a fault."""
    kind = r.choice(["user", "call", "call", "call", "old", "reply", "reply", "reply", "old reply", "system", "prose", "odd"])
    name, at = r.choice("aab"), r.choice("123456")
    arguments = r.choice(['{"n": 1}', '{"n": 2}', {"n": 3}, {"n": "x"}, "[1]", "{} {}"])
    call = {"id": r.choice([at, at, at, "", 5]), "function": {"name": r.choice([name] * 9 + ["c"]), "arguments": arguments}}
    return {
        "user": {"role": "user", "content": r.choice(["Do  it"] * 6 + ["other", 4])},
        "call": {"role": "assistant", "tool_calls": [call] * r.choice([1] * 8 + [2])},
        "old": {"role": "assistant", "function_call": {"name": name, "arguments": arguments}, "tool_calls": r.choice([[], [], [], [call]])},
        "reply": {"role": "tool", "tool_call_id": at, "content": r.choice(["ok", {"x": 1}, [1]] * 3 + [None])},
        "old reply": {"role": "function", "name": name, "content": "ok"},
        "system": {"role": "system", "content": r.choice(["S", "S", None])},
        "prose": {"role": "assistant", "content": "thinking"},
        "odd": {"role": r.choice(["assistant", "assistant", "critic"])},
    }[kind]


def serial(r):
    """A conversation in order, with one message changed at times."""
    out = [{"role": "system", "content": "S"}] * r.choice([0, 1]) + [{"role": "user", "content": r.choice(["Do it"] * 15 + ["Do not"])}]
    for i in range(r.randint(0, 4)):
        name = r.choice("ab")
        if r.random() < 0.5:
            out.append({"role": "assistant", "tool_calls": [{"id": f"i{i}", "function": {"name": name, "arguments": '{"n": %d}' % i}}]})
            out.append({"role": "tool", "tool_call_id": f"i{i}", "content": r.choice(["ok", {"z": i}])})
        else:
            out.append({"role": "assistant", "function_call": {"name": name, "arguments": {"n": i}}})
            out.append({"role": "function", "name": name, "content": "ok"})
    if r.random() < 0.7:
        at = r.randrange(len(out) + 1)
        out[at : at + r.choice([0, 1])] = [message(r)] * r.choice([0, 1, 1])
    return out


def calls_of(m):
    if m.get("role") != "assistant":
        return []
    return [c["function"] for c in m.get("tool_calls", [])] or ([m["function_call"]] if m.get("function_call") else [])


def both(m):
    return m.get("role") == "assistant" and bool(m.get("function_call")) and bool(m.get("tool_calls"))


def walk_first(messages, question):
    users = []
    for m in messages:
        made = calls_of(m)
        if m["role"] == "user":
            users.append(m.get("content"))
        elif m["role"] in ("tool", "function"):
            return "orphan_preceding_response", None
        elif both(m):
            return "ambiguous_call_representation", None
        elif len(made) > 1:
            return "parallel_first_calls", None
        elif made:
            if len(users) != 1 or not isinstance(users[0], str):
                return "unsupported_clarification_history", None
            return (None, made[0]["name"]) if key(users[0]) == key(question) else ("question_history_mismatch", None)
    return "no_tool_call", None


def as_object(arguments):
    try:
        value = json.loads(arguments) if isinstance(arguments, str) else arguments
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def walk_later(messages, question):
    user, pending, ids, done, out = None, None, set(), 0, []
    for at, m in enumerate(messages):
        role, made = m["role"], calls_of(m)
        text = isinstance(m.get("content"), str)
        if role == "system":
            if user is not None or not text:
                return "late_or_invalid_system_message", []
        elif role == "user":
            if user is not None or not text:
                return "unsupported_clarification_history", []
            if key(m["content"]) != key(question):
                return "question_history_mismatch", []
            user = m["content"]
        elif role == "assistant":
            if both(m):
                return "ambiguous_call_representation", []
            if not made:
                continue
            if user is None or len(made) != 1 or pending:
                return "nonserial_or_pre_user_call", []
            if made[0]["name"] not in ("a", "b"):
                return "undeclared_call", []
            arguments = as_object(made[0]["arguments"])
            if arguments is None:
                return "nonobject_arguments", []
            if made[0]["name"] == "a" and not isinstance(arguments.get("n"), int):
                return "argument_schema_violation", []
            modern = bool(m.get("tool_calls"))
            if modern:
                i = m["tool_calls"][0]["id"]
                if not isinstance(i, str) or not i or i in ids:
                    return "invalid_call_identity", []
                ids.add(i)
            pending = ("tool", i) if modern else ("function", made[0]["name"])
            if done:
                out.append((at, made[0]["name"], done))
        elif role in ("tool", "function"):
            if not pending:
                return "orphan_response", []
            if (role, m.get("tool_call_id") if role == "tool" else m.get("name")) != pending:
                return "response_identity_mismatch", []
            if not isinstance(m.get("content"), str | dict | list):
                return "unsupported_response_content", []
            pending, done = None, done + 1
        else:
            return "unsupported_message_role", []
    if pending:
        return "unanswered_final_call", []
    return (None, out) if user is not None else ("missing_user", [])


@pytest.fixture(scope="module")
def dialogues():
    r = random.Random(5)
    return [serial(r) if i % 3 else [message(r) for _ in range(r.randint(0, 5))] for i in range(1500)]


def test_first_calls_of_random_messages(spark, dialogues):
    rows = [(i, json.dumps(d), " Do it ") for i, d in enumerate(dialogues)]
    got = {x.i: (x.reason, x.name) for x in conversations.first_tool_calls(spark.createDataFrame(rows, "i int, m string, q string"), "i", "m", "q").collect()}
    wanted = {i: walk_first(d, "Do it") for i, d in enumerate(dialogues)}
    assert got == wanted
    assert len({reason for reason, _ in wanted.values()}) == 7


def test_later_calls_of_random_messages(spark, dialogues):
    rows = [(i, json.dumps(d), "Do it", json.dumps(TOOLS), 1) for i, d in enumerate(dialogues)]
    frame = spark.createDataFrame(rows, "i int, m string, q string, t string, name int")
    choices, verdicts = conversations.later_tool_calls(frame, "i", "m", "q", "t")
    wanted = {i: walk_later(d, "Do it") for i, d in enumerate(dialogues)}
    assert {x.i: x.reason for x in verdicts.collect()} == {i: reason for i, (reason, _) in wanted.items()}
    assert len({reason for reason, _ in wanted.values()}) >= 15
    got = choices.collect()
    assert sorted((x.i, x.at, x.name, x.preceding) for x in got) == sorted((i, *c) for i, (_, made) in wanted.items() for c in made)
    # The digest of what comes before is that of the same calls and responses, whatever their ids.
    parts = {}
    for x in got:
        before = [m for m in dialogues[x.i][: x.at] if calls_of(m) or m["role"] in ("tool", "function")]
        parts.setdefault(x.history, set()).add(json.dumps(before, sort_keys=True))
    assert all(len(same) == 1 for same in parts.values()) and len(parts) > 20


def written(spark):
    """Bytes in the checkpoint folder."""
    import pathlib

    from millrace.runtime import ensure_checkpoint_dir

    return sum(p.stat().st_size for p in pathlib.Path(ensure_checkpoint_dir(spark).removeprefix("file:")).rglob("*") if p.is_file())


def test_conversations_are_neither_shuffled_nor_written(spark, dialogues):
    def run(times):
        rows = [(i, json.dumps(d), "Do it", json.dumps(TOOLS)) for i, d in enumerate(dialogues * times)]
        frame, before = spark.createDataFrame(rows, "i int, m string, q string, t string"), written(spark)
        choices, verdicts = conversations.later_tool_calls(frame, "i", "m", "q", "t")
        assert choices.count() and verdicts.count() == len(rows)
        return [choices.drop("history"), verdicts], written(spark) - before

    frames, once = run(1)
    assert run(4)[1] < once + 10_000
    for frame in frames:
        assert not re.findall("hashpartitioning|rangepartitioning", frame._jdf.queryExecution().executedPlan().toString())


def test_later_calls_under_deep_schemas(spark, monkeypatch):
    deep = {"name": "d", "parameters": {"properties": {"x": {"items": {"properties": {"y": {"items": {"properties": {"z": {"type": "integer"}}}}}}}}}}
    at = lambda z: json.dumps({"x": [{"y": [{"z": 1}, {"z": z}]}]})

    def talk(*calls):
        out = [{"role": "user", "content": "Do it"}]
        for name, arguments in calls:
            out += [{"role": "assistant", "function_call": {"name": name, "arguments": arguments}}, {"role": "function", "name": name, "content": "ok"}]
        return json.dumps(out)

    cases = [talk(("d", at(1)), ("a", '{"n": 1}')), talk(("a", '{"n": 1}'), ("d", at("no"))), talk(("d", at(1)), ("a", '{"n": "no"}')), talk(("d", at("no")), ("x", "{}")), talk(("x", "{}"), ("d", at("no"))), talk()]
    rows = spark.createDataFrame([(i, t, "Do it", json.dumps([*TOOLS, deep])) for i, t in enumerate(cases)], "i int, m string, q string, t string")
    for deepest in (4, 6):  # in rounds of joins, and within the row
        monkeypatch.setattr(conversations, "IN_ROW", deepest)
        monkeypatch.setattr(json_schema, "IN_ROW", deepest)
        choices, verdicts = conversations.later_tool_calls(rows, "i", "m", "q", "t")
        assert [x.reason for x in sorted(verdicts.collect())] == [None, *["argument_schema_violation"] * 3, "undeclared_call", None]
        assert [(x.i, x.at, x.name, x.preceding) for x in choices.collect()] == [(0, 3, "a", 1)]


def test_lists_of_tools_that_are_not_used(spark):
    talk = json.dumps([{"role": "user", "content": "Do it"}])
    ref = [{"name": "r", "parameters": {"$ref": "#/x"}}]
    tools = [None, "{}", "[] []", '[{"name": 1}]', '[{"name": "a"}]', json.dumps(TOOLS[:1] * 2), json.dumps(ref), "[]", json.dumps(TOOLS)]
    rows = [(i, talk, "Do it", t) for i, t in enumerate(tools)] + [(9, None, "Do it", "[]"), (10, talk, None, "[]"), (11, "[]", "Do it", "[]"), (12, "[3]", "Do it", "[]")]
    _, verdicts = conversations.later_tool_calls(spark.createDataFrame(rows, "i int, m string, q string, t string"), "i", "m", "q", "t")
    assert [x.reason for x in sorted(verdicts.collect())] == [
        "invalid_tools", "invalid_tools", "invalid_tools", "invalid_tool_schema", "invalid_tool_schema", "duplicate_tool_names", "unsupported_schema_reference", None, None,
        "invalid_messages", "question_history_mismatch", "missing_user", "unsupported_message_role",
    ]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "i int, m string, q string, t string")
    choices, verdicts = conversations.later_tool_calls(none, "i", "m", "q", "t")
    frames = [choices, verdicts, conversations.first_tool_calls(none, "i", "m", "q"), conversations.transcript_choices(none, "i", "m", "q"), conversations.listed_tool_calls(none, "i", "m", "q", "x")]
    assert [f.count() for f in frames] == [0] * 5


def test_transcripts(spark):
    tool = '{"name": "f", "description": "d"}'
    cases = [
        (None, None, "no_function", None),
        ("x " + tool, "", "invalid_initial_turns", None),
        ("x " + tool, "USER: hi ASSISTANT: a?", None, "clarify"),
        ("x " + tool, "USER: hi ASSISTANT: one\nASSISTANT: two?\nUSER: x", None, "clarify"),
        ("x " + tool, "USER: hi ASSISTANT: one USER: why? ASSISTANT: I cannot", "unclassified_noncall_response", None),
        ("x " + tool + "}", "USER: hi ASSISTANT: a?", "multiple_or_trailing_function_schemas", None),
        ("x " + tool + tool, "USER: hi ASSISTANT: a?", "multiple_or_trailing_function_schemas", None),
        ('{"name": "f"}', "USER: hi ASSISTANT: a?", "invalid_function", None),
        ('{"name": "f", "description": null}', "USER: hi ASSISTANT: a?", "invalid_function", None),
        (tool, 'USER: hi\nASSISTANT: <functioncall> {"name": "f", "arguments": \'{"q": "it\\\'s"}\'} <|endoftext|> <functioncall> x', None, "tool"),
        (tool, 'USER: hi\nASSISTANT: <functioncall> {"name": "g"}', "call_function_mismatch", None),
        (tool, "USER: hi\nASSISTANT: <functioncall>", "unsupported_call_format", None),
        (tool, "USER: hi\nASSISTANT: <functioncall> [1]", "call_function_mismatch", None),
        (tool, "USER: hi\nASSISTANT: I am UNABLE to", None, "respond"),
        (tool, "USER:\nASSISTANT: I am UNABLE to", "invalid_initial_turns", None),  # the mark takes the white space after it
    ]
    rows = spark.createDataFrame([(i, s, c) for i, (s, c, _, _) in enumerate(cases)], "i int, s string, c string")
    got = sorted(conversations.transcript_choices(rows, "i", "s", "c").collect())
    assert [(x.reason, x.choice) for x in got] == [c[2:] for c in cases]
    assert [got[2].state, got[2].tool] == ["hi", "f"]


def test_call_syntax_and_leading_json(spark):
    cases = [
        ("f", "[f(a=1, b=[2, {'c': None}])]", None),
        ("a b/c", " [a b/c(x='y)')] ", None),
        ("f", "[f(a=1), f(a=2)]", "not_a_single_simple_call"),
        ("f", "[f(a=g())]", "not_a_single_simple_call"),
        ("f", "[f(1).x]", "not_a_single_simple_call"),
        ("f", "[f(a=]", "unsupported_call_syntax"),
        ("f", "[f(" + "(" * 5000, "unsupported_call_syntax"),
        ("f", "f(a=1)", "call_result_name_mismatch"),
        ("f", None, "call_result_name_mismatch"),
        (None, "[f()]", "call_result_name_mismatch"),
    ]
    rows = spark.createDataFrame([(i, n, t) for i, (n, t, _) in enumerate(cases)], "i int, n string, t string")
    assert [x.f for x in sorted(rows.select("i", C.call_fault(F.col("n"), F.col("t")).alias("f")).collect())] == [c[2] for c in cases]
    texts = [("  [1, 2] tail", "[1, 2]"), ("{", None), ("", None), (None, None), ('"x"y', '"x"')]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    assert [x.f for x in sorted(rows.select("i", C.leading_json(F.col("t")).alias("f")).collect())] == [w for _, w in texts]


def test_whole_json_only(spark):
    texts = ["1", "[1] [2]", "1], [2", '1}, {"v":2', '1, "w": 2', "1, 2", "", None, " {} ", "null", '{"a":1,"a":2}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    good = {x.i for x in rows.select("i", C.json_value(F.col("t")).isNotNull().alias("g")).where("g").collect()}
    assert good == {0, 8, 9}


def test_errors_keys_options_and_prompts(spark):
    def shaped(x):
        if isinstance(x, dict):
            return x.get("isError") is True or x.get("is_error") is True or x.get("error") not in (None, False, "", [], {}) or any(map(shaped, x.values()))
        return isinstance(x, list) and any(map(shaped, x))

    r = random.Random(2)
    made = lambda depth: r.choice([None, True, 0, 1, "", "e"]) if depth == 0 else r.choice([{r.choice(["error", "isError", "is_error", "x"]): made(depth - 1)}, [made(depth - 1)], made(0)])
    values = [made(4) for _ in range(300)]
    deep = "[" * 600 + '{"error": 1}' + "]" * 600
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*map(json.dumps, values), deep, None, "{"])], "i int, t string")
    got = [x.e for x in sorted(rows.select("i", C.error_shaped(F.col("t")).alias("e")).collect())]
    assert got == [*map(shaped, values), True, False, False]

    keys = spark.createDataFrame([("n", "d", '{"a": 1, "b": [2]}'), ("n", "d", '{"b":[2],"a":1}'), ("n", None, '{"b":[2],"a":1}'), ("n", "d", None)], "n string, d string, p string")
    found = [x.k for x in keys.select(C.schema_key(F.col("n"), F.col("d"), F.col("p")).alias("k")).collect()]
    assert found[0] == found[1] and len(set(found)) == 3 and all(re.fullmatch("[0-9a-f]{64}", k) for k in found)

    options = spark.createDataFrame([(json.dumps(TOOLS),), ('[{"name": "a"}]',), (None,)], "t string").select(C.tool_options(F.col("t")).alias("o")).collect()
    assert options[0].o[1].description == 'B\nTool schema: {"parameters": {}}' and [options[1].o, options[2].o] == [None, None]

    talk = json.dumps([{"role": "system", "content": "S"}, {"role": "tool", "content": "t"}, {"role": "user", "content": ["u"]}, {"role": "user", "content": "u"}])
    (shown,) = spark.createDataFrame([(talk,)], "t string").select(C.messages_allowed(C.message_array(F.col("t"))).alias("m")).collect()
    assert [tuple(m) for m in shown.m] == [("system", "S"), ("user", "u")]
