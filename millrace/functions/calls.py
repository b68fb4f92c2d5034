"""Tool calls as columns: messages with their call fields, call syntax, schema texts and error-shaped responses.

JSON is read as variants on the JVM. A text that is no JSON, or an object that repeats a name, counts as missing. What
variants cannot say (the syntax of a call, the longest JSON at a text's start, a walk of unknown depth) is a small
function over Arrow batches.
"""

from __future__ import annotations

import ast
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let

CALL = "struct<call_id string, name string, arguments string>"


def json_value(text: Column) -> Column:
    """A text's JSON as a variant; null unless the whole text is one value.

    Spark's parser stops after the first value of a text. Within brackets and within braces the text must both times be
    one value: what closes the one early is a fault in the other.
    """
    alone = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")) == 1
    return F.when(alone, F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))), "$.v", "variant"))


def json_kind(value: Column, path: str = "$") -> Column:
    """``object``, ``array``, ``string``, ``null`` or ``other`` for the value at a path of a variant; null where there is none."""
    return _kind(F.schema_of_variant(value if path == "$" else F.try_variant_get(value, path, "variant")))


def _kind(kind: Column) -> Column:
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "VOID", "null").when(kind.isNotNull(), "other")


def is_object(value: Column) -> Column:
    """Whether a variant is an object; false for null."""
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def json_items(value: Column, path: str = "$") -> Column:
    """The items of an array at a path of a variant, as variants; null where there is no array."""
    return F.try_variant_get(value, path, "array<variant>")


def json_text(value: Column, path: str = "$") -> Column:
    """A string at a path as it is, any other value as JSON text; null where there is none."""
    value = value if path == "$" else F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def _string(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


_CALLED = "struct<name variant, arguments variant>"
_MESSAGE = "struct<role variant, content variant, name variant, tool_call_id variant, tool_calls variant, function_call variant>"


def _call(called: Column, call_id: Column) -> Column:
    return F.struct(call_id.alias("call_id"), _string(called["name"]).alias("name"), json_text(called["arguments"]).alias("arguments"))


def message_array(text: Column) -> Column:
    """The messages of a JSON array as structs in order; null where the text is no JSON array.

    ``at`` counts from 0. ``content_kind`` is a :func:`json_kind`, ``content`` a :func:`json_text`. ``calls`` holds the
    calls of an assistant's message, of ``tool_calls`` or of the older ``function_call``; ``modern`` tells the two apart
    and ``ambiguous`` that a message has both, empty ones not counted. Messages of other roles have no calls. ``name``
    and ``response_to`` say whom a response answers. Fields of unexpected kinds are null, as is all of a message that is
    no object.
    """

    # One step after another, each of what the one before has made: an expression is evaluated wherever it is named.
    def fields(m: Column) -> Column:
        return F.struct(_string(m["role"]).alias("role"), F.schema_of_variant(m["content"]).alias("content_schema"), F.to_json(m["function_call"]).alias("old"), m.alias("m"))

    def parts(f: Column) -> Column:
        m, by_assistant = f["m"], f["role"] == "assistant"
        new = F.try_variant_get(m["tool_calls"], "$", f"array<struct<id variant, function {_CALLED}>>")
        old = F.when(f["old"] != "{}", F.try_variant_get(m["function_call"], "$", _CALLED))
        return F.struct(
            f["role"].alias("role"), _kind(f["content_schema"]).alias("content_kind"), m["content"].alias("content"), _string(m["name"]).alias("name"),
            _string(m["tool_call_id"]).alias("response_to"), F.when(by_assistant, old).alias("old"), F.when(by_assistant, new).alias("new"),
        )

    def message(m: Column, at: Column) -> Column:
        old, new = m["old"].isNotNull(), F.coalesce(F.size(m["new"]) > 0, F.lit(False))
        text = F.when(m["content_kind"] == "string", F.try_variant_get(m["content"], "$", "string")).otherwise(F.to_json(m["content"]))
        calls = F.when(new, F.transform(m["new"], lambda c: _call(c["function"], _string(c["id"])))).when(old, F.array(_call(m["old"], F.lit(None).cast("string"))))
        return F.struct(
            at.alias("at"), m["role"].alias("role"), m["content_kind"].alias("content_kind"), text.alias("content"), m["name"].alias("name"), m["response_to"].alias("response_to"),
            (old & new).alias("ambiguous"), new.alias("modern"), F.coalesce(calls, F.array().cast(f"array<{CALL}>")).alias("calls"),
        )

    read = F.try_variant_get(json_value(text), "$", f"array<{_MESSAGE}>")
    return F.transform(F.transform(F.transform(read, fields), parts), message)


def _leading(text):
    try:
        return text[: json.JSONDecoder().raw_decode(text)[1]]
    except (ValueError, TypeError, RecursionError):
        return None


def leading_json(text: Column) -> Column:
    """The JSON value that a text begins with, after white space; null where it begins with none."""
    return F.udf(_leading, "string", useArrow=True)(F.regexp_replace(text, r"^\s+", ""))


def _call_fault(selected, text):
    prefix = f"[{selected}("
    if selected is None or text is None or not text.strip().startswith(prefix):
        return "call_result_name_mismatch"
    try:
        tree = ast.parse("[f(" + text.strip()[len(prefix) :], mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return "unsupported_call_syntax"
    calls = [x for x in ast.walk(tree) if isinstance(x, ast.Call)]
    alone = isinstance(tree, ast.List) and tree.elts == calls and len(calls) == 1
    return None if alone and isinstance(calls[0].func, ast.Name) and calls[0].func.id == "f" else "not_a_single_simple_call"


def call_fault(selected: Column, text: Column) -> Column:
    """Why a text is not one bracketed call of the named tool, ``[name(key=value)]``; null where it is.

    The tool's name may hold any characters; nothing of the text is executed.
    """
    return F.udf(_call_fault, "string", useArrow=True)(selected, text)


def _options(text):
    try:
        options = []
        for tool in json.loads(text):
            rest = {k: v for k, v in tool.items() if k not in ("name", "description")}
            schema = "\nTool schema: " + json.dumps(rest, sort_keys=True, ensure_ascii=False) if rest else ""
            options.append((tool["name"], tool["description"] + schema))
        return options
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
        return None


def tool_options(tools: Column) -> Column:
    """Options (id, description) of a JSON array of tools: description, then what else a tool has, as JSON with sorted names.

    Null where the text is null or holds anything but objects with a name and a description.
    """
    return F.udf(_options, "array<struct<id string, description string>>", useArrow=True)(tools)


def _error_shaped(text):
    try:
        stack = [json.loads(text)]
    except (ValueError, TypeError, RecursionError):
        return False
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if x.get("isError") is True or x.get("is_error") is True or x.get("error") not in (None, False, "", [], {}):
                return True
            stack += x.values()
        elif isinstance(x, list):
            stack += x
    return False


def error_shaped(text: Column) -> Column:
    """Whether a JSON text holds, at any depth, an ``isError`` or ``is_error`` that is true or an ``error`` that is not empty.

    Zero counts as empty, as false does. A text that is no JSON, null included, is no error.
    """
    return F.udf(_error_shaped, "boolean", useArrow=True)(text)


def schema_key(name: Column, description: Column, parameters: Column) -> Column:
    """SHA-256 that tools of equal name, description and parameters share, whatever the order of names in their JSON."""
    canonical = F.to_json(json_value(parameters))
    return F.sha2(F.to_json(F.struct(name.alias("name"), description.alias("description"), canonical.alias("parameters")), {"ignoreNullFields": "false"}), 256)


def messages_allowed(messages: Column, roles: tuple[str, ...] = ("system", "user", "assistant")) -> Column:
    """Of :func:`message_array`, what a prompt may show: role and content of the roles named, with text content only."""
    shown = F.filter(messages, lambda m: m["role"].isin(*roles) & (m["content_kind"] == "string"))
    return F.transform(shown, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
