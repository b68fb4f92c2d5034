"""JSON Schema validation as joins: schemas become rules, instances become rows, verdicts are reduced from the leaves up.

A schema is flattened once into nodes (its subschemas), each with the rules it states itself and the edge that leads to
it; an instance into its values. Where subschemas are nested no deeper than ``IN_ROW``, an instance is judged within its
row: the nodes of its schema are joined to it, each subschema is applied to the values that it governs and the verdicts
are folded up again, without a shuffle where the schemas are few, and without anything written between. Deeper schemas
take rounds of joins: from the root pair of instance and schema each subschema is applied to the values that it governs;
every pair's own rules are one expression; then each round, from the deepest pairs up, folds the verdicts of a pair's
subschemas into its own, one aggregation a level. Rounds are as many as subschemas are nested, whatever the number of
instances; a value of many children is a group of many rows, which aggregate before they shuffle.

Two dialects are known, draft 7 and 2020-12. References, unknown keywords and other dialects exclude a schema, with a
reason, rather than being ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.runtime import cut

# The dialects' names, their keywords, and the reasons of exclusion.
DRAFT_7 = (
    "http://json-schema.org/draft-07/schema#",
    "https://json-schema.org/draft-07/schema",
    "https://json-schema.org/draft-07/schema#",
)
DRAFT_2020 = ("https://json-schema.org/draft/2020-12/schema", "https://json-schema.org/draft/2020-12/schema#")
ANNOTATIONS = ("$schema", "$comment", "title", "description", "default", "examples", "readOnly", "writeOnly")
ASSERTIONS = (
    "type", "enum", "const", "multipleOf", "maximum", "exclusiveMaximum", "minimum", "exclusiveMinimum", "maxLength",
    "minLength", "pattern", "maxItems", "minItems", "uniqueItems", "maxProperties", "minProperties", "required",
)
APPLICATORS = ("items", "contains", "properties", "patternProperties", "additionalProperties", "allOf", "anyOf", "oneOf", "not", "if", "then", "else")
DEFINITIONS = ("definitions", "$defs")
ONLY_7 = ("additionalItems", "dependencies")
ONLY_2020 = ("prefixItems", "minContains", "maxContains", "dependentRequired", "dependentSchemas", "unevaluatedItems", "unevaluatedProperties")
REFERENCES = ("$ref", "$dynamicRef", "$recursiveRef")
TYPES = ("array", "boolean", "integer", "null", "number", "object", "string")
INVALID, DIALECT, REFERENCE, KEYWORD, NESTED = (
    "invalid_schema",
    "unsupported_schema_dialect",
    "unsupported_schema_reference",
    "unsupported_schema_keyword",
    "nested_schema_dialect",
)

#: Keywords whose subschemas all must hold, those that apply to the value itself, and those to a value's children.
_ALL = ("properties", "patternProperties", "additionalProperties", "items", "at", "rest", "allOf", "dependent")
_SAME = ("allOf", "anyOf", "oneOf", "not", "if", "then", "else", "dependent")
_KEYED = ("properties", "at")
_UNEVALUATED = ("unevaluatedItems", "unevaluatedProperties")

_KNOWN_7 = {*ANNOTATIONS, *ASSERTIONS, *APPLICATORS, *DEFINITIONS, *ONLY_7}
_KNOWN_2020 = {*ANNOTATIONS, *ASSERTIONS, *APPLICATORS, *DEFINITIONS, *ONLY_2020}


class _Excluded(Exception):
    """Carries the reason for which a schema is not used."""


def _number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


_WRITE = json.JSONEncoder(ensure_ascii=False, allow_nan=False).encode
_QUOTED = json.encoder.encode_basestring  # what it writes of a string


def canonical(value) -> str:
    """Compact JSON with sorted keys; whole numbers are written as integers, so equal values are equal texts."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_WRITE(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return _WRITE(value)


def _digest(value) -> str:
    return hashlib.sha256(canonical(value).encode("utf-8", "surrogatepass")).hexdigest()


def _refuse(name):
    raise ValueError(f"{name} is no JSON")


_loads = json.JSONDecoder(parse_constant=_refuse).decode


def _strings(x) -> bool:
    return isinstance(x, list) and all(isinstance(v, str) for v in x) and len(set(x)) == len(x)


def _regex(x) -> bool:
    try:
        re.compile(x)
    except (re.error, TypeError):
        return False
    return True


_COUNT = lambda x: _number(x) and x == int(x) and x >= 0
_SCHEMA = lambda x: isinstance(x, dict | bool)
_NAMED = lambda x: isinstance(x, dict) and all(map(_SCHEMA, x.values()))
_LISTED = lambda x: isinstance(x, list) and len(x) > 0 and all(map(_SCHEMA, x))

#: What the value of a keyword must be, in both dialects; draft 7 also allows an array of ``items``.
_SHAPES = {
    **dict.fromkeys(("$schema", "$comment", "title", "description"), lambda x: isinstance(x, str)),
    **dict.fromkeys(("readOnly", "writeOnly", "uniqueItems"), lambda x: isinstance(x, bool)),
    **dict.fromkeys(("enum", "examples"), lambda x: isinstance(x, list)),
    **dict.fromkeys(("maximum", "exclusiveMaximum", "minimum", "exclusiveMinimum"), _number),
    **dict.fromkeys(("maxLength", "minLength", "maxItems", "minItems", "maxProperties", "minProperties", "minContains", "maxContains"), _COUNT),
    **dict.fromkeys(("contains", "additionalProperties", "additionalItems", "not", "if", "then", "else", *_UNEVALUATED), _SCHEMA),
    **dict.fromkeys(("properties", "definitions", "$defs", "dependentSchemas"), _NAMED),
    **dict.fromkeys(("allOf", "anyOf", "oneOf", "prefixItems"), _LISTED),
    "type": lambda x: x in TYPES if isinstance(x, str) else _strings(x) and len(x) > 0 and set(x) <= set(TYPES),
    "multipleOf": lambda x: _number(x) and x > 0,
    "pattern": _regex,
    "required": _strings,
    "patternProperties": lambda x: _NAMED(x) and all(map(_regex, x)),
    "dependencies": lambda x: isinstance(x, dict) and all(_SCHEMA(v) or _strings(v) for v in x.values()),
    "dependentRequired": lambda x: isinstance(x, dict) and all(map(_strings, x.values())),
}


def _edges(schema: dict, draft_7: bool) -> Iterator[tuple[dict | bool, str, str | None, int, list[str], list[str]]]:
    """(subschema, kind of edge, key, first index, keys left out, patterns left out) of a subschema's applied parts."""
    names, patterns = list(schema.get("properties", {})), list(schema.get("patternProperties", {}))
    for k, x in schema.get("properties", {}).items():
        yield x, "properties", k, 0, [], []
    for k, x in schema.get("patternProperties", {}).items():
        yield x, "patternProperties", k, 0, [], []
    if "additionalProperties" in schema:
        yield schema["additionalProperties"], "additionalProperties", None, 0, names, patterns
    first = schema.get("items", []) if draft_7 else schema.get("prefixItems", [])
    first = first if isinstance(first, list) else []
    for k, x in enumerate(first):
        yield x, "at", str(k), 0, [], []
    if draft_7 and isinstance(schema.get("items"), list):
        if "additionalItems" in schema:
            yield schema["additionalItems"], "rest", None, len(first), [], []
    elif "items" in schema:
        yield schema["items"], "rest", None, len(first), [], []
    if "contains" in schema:
        yield schema["contains"], "contains", None, 0, [], []
    for via in ("allOf", "anyOf", "oneOf"):
        for x in schema.get(via, []):
            yield x, via, None, 0, [], []
    for via in ("not", "if", *_UNEVALUATED):
        if via in schema:
            yield schema[via], via, None, 0, [], []
    if "if" in schema:
        for via in ("then", "else"):
            if via in schema:
                yield schema[via], via, None, 0, [], []
    for k, x in (*schema.get("dependentSchemas", {}).items(), *schema.get("dependencies", {}).items()):
        if not isinstance(x, list):
            yield x, "dependent", k, 0, [], []


def _rules(schema: dict) -> Iterator[tuple[str, float | None, str | None, list[str] | None]]:
    """(keyword, number, text, list) of what a subschema states of a value itself."""
    for k in ASSERTIONS:
        if k not in schema:
            continue
        x = schema[k]
        if k == "type":
            yield k, None, None, [x] if isinstance(x, str) else x
        elif k in ("enum", "const"):
            yield "enum", None, None, [_digest(v) for v in (x if k == "enum" else [x])]
        elif k == "required":
            yield k, None, None, x
        elif k == "pattern":
            yield k, None, x, None
        elif k == "uniqueItems":
            if x:
                yield k, None, None, None
        else:
            yield k, float(x), None, None
    for k, x in (*schema.get("dependentRequired", {}).items(), *schema.get("dependencies", {}).items()):
        if isinstance(x, list):
            yield "dependentRequired", None, k, x


def _check(schema, known: set[str], uri: str, draft_7: bool) -> None:
    """Raise the reason for which a schema is excluded: first of all its form, then what it uses, from the root down."""
    parts = [schema]
    while parts:  # the form of all parts
        x = parts.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                listed = draft_7 and k == "items" and isinstance(v, list)
                if k == "items" and not (_LISTED(v) if listed else _SCHEMA(v)):
                    raise _Excluded(INVALID)
                if k in known and k in _SHAPES and not _SHAPES[k](v):
                    raise _Excluded(INVALID)
            parts += [s for s in _subschemas(x) if isinstance(s, dict)]
    parts = [schema]
    while parts:
        x = parts.pop()
        if any(k in x for k in REFERENCES):
            raise _Excluded(REFERENCE)
        if set(x) - known:
            raise _Excluded(KEYWORD)
        if x is not schema and x.get("$schema", uri) != uri:
            raise _Excluded(NESTED)
        parts += reversed([s for s in _subschemas(x) if isinstance(s, dict)])


def _subschemas(schema: dict) -> Iterator:
    for k in ("properties", "patternProperties", *DEFINITIONS, "dependentSchemas", "dependencies"):
        if isinstance(schema.get(k), dict):
            yield from schema[k].values()
    for k in ("allOf", "anyOf", "oneOf", "prefixItems", "items"):
        if isinstance(schema.get(k), list):
            yield from schema[k]
    for k in ("not", "if", "then", "else", "additionalProperties", "additionalItems", "contains", "items", *_UNEVALUATED):
        if k in schema and not isinstance(schema[k], list):
            yield schema[k]


_NODE = (
    "node: int, parent: int, depth: int, edges: array<int>, via: string, name: string, low: int, names: array<string>, patterns: array<string>, never: boolean, "
    "least: double, most: double, has_contains: boolean, tracked: boolean, "
    "rules: array<struct<keyword: string, number: double, text: string, list: array<string>>>"
)


def _compiled(text: str | None) -> tuple[str | None, list[dict]]:
    """(reason, nodes) of a schema's text; excluded schemas have no nodes."""
    try:
        schema = _loads(text)
        if not isinstance(schema, dict):
            raise _Excluded(INVALID)
        uri = schema.get("$schema", DRAFT_7[0])
        if uri not in DRAFT_7 and uri not in DRAFT_2020:
            raise _Excluded(DIALECT)
        draft_7 = uri in DRAFT_7
        _check(schema, _KNOWN_7 if draft_7 else _KNOWN_2020, uri, draft_7)
    except _Excluded as e:
        return str(e), []
    except (ValueError, TypeError, RecursionError):
        return INVALID, []
    nodes: list[dict] = []
    open_: list = [(schema, None, None, None, 0, [], [], False)]
    while open_:
        part, parent, via, name, low, names, patterns, tracked = open_.pop()
        own = part if isinstance(part, dict) else {}
        tracked = tracked or any(k in own for k in _UNEVALUATED)
        nodes.append(
            {
                "node": len(nodes), "parent": parent, "depth": 0 if parent is None else nodes[parent]["depth"] + 1, "edges": [], "via": via, "name": name, "low": low, "names": names, "patterns": patterns,
                "never": part is False, "least": float(own.get("minContains", 1)), "most": float(own.get("maxContains", 1e300)),
                "has_contains": "contains" in own, "tracked": tracked,
                "rules": [dict(zip(("keyword", "number", "text", "list"), r, strict=True)) for r in _rules(own)],
            }
        )
        at = len(nodes) - 1
        if parent is not None:
            nodes[parent]["edges"].append(at)
        # What a part evaluates matters to the parts that apply to the same value.
        open_ += [(x, at, kind, *rest, tracked and kind in _SAME) for x, kind, *rest in _edges(own, draft_7)]
    return None, nodes


_FACTS = (
    "path string, name string, place int, kind string, text string, number double, decimal string, size long, digest string, "
    "keys array<string>, alike boolean"
)
_VALUE = f"path string, own struct<{_FACTS}>, children array<struct<{_FACTS}>>"


def _facts(path: str, name: str | None, place: int | None, x) -> tuple:
    """Path, key, index, kind, text, number, decimal, size, digest, keys, whether two items are equal."""
    kind, text, number, decimal, size, keys, alike = "null", None, None, None, None, None, None
    if isinstance(x, dict):
        kind, size, keys = "object", len(x), list(x)
    elif isinstance(x, list):
        kind, size = "array", len(x)
        alike = len({_digest(v) for v in x}) < len(x)
    elif isinstance(x, bool):
        kind = "boolean"
    elif isinstance(x, str):
        kind, text = "string", x
    elif x is not None:
        kind = "integer" if x == int(x) else "number"
        number, decimal = float(x), canonical(x)
    return path, name, place, kind, text, number, decimal, size, _digest(x), keys, alike


def _values(value) -> Iterator[tuple[str, tuple | None, list[tuple]]]:
    """(path, facts, facts of the children) of the root and of every value with children; facts of the root alone."""
    stack = [("", value, _facts("", None, None, value))]
    while stack:
        path, x, own = stack.pop()
        if isinstance(x, dict):
            children = [(path + "/" + k.replace("~", "~0").replace("/", "~1"), k, None, v) for k, v in x.items()]
        else:
            children = [(f"{path}/{i}", str(i), i, v) for i, v in enumerate(x)] if isinstance(x, list) else []
        yield path, own, [_facts(*c) for c in children]
        stack += [(c[0], c[3], None) for c in children if isinstance(c[3], dict | list) and c[3]]


_FACT_TYPES = (
    pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int64(), pa.string(),
    pa.list_(pa.string()), pa.bool_(),
)
_FACT_NAMES = [x.split(" ")[0] for x in _FACTS.split(", ")]
BATCH_VALUES = 10_000  # values that a batch holds about


_TREE = f"array<struct<at int, first int, {_FACTS.replace('path string, ', '')}>>"
_TREE_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("first", pa.int32()), *zip(_FACT_NAMES[1:], _FACT_TYPES[1:], strict=True)]))


def _tree(text: str | None) -> list[tuple] | None:
    """The facts of all values of a text, root first, children side by side from ``first`` on; null where it is no JSON.

    From the last value to the first, each is written of what its children were written as.
    """
    try:
        values, names, places, firsts = [_loads(text)], [None], [None], []
        for x in values:  # grows as it is walked
            firsts.append(len(values))
            if isinstance(x, dict):
                names += x
                places += [None] * len(x)
                values += x.values()
            elif isinstance(x, list):
                names += map(str, range(len(x)))
                places += range(len(x))
                values += x
        out, written = [None] * len(values), [""] * len(values)
        for at in range(len(values) - 1, -1, -1):
            x, first = values[at], firsts[at]
            kind, said, number, decimal, size, keys, alike = "null", None, None, None, None, None, None
            if isinstance(x, str):
                kind, said, w = "string", x, _QUOTED(x)
            elif isinstance(x, dict | list):
                size = len(x)
                below = written[first : first + size]
                written[first : first + size] = [""] * size
                if isinstance(x, dict):
                    kind, keys = "object", list(x)
                    of = dict(zip(keys, below, strict=True))
                    w = "{" + ",".join([f"{_QUOTED(k)}:{of[k]}" for k in sorted(keys)]) + "}"
                else:
                    kind, alike = "array", len(set(below)) < size
                    w = "[" + ",".join(below) + "]"
            elif isinstance(x, bool):
                kind, w = "boolean", "true" if x else "false"
            elif x is None:
                w = "null"
            else:
                whole = x == int(x)
                kind, number, w = "integer" if whole else "number", float(x), repr(int(x) if whole else x)
                decimal = w
            written[at] = w
            digest = hashlib.sha256(w.encode("utf-8", "surrogatepass")).hexdigest()
            out[at] = (at, first, names[at], places[at], kind, said, number, decimal, size, digest, keys, alike)
    except (ValueError, TypeError, RecursionError, OverflowError):
        return None
    return out


def _value_trees(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        made, held = [], 0
        for some in batch.to_pylist():
            made.append(None if some is None else [_tree(x) for x in some])
            held += sum(map(len, filter(None, made[-1] or ())))
            if held >= BATCH_VALUES:
                yield _trees(made)
                made, held = [], 0
        if made or not len(batch):
            yield _trees(made)


def value_trees(texts: Column) -> Column:
    """For lists of JSON texts, the values of each text in the order of ``_tree``, made in batches of about ``BATCH_VALUES``."""
    return F.arrow_udf(_value_trees, f"array<{_TREE}>")(texts)


def _trees(lists: list[list[list[tuple] | None] | None]) -> pa.Array:
    """Lists of lists of values as Arrow has them, column by column."""
    trees = [tree for some in lists for tree in some or ()]
    values = [v for tree in trees for v in tree or ()]
    columns = zip(*values, strict=True) if values else [()] * _TREE_TYPE.value_type.num_fields
    fields = list(_TREE_TYPE.value_type)
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)

    def nested(items: list, inside: pa.Array) -> pa.Array:
        ends = [0, *accumulate(len(x or ()) for x in items)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inside, mask=pa.array([x is None for x in items], pa.bool_()))

    return nested(lists, nested(trees, structs))


def _flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple] = []
        held = 0
        for row, schema_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            try:
                values = list(_values(_loads(text)))
            except (ValueError, TypeError, RecursionError, OverflowError):
                continue  # no root value: the instance is invalid
            found += [(row, schema_id, *x) for x in values]
            held += sum(1 + len(x[2]) for x in values)
            if held >= BATCH_VALUES:
                yield _batch(found, batch.schema)
                found, held = [], 0
        if found:
            yield _batch(found, batch.schema)


def _batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    def structs(facts: list[tuple], mask: pa.Array | None = None) -> pa.Array:
        columns = zip(*facts, strict=True) if facts else [()] * len(_FACT_TYPES)
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _FACT_TYPES, strict=True)], _FACT_NAMES, mask=mask)

    rows, ids, paths, own, children = zip(*found, strict=True)
    nothing = (None,) * len(_FACT_TYPES)
    ends = [0, *accumulate(map(len, children))]
    columns = [
        pa.array(rows, schema.field(0).type), pa.array(ids, schema.field(1).type), pa.array(paths, pa.string()),
        structs([x or nothing for x in own], pa.array([x is None for x in own])),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs([c for some in children for c in some])),
    ]
    return pa.record_batch(columns, ["row", "schema_id", "path", "own", "children"])


def _kept(rule: Column, v: Column) -> Column:
    """Whether a value keeps a rule; rules of other kinds of value are kept."""
    number, text, named = rule["number"], rule["text"], rule["list"]
    kind, x, size = v["kind"], v["number"], v["size"]
    is_number = kind.isin("integer", "number")
    decimal = "decimal(38,12)"
    whole = F.coalesce(v["decimal"].try_cast(decimal) % number.cast("string").try_cast(decimal) == 0, x % number == 0)
    holds_all = F.forall(named, lambda k: F.array_contains(v["keys"], k))
    numeric = {
        "multipleOf": whole, "maximum": x <= number, "exclusiveMaximum": x < number, "minimum": x >= number, "exclusiveMinimum": x > number,
    }
    lengths = {"maxLength": lambda n: n <= number, "minLength": lambda n: n >= number}
    sizes = {"Items": "array", "Properties": "object"}
    kept = F.when(rule["keyword"] == "type", F.array_contains(named, kind) | ((kind == "integer") & F.array_contains(named, "number")))
    kept = kept.when(rule["keyword"] == "enum", F.array_contains(named, v["digest"]))
    for k, holds in numeric.items():
        kept = kept.when(rule["keyword"] == k, ~is_number | holds)
    for k, holds in lengths.items():
        kept = kept.when(rule["keyword"] == k, (kind != "string") | holds(F.char_length(v["text"])))
    kept = kept.when(rule["keyword"] == "pattern", (kind != "string") | F.rlike(v["text"], text))
    for k, of in sizes.items():
        kept = kept.when(rule["keyword"] == f"max{k}", (kind != of) | (size <= number))
        kept = kept.when(rule["keyword"] == f"min{k}", (kind != of) | (size >= number))
    kept = kept.when(rule["keyword"] == "uniqueItems", (kind != "array") | ~v["alike"])
    kept = kept.when(rule["keyword"] == "required", (kind != "object") | holds_all)
    return kept.when(rule["keyword"] == "dependentRequired", (kind != "object") | ~F.array_contains(v["keys"], text) | holds_all)


def _made(schemas: DataFrame, schema_id: str, text: str) -> DataFrame:
    def compile_(batches):
        for batch in batches:
            reasons, nodes = zip(*map(_compiled, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(reasons, pa.string()), pa.array(map(json.dumps, nodes), pa.string())], ["schema_id", "reason", "nodes"]
            )

    kind = schemas.schema[schema_id].dataType.simpleString()
    rows = schemas.select(F.col(schema_id).alias("schema_id"), F.col(text).cast("string").alias("text"))
    rows = rows.groupBy("schema_id").agg(F.min("text").alias("text"))
    return cut(rows.mapInArrow(compile_, f"schema_id {kind}, reason string, nodes string"))


def _governed(v: Column, edge: Column, values: Column) -> Column:
    """The values that a subschema applies to: the value itself, or those of its children that its edge leads to."""
    via, in_object, in_array = edge["via"], v["kind"] == "object", v["kind"] == "array"
    none = F.slice(values, F.lit(1), F.lit(0))
    child = lambda i: F.slice(values, v["first"] + 1 + i, F.lit(1))
    children = lambda low: F.slice(values, v["first"] + 1 + low, F.greatest(v["size"].cast("int") - low, F.lit(0)))
    all_ = children(F.lit(0))
    place = F.array_position(v["keys"], edge["name"]).cast("int")
    free = lambda c: ~F.array_contains(edge["names"], c["name"]) & ~F.exists(edge["patterns"], lambda p: F.rlike(c["name"], p))
    index = F.when(via == "at", edge["name"].cast("int"))
    return (
        F.when(via == "dependent", F.when(in_object & F.array_contains(v["keys"], edge["name"]), F.array(v)).otherwise(none))
        .when(via.isin(*_SAME), F.array(v))
        .when(via == "properties", F.when(in_object & (place > 0), child(place - 1)).otherwise(none))
        .when(via == "at", F.when(in_array & (index < v["size"]), child(index)).otherwise(none))
        .when(via == "rest", F.when(in_array, children(edge["low"])).otherwise(none))
        .when(via.isin("contains", "unevaluatedItems"), F.when(in_array, all_).otherwise(none))
        .when(~in_object, none)
        .when(via == "patternProperties", F.filter(all_, lambda c: F.rlike(c["name"], edge["name"])))
        .when(via == "additionalProperties", F.filter(all_, free))
        .otherwise(all_)
    )


def _verdict(v: Column, n: Column, nodes: Column, values: Column, depth: int) -> Column:
    """(via, at, valid, evaluated) of a value under a node whose subschemas are nested ``depth`` deep at most.

    ``evaluated`` has the children that the node evaluates, where that matters.
    """
    own = ~n["never"] & F.forall(n["rules"], lambda r: _kept(r, v))
    out = lambda valid, evaluated: F.struct(n["via"].alias("via"), v["at"].alias("at"), valid.alias("valid"), evaluated.alias("evaluated"))
    nothing = F.array().cast("array<int>")
    if depth == 0:
        return out(own, nothing)
    edges = F.transform(n["edges"], lambda e: F.get(nodes, e))
    below = F.flatten(F.transform(edges, lambda edge: F.transform(_governed(v, edge, values), lambda c: _verdict(c, edge, nodes, values, depth - 1))))

    def folded(b: Column) -> Column:
        all_ = lambda *vias: F.forall(b, lambda p: ~p["via"].isin(*vias) | p["valid"])
        some = lambda via: F.exists(b, lambda p: (p["via"] == via) & p["valid"])
        none = lambda via: ~F.exists(b, lambda p: p["via"] == via)
        count = lambda via: F.size(F.filter(b, lambda p: (p["via"] == via) & p["valid"]))
        counted = ~n["has_contains"] | (v["kind"] != "array") | count("contains").between(n["least"], n["most"])
        # Of a condition, what the branch taken evaluates counts, and the condition's own only where it holds.
        children = ("properties", "patternProperties", "additionalProperties", "at", "rest")
        through = F.transform(F.filter(b, lambda p: p["via"].isin(*children) | ((p["via"] == "contains") & p["valid"])), lambda p: p["at"])
        passed = F.filter(b, lambda p: p["via"].isin(*_SAME) & (p["via"] != "not") & p["valid"] & ((p["via"] != "then") | some("if")) & ((p["via"] != "else") | ~some("if")))
        seen = F.array_union(through, F.flatten(F.transform(passed, lambda p: p["evaluated"])))
        left = F.filter(b, lambda p: p["via"].isin(*_UNEVALUATED))

        def rest(s: Column) -> Column:
            valid = (
                all_(*_ALL) & (none("anyOf") | some("anyOf")) & (none("oneOf") | (count("oneOf") == 1)) & ~some("not")
                & F.when(some("if"), all_("then")).otherwise(all_("else")) & counted
                & F.forall(left, lambda p: F.array_contains(s, p["at"]) | p["valid"])
            )
            return out(own & valid, F.when(n["tracked"], F.array_union(s, F.transform(left, lambda p: p["at"]))).otherwise(nothing))

        return let(F.when(n["tracked"], seen).otherwise(nothing), rest)

    return let(below, folded)


def keeps(values: Column, nodes: Column, depth: int) -> Column:
    """Whether the values of one instance (of ``value_trees``) keep the schema of these nodes; null where there are none."""
    both = F.struct(values.alias("values"), nodes.alias("nodes"))
    valid = let(both, lambda b: _verdict(F.get(b["values"], F.lit(0)), F.get(b["nodes"], F.lit(0)), b["nodes"], b["values"], depth)["valid"])
    return F.when(values.isNotNull() & (F.size(nodes) > 0), valid)


def compiled(schemas: DataFrame, schema_id: str, text: str) -> tuple[DataFrame, int, int]:
    """(schema_id, reason, nodes, depth) of each schema, how many nodes or schemas there are, and the greatest ``depth``.

    ``depth`` says how deep subschemas are nested; of excluded schemas, without nodes, it is 0.
    """
    made = _made(schemas, schema_id, text).select("schema_id", "reason", F.from_json("nodes", f"array<struct<{_NODE}>>").alias("nodes"))
    made = made.withColumn("depth", F.coalesce(F.array_max(F.transform("nodes", lambda n: n["depth"])), F.lit(0)))
    of_all = made.agg(F.count("*").alias("schemas"), F.coalesce(F.sum(F.size("nodes")), F.lit(0)).alias("nodes"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth")).first()
    return made, max(of_all["schemas"], of_all["nodes"]), of_all["depth"]


IN_ROW = 4  # how deep subschemas may be nested to be judged within a row: an expression grows with each
SMALL_NODES = 10_000  # schema nodes that are broadcast, some megabytes; more of them are joined by shuffles


def _expanded(values: DataFrame, nodes: DataFrame, small: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Pairs of value and node, by depth: (row, schema_id, path, node, up, parent, via), with what the node states itself.

    ``own`` is the verdict of the pair's own rules, ``onward`` whether its node has subschemas, ``deep`` whether any apply
    to children. Facts travel with the pairs; only the children of values below the root are joined to them.
    """
    at_value = F.col("via").isin(*_SAME)
    edges = nodes.where("parent is not null").select("schema_id", "node", "parent", "via", F.col("name").alias("edge"), "low", "names", "patterns")
    to_child = edges.where(~at_value).withColumn("__key", F.when(F.col("via").isin(*_KEYED), F.col("edge")))
    to_child = to_child.withColumnsRenamed({"schema_id": "__schema", "parent": "__parent"})
    to_self = edges.where(at_value)
    onward = edges.groupBy("schema_id", F.col("parent").alias("node")).agg(F.lit(True).alias("onward"), F.bool_or(~at_value).alias("deep"))
    stated = nodes.select("schema_id", "node", "never", "least", "most", "has_contains", "tracked", "rules").join(onward, ["schema_id", "node"], "left")
    stated = small(cut(stated.fillna(False, ["onward", "deep"])))
    to_child, to_self = small(to_child), small(to_self)
    keys = ["row", "schema_id", "path", "node", "up", "parent", "via", "up_tracked"]
    facts = ["least", "most", "has_contains", "tracked", "onward", "deep"]

    def level(pairs: DataFrame, *more: str) -> DataFrame:
        judged = pairs.join(stated, ["schema_id", "node"]).withColumn("own", ~F.col("never") & F.forall("rules", lambda r: _kept(r, F.col("v"))))
        is_array = (F.col("v.kind") == "array").alias("is_array")
        kept = [F.when(F.col("onward"), F.col("v")).alias("v"), *[F.when(F.col("deep"), F.col(c)).alias(c) for c in more]]
        return cut(judged.select(*keys, *facts, "own", is_array, *kept))

    roots = values.where("own is not null").join(small(nodes.where("parent is null").select("schema_id", "node")), "schema_id")
    none = F.lit(None).cast("string")
    roots = roots.select("row", "schema_id", "path", "node", none.alias("up"), F.lit(None).cast("int").alias("parent"), none.alias("via"), F.lit(False).alias("up_tracked"), F.col("own").alias("v"), "children")
    levels = [level(roots, "children")]
    inner = values.where(F.size("children") > 0).select("row", "path", "children")
    while True:
        from_ = levels[-1].where("onward")
        if not from_.take(1):
            return levels
        deep = from_.where("deep and v.size > 0")
        deep = deep if "children" in deep.columns else deep.join(inner, ["row", "path"])
        moved = ["row", "schema_id", F.col("path").alias("up"), F.col("node").alias("parent"), F.col("tracked").alias("up_tracked")]
        # A child meets the edges of its own key, and those of any.
        kids = deep.select(*moved, F.explode("children").alias("v")).select("*", F.explode(F.array(F.col("v.name"), F.lit(None))).alias("key"))
        kids = kids.join(to_child, F.expr("schema_id = __schema AND parent = __parent AND key <=> __key"))
        name, place = F.col("v.name"), F.col("v.place")
        free = ~F.array_contains("names", name) & ~F.exists("patterns", lambda p: F.rlike(name, p))
        in_object = F.when(F.col("via") == "patternProperties", F.rlike(name, F.col("edge"))).when(F.col("via") == "additionalProperties", free)
        in_object = in_object.otherwise(F.col("via").isin("properties", "unevaluatedProperties"))
        in_array = F.when(F.col("via") == "rest", place >= F.col("low")).otherwise(F.col("via").isin("at", "contains", "unevaluatedItems"))
        kids = kids.where(F.when(place.isNull(), in_object).otherwise(in_array)).withColumn("path", F.col("v.path"))
        own = from_.select(*moved, "v").join(to_self, ["schema_id", "parent"]).withColumn("path", F.col("up"))
        own = own.where((F.col("via") != "dependent") | ((F.col("v.kind") == "object") & F.array_contains("v.keys", F.col("edge"))))
        levels.append(level(kids.select(*keys, "v").unionByName(own.select(*keys, "v"))))


def _judged(level: DataFrame, below: DataFrame | None) -> DataFrame:
    """The pairs of a level with ``valid`` and, where it matters, the children that they evaluate."""
    out = ["row", "schema_id", "path", "node", "up", "parent", "via", "up_tracked"]
    nothing = F.array().cast("array<string>").alias("evaluated")
    leaves = level.where("not onward").select(*out, F.col("own").alias("valid"), nothing)
    via, valid, tracked = F.col("via"), F.col("valid"), F.col("up_tracked")
    child = via.isin("properties", "patternProperties", "additionalProperties", "at", "rest")
    through = (child | (via.isin(*_UNEVALUATED)) | ((via == "contains") & valid)) & tracked
    passed = via.isin(*_SAME) & (via != "not") & valid & tracked
    of = lambda k, f=F.max: f(F.when(via == k, valid))
    if below is None:  # no pair has a child
        return leaves
    folded = below.groupBy("row", F.col("up").alias("path"), "schema_id", F.col("parent").alias("node")).agg(
        F.min(F.when(via.isin(*_ALL), valid)).alias("all"),
        of("anyOf").alias("any"),
        F.count_if((via == "oneOf") & valid).alias("one"),
        F.count_if(via == "oneOf").alias("ones"),
        of("not").alias("not"),
        of("if").alias("if"),
        of("then").alias("then"),
        of("else").alias("else"),
        F.count_if((via == "contains") & valid).alias("contains"),
        F.collect_set(F.when(through & ~via.isin(*_UNEVALUATED), F.col("path"))).alias("through"),
        F.collect_list(F.when(passed, F.struct("via", "evaluated"))).alias("passed"),
        F.collect_list(F.when(via.isin(*_UNEVALUATED), F.struct("path", "valid"))).alias("left"),
    )
    both = level.where("onward").join(folded, ["row", "path", "schema_id", "node"], "left")
    # Of a condition, what the branch taken evaluates counts, and the condition's own only where it holds.
    taken = F.filter("passed", lambda p: (p["via"] != "then") | F.col("if"))
    taken = F.filter(taken, lambda p: (p["via"] != "else") | ~F.col("if"))
    seen = F.array_union(F.coalesce("through", F.array()), F.coalesce(F.flatten(F.transform(taken, lambda p: p["evaluated"])), F.array()))
    both = both.withColumn("seen", seen)
    rest = F.filter("left", lambda x: ~F.array_contains("seen", x["path"]))
    counted = F.coalesce("contains", F.lit(0))
    verdict = (
        F.col("own")
        & F.coalesce("all", F.lit(True))
        & F.coalesce("any", F.lit(True))
        & ((F.coalesce("ones", F.lit(0)) == 0) | (F.col("one") == 1))
        & ~F.coalesce("not", F.lit(False))
        & F.when(F.col("if"), F.coalesce("then", F.lit(True))).otherwise(F.col("if").isNull() | F.coalesce("else", F.lit(True)))
        & (~F.col("has_contains") | ~F.col("is_array") | counted.between(F.col("least"), F.col("most")))
        & F.coalesce(F.forall(rest, lambda x: x["valid"]), F.lit(True))
    )
    evaluated = F.array_union("seen", F.coalesce(F.transform("left", lambda x: x["path"]), F.array()))
    both = both.select(*out, verdict.alias("valid"), F.when(F.col("tracked"), evaluated).otherwise(F.array()).alias("evaluated"))
    return leaves.unionByName(both)


def validate(instances: DataFrame, schemas: DataFrame, row: str, schema_id: str, instance: str = "instance", schema: str = "schema") -> DataFrame:
    """(row, reason): why an instance fails, null where it keeps its schema.

    ``instances`` has (row, schema_id, instance) rows with unique ids, ``schemas`` (schema_id, schema); both texts are
    JSON. Reasons, in this order: ``missing_schema``, the schema's own (``invalid_schema``, ``unsupported_schema_dialect``,
    ``unsupported_schema_reference``, ``unsupported_schema_keyword``, ``nested_schema_dialect``), ``invalid_instance`` for
    a text that is no JSON or null, and ``schema_violation``. Of several texts under one schema id the least counts.

    Numbers are compared as doubles, multiples as decimals of 12 places where they fit; whole floats are integers, and
    booleans equal no number. Lengths count code points. Patterns are Java's. An empty table gives an empty result;
    further columns are ignored, whatever their names.
    """
    of = schemas.schema[schema_id].dataType.simpleString()
    made, size, depth = compiled(schemas, schema_id, schema)
    small = F.broadcast if size <= SMALL_NODES else (lambda df: df)
    rows = instances.select(F.col(row).alias("row"), F.col(schema_id).cast(of).alias("schema_id"), F.col(instance).cast("string").alias("text"))
    rows = rows.join(small(made.select("schema_id", "reason", (F.col("depth") > IN_ROW).alias("deep"))), "schema_id", "left")
    rows = rows.withColumn("reason", F.when(F.col("deep").isNull(), "missing_schema").otherwise(F.col("reason")))
    failed = lambda valid: F.when(F.col("reason").isNull() & valid.isNull(), "invalid_instance").when(~valid, "schema_violation")
    # Only the text goes to Python and only the nodes of a row's own schema come to it, after that.
    here = rows.where("deep is not true").select("row", "schema_id", "reason", value_trees(F.array(F.when(F.col("reason").isNull(), F.col("text")))).alias("trees"))
    here = here.join(small(made.where(F.col("depth") <= IN_ROW).select("schema_id", "nodes")), "schema_id", "left")
    here = here.select("row", "reason", keeps(F.get("trees", F.lit(0)), F.col("nodes"), min(depth, IN_ROW)).alias("valid"))
    out = here.select(F.col("row").alias(row), F.coalesce("reason", failed(F.col("valid"))).alias("reason"))
    if depth <= IN_ROW:
        return out
    rows = rows.where("deep")
    valid = _in_rounds(rows, made.where(F.col("depth") > IN_ROW).select("schema_id", F.inline("nodes")), small)
    return out.unionByName(rows.join(valid, "row", "left").select(F.col("row").alias(row), F.coalesce("reason", failed(F.col("valid"))).alias("reason")))


def _in_rounds(rows: DataFrame, nodes: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(row, valid) of (row, schema_id, text) rows whose text is JSON, by rounds of joins."""
    kind, of = (rows.schema[c].dataType.simpleString() for c in ("row", "schema_id"))
    nodes = cut(nodes)
    values = cut(rows.select("row", "schema_id", "text").mapInArrow(_flattened, f"row {kind}, schema_id {of}, {_VALUE}"))
    below = None
    for level in reversed(_expanded(values, nodes, small)):
        below = cut(_judged(level, below))
    return below.select("row", "valid")
