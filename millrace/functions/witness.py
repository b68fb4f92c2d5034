"""Values that a text or JSON holds or implies: leaves, domains, derived times and paths, amounts, reduced ratios."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAVES = "path string, value string, kind string"


def _leaves(value, path: str) -> Iterator[tuple[str, str | None, str]]:
    """Leaves in order of appearance, on a stack: nesting may be deep."""
    stack = [(path, value)]
    while stack:
        at, x = stack.pop()
        if isinstance(x, dict):
            stack += [(f"{at}.{k}", v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            stack += [(f"{at}[{i}]", v) for i, v in reversed(list(enumerate(x)))]
        elif x is None or isinstance(x, bool):
            yield at, None if x is None else str(x).lower(), "null" if x is None else "boolean"
        else:
            yield at, str(x), "string" if isinstance(x, str) else "number"


def json_leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value, kind) of every leaf of a JSON text; null or invalid JSON and empty containers have none."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for k, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    value = json.loads(content) if content is not None else {}
                except (ValueError, RecursionError):
                    continue
                for leaf in _leaves(value, "$"):
                    for column, x in zip(out, (k, *leaf), strict=True):
                        column.append(x)
            yield pa.record_batch([pa.array(out[0], batch.schema.field(0).type), *(pa.array(x, pa.string()) for x in out[1:])], ["key", "path", "value", "kind"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text).cast("string")).mapInArrow(walk, f"key {kind}, {LEAVES}").withColumnRenamed("key", key)


def documented_values(description: Column) -> Column:
    """Values of a sort parameter: each attribute named after "Valid attributes:", bare and with + and -; else empty."""
    listed = F.regexp_extract(F.coalesce(description, F.lit("")), r"Valid attributes:\s*([^.]+)\.", 1)
    names = F.filter(F.transform(F.split(listed, r",\s*|\s+and\s+"), F.trim), lambda x: x.rlike(r"^[a-z_]+$"))
    return F.flatten(F.transform(names, lambda x: F.array(x, F.concat(F.lit("+"), x), F.concat(F.lit("-"), x))))


def shifted_times(clock: Column, minutes: Column) -> Column:
    """HH:MM before and after the minutes, round the clock; null unless the clock reads HH:MM."""
    read = F.when(clock.rlike(r"^\d\d:\d\d$"), F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 4, 2).cast("int"))
    shown = lambda t: F.concat(F.lpad((F.floor(t / 60)).cast("string"), 2, "0"), F.lit(":"), F.lpad((t % 60).cast("string"), 2, "0"))
    return F.when(read.isNotNull(), F.array(*[shown(F.pmod(read + sign * minutes, F.lit(1440))) for sign in (-1, 1)]))


def derived_paths(root: Column, names: Column, archive: Column) -> Column:
    """The root without final slashes, joined with each name, each with ``.zip`` too where ``archive`` holds."""
    bare = F.regexp_replace(root, "/+$", "")
    paths = F.concat(F.array(bare), F.transform(names, lambda x: F.concat_ws("/", bare, x)))
    zipped = F.transform(paths, lambda x: F.concat(x, F.lit(".zip")))
    return F.array_distinct(F.when(archive, F.concat(paths, zipped)).otherwise(paths))


def amount_witness(text: Column, amount: Column) -> Column:
    """The first literal ``$1,234.50`` in the text that equals the decimal amount; null where none does."""
    literals = F.regexp_extract_all(text, F.lit(r"(\$[0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
    number = lambda x: F.regexp_replace(x, "[$,]", "").try_cast("decimal(38,6)")
    return F.get(F.filter(literals, lambda x: number(x) == amount), F.lit(0))


def reduced(numerator: Column, denominator: Column) -> Column:
    """(num, den) in lowest terms with a positive denominator; null for a zero denominator.

    Euclid's steps on 64-bit numbers end within 92, the length of the fold.
    """
    a, b = F.abs(numerator.cast("long")), F.abs(denominator.cast("long"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), step)["a"]
    exact = lambda x, g: F.call_function("div", x.cast("long") * F.when(denominator < 0, -1).otherwise(1), g)
    out = lambda g: F.struct(exact(numerator, g).alias("num"), exact(denominator, g).alias("den"))
    return F.when(denominator != 0, F.get(F.transform(F.array(gcd), out), F.lit(0)))
