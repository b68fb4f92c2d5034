"""Scalar functions over keys, labels, options and distributions, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def request_key(text: Column) -> Column:
    """Digest of the text with runs of white space collapsed, case kept."""
    return F.sha2(F.concat(F.lit('"'), F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit('"')), 256)


def state_key(text: Column) -> Column:
    """Lower-cased words joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def canonical_label(label: Column) -> Column:
    """Trimmed, lower-cased, without final periods."""
    return F.regexp_replace(F.lower(F.trim(label)), r"\.+$", "")


def command_template(command: Column) -> Column:
    """Quoted strings become S, numbers N."""
    return F.regexp_replace(F.regexp_replace(command, r"'[^']*'|\"[^\"]*\"", "S"), r"\d+(\.\d+)?", "N")


def finite_or_null(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def rotated(options: Column, shift: Column) -> Column:
    """The array rotated left by ``shift`` places."""
    n = F.size(options)
    k = F.pmod(shift, F.greatest(n, F.lit(1)))
    return F.concat(F.slice(options, k + 1, n), F.slice(options, F.lit(1), k))


def hash_ordered(options: Column, seed: Column) -> Column:
    """A reproducible shuffle: the elements by their seeded digest."""
    keyed = F.transform(options, lambda o: F.struct(F.sha2(F.concat_ws(":", seed, o), 256).alias("h"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x["o"])


def valid_menu(options: Column, low: int = 2, high: int = 36) -> Column:
    """Whether the options are distinct, without null, and ``low`` to ``high`` in number."""
    return F.size(options).between(low, high) & (F.size(F.array_distinct(options)) == F.size(options)) & F.forall(options, lambda o: o.isNotNull())


def valid_distribution(p: Column, tolerance: float = 1e-6) -> Column:
    """Whether all entries are finite and in [0, 1] and add up to one."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0, 1)) & (F.abs(total - 1) <= tolerance)


def entropy(p: Column) -> Column:
    """-sum p ln p, with 0 ln 0 = 0."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def expected_brier(forecast: Column, probability: Column) -> Column:
    """Expected squared error of a forecast of an event that has this probability."""
    return probability * F.pow(1 - forecast, 2) + (1 - probability) * F.pow(forecast, 2)


def total_variation(p: Column, q: Column) -> Column:
    """Half the sum of absolute differences."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / 2


def canonical_board(cells: Column, side: int) -> Column:
    """The least of the eight symmetric forms of a square board given row by row."""
    rows = range(side)
    turns = [
        lambda r, c: (r, c), lambda r, c: (c, side - 1 - r), lambda r, c: (side - 1 - r, side - 1 - c), lambda r, c: (side - 1 - c, r),
        lambda r, c: (r, side - 1 - c), lambda r, c: (side - 1 - c, side - 1 - r), lambda r, c: (side - 1 - r, c), lambda r, c: (c, r),
    ]
    forms = [F.array(*[F.get(cells, F.lit(a * side + b)) for r in rows for c in rows for a, b in [turn(r, c)]]) for turn in turns]
    return F.array_min(F.array(*forms))


def days_back(goal: Column) -> Column:
    """Days before today that a goal names: 0 for today, 1 for yesterday, n for "last n days"; null for none."""
    n = F.regexp_extract(goal, r"(?i)\blast (\d+) days\b", 1)
    return F.when(n != "", n.cast("int")).when(goal.rlike(r"(?i)\byesterday\b"), 1).when(goal.rlike(r"(?i)\btoday\b"), 0)


def first_reason(**checks: Column) -> Column:
    """The name of the first check that fails (is true), in the order given; null where none does. Null fails nothing."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in checks.items()], F.lit(None).cast("string"))


def option_description(label: Column) -> Column:
    """A lone capital letter, which means nothing by itself, is described as a mark in the state; others stay."""
    mark = F.regexp_replace(label, r"\.$", "")
    return F.when(label.rlike(r"^[A-Z]\.?$"), F.concat(F.lit("The answer marked "), mark, F.lit(" in the supplied state"))).otherwise(label)


def prefix_slice(name: Column, **prefixes: str) -> Column:
    """The first slice whose regular expression the beginning of the name matches, else ``other``."""
    return F.coalesce(*[F.when(name.rlike(f"^(?:{p})"), F.lit(k)) for k, p in prefixes.items()], F.lit("other"))


def source_keys(value: Column) -> Column:
    """The distinct keys of a field that may name several sources: split, lower-cased, other characters to ``_``."""
    parts = F.transform(F.split(value, r"\s+and\s+|[,;/+]|\s"), lambda x: F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"))
    return F.array_distinct(F.filter(parts, lambda x: x.rlike("[a-z0-9]")))


def word_fingerprint(text: Column) -> Column:
    """Digest of the lower-cased runs of letters, digits and underscores, joined by single blanks; of '' for null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.sha2(F.array_join(words, " "), 256)


def canonical_object(**fields: Column) -> Column:
    """Compact JSON of string and integer fields in the order of their names; null fields are written as null."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(quoted(fields[k]), F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def visible(items: Column, mask: Column) -> Column:
    """The items whose bit (the first item has the lowest) is set in ``mask``."""
    return F.filter(items, lambda x, i: F.floor(mask / F.pow(F.lit(2), i)) % 2 == 1)


def two_sensor_posterior(prior: Column, hit: Column, false_alarm: Column, reports: Column) -> Column:
    """P(event) after independent reports (an array of booleans); null when the evidence is impossible."""
    chance = lambda p: F.aggregate(reports, F.lit(1.0), lambda a, r: a * F.when(r, p).otherwise(1 - p))
    yes, no = prior * chance(hit), (1 - prior) * chance(false_alarm)
    return F.when(yes + no > 0, yes / (yes + no))


def expected_utility(outcomes: Column, utilities: Column, cost: Column) -> Column:
    """Sum of probability times utility over aligned arrays, less the expected cost."""
    return F.aggregate(F.zip_with(outcomes, utilities, lambda p, u: p * u), F.lit(0.0), lambda a, x: a + x) - cost
