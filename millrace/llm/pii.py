"""Personal data by bootstrapped contextual extraction.

Fixed formats give the seed entities: e-mail, IP, card, phone, and keys written as lower-case hexadecimal digests
(``secret``). One pass over the texts also collects every other identifier-shaped stretch (an ``@``, four digits or more
in a word, or seven in up to four words of digits) with its lexical patterns: the two words before it, the words around
it, and its own form (its digits and letters masked). Spark then scores the graph of patterns and instances in rounds.
A pattern's confidence in a kind compares its instances that belong to the kind with those that speak against it:
instances of another kind, instances that fail the kind's own check, and unknown ones of a form that the kind does not
have. The instances of trusted patterns become labels of the next round, until nothing is added. Occurrences of the
instances discovered add spans; spans of the fixed formats always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import pieces
from millrace.runtime import cut

KINDS = ("email", "ip", "card", "phone")  # the fixed formats of the base
ALL_KINDS = (*KINDS, "secret")
MIN_CONFIDENCE = 0.8
MIN_SUPPORT = 3  # distinct labelled instances that a pattern must have
DOUBT = 0.5  # instances against a pattern that are always reckoned with
NEAR_CHARS = 32  # of a context word, the characters nearest to the instance that belong to a pattern

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins within a run of digits: if it could, it would have begun with the run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SHAPE = re.compile(r"[0-9@]|[0-9a-f]{32}")
_WORD = re.compile(r"\S+")
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])")
_NUMERIC = re.compile(r"[0-9()+./-]*[0-9][0-9()+./-]*")
_MIXED = re.compile(r"[0-9a-z]*(?:[0-9][a-z]|[a-z][0-9])[0-9a-z]*")
_LETTER = re.compile(r"[^\W\d_]")
_QUOTES = "\"'[]{}<>"  # stripped before an instance; brackets and signs may belong to it
_EDGE = "\"'.,;:!?()[]{}<>*#%&$|="
_DIGIT = re.compile(r"[0-9]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Whether the check digit of a string of decimal digits is right."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches found from each ``@`` outwards, which is linear in the text however long its words are."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed formats, by kind as listed and then by start."""
    out = []
    if "@" in text:
        out += [("email", *span) for span in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` of each span, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secrets(text: str) -> list[tuple[int, int]]:
    """Spans of the seeds of kind ``secret``: 32, 40 or 64 hexadecimal digits, letters and decimal digits among them."""
    return [m.span() for m in _SECRET.finditer(text) if _DIGIT.search(m[0]) and re.search("[a-f]", m[0])]


def form(instance: str) -> str:
    """The form of a lower-case instance: digits and letters masked, mixed runs by their length."""
    return _LETTER.sub("a", _DIGIT.sub("0", _MIXED.sub(lambda m: f"<{len(m[0])}>", instance)))


def failed(instance: str) -> str | None:
    """The kind whose format the whole instance has without passing the kind's check."""
    if (m := _IP.match(instance)) and m.end() == len(instance):
        return None if any(k == "ip" for k, *_ in base_spans(instance)) else "ip"
    if (m := _CARD.match(instance)) and m.end() == len(instance) and 16 <= len(d := _digits(instance)) <= 19:
        return None if luhn(d) else "card"
    return None


def _masked(word: str) -> str:
    return _DIGIT.sub("0", word.lower())


class _Context:
    """The words of a text, each with the number of its line."""

    def __init__(self, text: str):
        self.text = text
        self.words = [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.words]

    def _same_line(self, a: int, b: int) -> bool:
        return self.text.find("\n", a, b) < 0

    def patterns(self, start: int, end: int, shape: str) -> list[str]:
        """The lexical patterns of an occurrence; its line alone counts as context."""
        text, words = self.text, self.words
        before, at, i = [], start, bisect_right(self.starts, start) - 1
        while len(before) < 2 and i >= 0:
            a, b = words[i]
            b = min(b, at)
            if a < b:
                if not self._same_line(b, at):
                    break
                if word := _masked(text[max(a, b - NEAR_CHARS) : b]).strip(_QUOTES):
                    before.insert(0, word)
                at = a
            i -= 1
        after, i = [], bisect_right(self.starts, end - 1) - 1
        for a, b in words[i : i + 2]:
            a = max(a, end)
            if a < b and self._same_line(end, a) and (word := _masked(text[a : min(b, a + NEAR_CHARS)]).strip(_EDGE)):
                after.append(word)
                break
        out = [f"= {shape}"]
        if len(before) == 2:
            out.append(" ".join(before) + " _")
        if before and after:
            out.append(f"{before[-1]} _ {after[0]}")
        return out


def _candidates(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches shaped like an identifier: single words, and up to four neighbouring words of digits on a line."""
    run: list[tuple[int, int]] = []  # words of digits that follow each other
    for a, b in words:
        if not _SHAPE.search(text, a, b) and not (b - a >= 32 and _DIGIT.search(text, a, b)):
            run = []
            continue
        left, right = a, b
        while left < right and text[left] in _QUOTES:
            left += 1
        while left < right and text[right - 1] in _EDGE:
            right -= 1
        word = text[left:right]
        inner = word.strip("()")
        if "@" in word or len(_digits(word)) >= 4:
            x = left + (len(word) - len(word.lstrip("()")))
            yield x, x + len(inner)
        if not _NUMERIC.fullmatch(word):
            run = []
            continue
        if run and (text.find("\n", run[-1][1], left) >= 0 or left - run[-1][1] > 2):
            run = []
        run = [*run[-3:], (left, right)]
        for first, _ in run[:-1]:
            if len(_digits(text[first:right])) >= 7:
                yield first, right


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds (with their kind) and other identifier-shaped stretches (kind is null) with their patterns."""
    context = _Context(text)
    taken = sorted([*base, *(("secret", a, b) for a, b in secrets(text) if not any(x < b and a < y for _, x, y in base))], key=lambda x: x[1])
    ends = sorted(b for _, _, b in taken)
    begins = [a for _, a, _ in taken]
    spans = {(a, b): k for k, a, b in reversed(taken)}
    for a, b in _candidates(text, context.words):
        # free of seeds: as many of them have ended before it as have begun before its end
        if a < b and bisect_right(ends, a) == bisect_right(begins, b - 1):
            spans.setdefault((a, b), None)
    out = []
    for (a, b), kind in sorted(spans.items()):
        instance = text[a:b].lower()
        shape = form(instance)
        out.append(
            {"start": a, "end": b, "instance": instance, "kind": kind, "form": shape, "failed": failed(instance), "patterns": context.patterns(a, b, shape)}
        )
    return out


_FOUND = (
    "text_key string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "found array<struct<start:int,end:int,instance:string,kind:string,form:string,failed:string,patterns:array<string>>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.struct(
        [
            ("start", pa.int32()),
            ("end", pa.int32()),
            ("instance", pa.string()),
            ("kind", pa.string()),
            ("form", pa.string()),
            ("failed", pa.string()),
            ("patterns", pa.list_(pa.string())),
        ]
    )
    for batch in batches:
        for piece in pieces(batch, 1):
            texts = [x or "" for x in piece.column(1).to_pylist()]
            spans = [base_spans(x) for x in texts]
            plain = [joined(x) for x in spans]
            counts = {f"n_{k}": pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in KINDS}
            yield pa.record_batch(
                {
                    "doc_id": piece.column(0),
                    "text_key": pa.array([xxhash.xxh3_128_hexdigest(x) for x in texts], pa.string()),
                    **counts,
                    "base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in plain], pa.string()),
                    "base": pa.array(plain, pa.string()),
                    "found": pa.array(
                        [occurrences(t, s) if s or _SHAPE.search(t) else [] for t, s in zip(texts, spans, strict=True)],
                        pa.list_(kinds),
                    ),
                }
            )


def bootstrap(
    edges: DataFrame,
    facts: DataFrame,
    seeds: DataFrame,
    min_confidence: float = MIN_CONFIDENCE,
    min_support: int = MIN_SUPPORT,
) -> DataFrame:
    """(instance, kind, score) of the instances discovered.

    ``edges`` are distinct (pattern, instance) rows, ``facts`` has a row (instance, form, failed) an instance, ``seeds``
    distinct (instance, kind) rows. A pattern's confidence in a kind is s / (s + against + DOUBT): s adds up the scores of
    its labelled instances, ``against`` counts its other instances but for unlabelled ones of a form that the kind has.
    An instance's score combines the confidences of its trusted patterns; it never gets a kind whose check it failed.
    Only aggregates and edges travel; no pattern or instance is gathered in one place. Rounds end when the discovered
    instances with their kinds are none, or those of an earlier round.
    """
    sizes = cut(edges.groupBy("pattern").agg(F.count("*").alias("size")))
    own = cut(seeds.select("instance", "kind", F.lit(1.0).alias("score")))
    seeded = seeds.select("instance").distinct()
    seen, found, labels = set(), None, own
    while True:
        forms = labels.join(facts, "instance").select("kind", "form").distinct()
        open_ones = facts.join(labels.select("instance").distinct(), "instance", "left_anti").join(forms, "form")
        open_ones = open_ones.where("failed is null or failed <> kind").select("instance", "kind")
        status = cut(
            labels.select("instance", "kind", "score", F.lit(1).alias("held"), F.lit(0).alias("open")).unionByName(
                open_ones.select("instance", "kind", F.lit(0.0).alias("score"), F.lit(0).alias("held"), F.lit(1).alias("open"))
            )
        )
        hits = edges.join(status, "instance").groupBy("pattern", "kind").agg(
            F.sum("score").alias("hits"), F.sum("held").alias("held"), F.sum("open").alias("open")
        )
        against = F.col("size") - F.col("held") - F.col("open")
        trusted = cut(
            hits.where(F.col("held") >= min_support)
            .join(sizes, "pattern")
            .withColumn("confidence", F.col("hits") / (F.col("hits") + against + DOUBT))
            .where(F.col("confidence") >= min_confidence)
            .select("pattern", "kind", "confidence")
        )
        scored = (
            edges.join(trusted, "pattern")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
            .join(seeded, "instance", "left_anti")
            .join(facts.select("instance", "failed"), "instance")
            .where("failed is null or failed <> kind")
        )
        best = F.max(F.struct("score", "kind")).alias("best")  # ties: the kind that sorts last
        found = cut(scored.groupBy("instance").agg(best).select("instance", "best.kind", "best.score"))
        mark = found.agg(F.count("*"), F.sum(F.xxhash64("instance", "kind").cast("decimal(38,0)"))).first()
        if not mark[0] or mark in seen:
            break
        seen.add(mark)
        labels = own.unionByName(found)
    return found


def find_personal_data(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_confidence: float = MIN_CONFIDENCE,
    min_support: int = MIN_SUPPORT,
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, added of every whole text.

    Counts and digest are of the fixed formats of the base; ``spans`` lists these, the seeds of kind ``secret`` and the
    ``added`` ones that the method discovered (``kind:start:end`` in code points, end exclusive, by kind and start), of
    discovered ones that overlap the leftmost and then longest; ``n_spans`` counts all. Null texts count as empty; rows
    with the same id and text are alike; a row is returned for each, an empty table gives none. Other columns are
    ignored, whatever their names.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    scanned = cut(rows.mapInArrow(_scan, f"doc_id {kind}, {_FOUND}"))
    each = scanned.where(F.size("found") > 0).select("doc_id", "text_key", F.explode("found").alias("o"))
    edges = cut(each.select(F.explode("o.patterns").alias("pattern"), F.col("o.instance").alias("instance")).distinct())
    facts = cut(each.select("o.instance", "o.form", "o.failed").distinct())
    seeds = cut(each.where("o.kind is not null").select("o.instance", "o.kind").distinct())
    found = bootstrap(edges, facts, seeds, min_confidence, min_support)
    span = lambda k, o: F.struct(k.alias("kind"), o["start"].alias("start"), o["end"].alias("end"))
    new = (
        each.where("o.kind is null")
        .select("doc_id", "text_key", "o.start", "o.end", "o.instance")
        .join(found, "instance")
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("back"), "kind"))).alias("all"))
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "all")
    )  # at most the occurrences of one document
    start = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    apart = F.aggregate(
        F.coalesce("all", F.array().cast("array<struct<start:int,back:int,kind:string>>")),
        start,
        lambda a, x: F.when(
            (F.size(a) == 0) | (F.try_element_at(a, F.lit(-1))["end"] <= x["start"]),
            F.array_append(a, F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["back"]).alias("end"))),
        ).otherwise(a),
    )
    plain = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256"]
    others = F.exists("found", lambda o: ~F.coalesce(o["kind"], F.lit("")).isin(*KINDS))
    base_only = F.when(F.col("base") == "", 0).otherwise(F.size(F.split("base", ","))).cast("long")
    nothing = F.lit(0).cast("long")
    done = scanned.where(~others).select(*plain, F.col("base").alias("spans"), base_only.alias("n_spans"), nothing.alias("added"))
    order = F.create_map(*[x for i, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(i))])
    seeds_here = F.transform(F.filter("found", lambda o: o["kind"].isNotNull()), lambda o: span(o["kind"], o))
    merged = F.array_sort(
        F.transform(
            F.concat(seeds_here, "apart"),
            lambda o: F.struct(order[o["kind"]].alias("rank"), o["start"].alias("start"), o["end"].alias("end"), o["kind"].alias("kind")),
        )
    )
    shown = F.array_join(F.transform("merged", lambda o: F.concat_ws(":", o["kind"], o["start"], o["end"])), ",")
    other = (
        scanned.where(others)
        .join(new, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
        .withColumn("apart", apart)
        .withColumn("merged", merged)
        .select(*plain, shown.alias("spans"), F.size("merged").cast("long").alias("n_spans"), F.size("apart").cast("long").alias("added"))
    )
    return done.unionByName(other)
