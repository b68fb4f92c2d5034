"""Periodic runs of words in whole texts, by a suffix automaton with merged end-position sets.

A run is a stretch of words that repeats with its smallest period q, several times over, and that no neighbouring word
extends. Every state of a text's suffix automaton stands for phrases with the same end positions. The sets are ordered
and merged from the longest states up, each smaller set into the larger; where two positions become neighbours at
distance q, and the state's length is at least q, they seed a square of period q. The state's length is then all that
their prefixes share, so it extends the square to the left as far as it goes, and the last square of a start and period
to the right.

Each text is worked on where it lies: nothing shuffles. In a run of exponent e every word occurs e times, so words that
occur less often part a text into stretches, again and again, and only what is left gets an automaton.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import pieces

MIN_WORDS = 6  # words of a run, at least
MIN_EXPONENT = 4  # times that a run holds its period, at least
WORD = r"[^\x20\x09-\x0D]+"

Run = tuple[int, int, int]  # start, length, period


def suffix_automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, end) of each state; ``end`` is the position that a state adds itself, -1 for a copied one."""
    follow: list[dict[int, int]] = [{}]
    length, link, end = [0], [-1], [-1]
    last = 0
    for at, symbol in enumerate(symbols):
        new = len(length)
        follow.append({})
        length.append(length[last] + 1)
        end.append(at)
        state = last
        while state >= 0 and symbol not in follow[state]:
            follow[state][symbol] = new
            state = link[state]
        if state < 0:
            link.append(0)
        else:
            after = follow[state][symbol]
            if length[after] == length[state] + 1:
                link.append(after)
            else:
                copy = len(length)
                link.append(copy)
                follow.append(dict(follow[after]))
                length.append(length[state] + 1)
                link.append(link[after])
                end.append(-1)
                link[after] = copy
                while state >= 0 and follow[state].get(symbol) == after:
                    follow[state][symbol] = copy
                    state = link[state]
        last = new
    return length, link, end


def squares(symbols: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) -> last position, of every maximal stretch that holds its smallest period twice or more."""
    length, link, end = suffix_automaton(symbols)
    #: Negated, so that what joins a longer set, most often an earlier position, is appended.
    ends: list[list[int] | None] = [[-x] if x >= 0 else None for x in end]
    met: dict[int, list[tuple[int, int]]] = {}
    found: dict[tuple[int, int], int] = {}
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        large, reach = ends[state], length[state]
        for later, earlier in met.pop(state, ()):
            # Neighbours no more, if a third set came between: their stretch then has a smaller period.
            if large[bisect_right(large, later)] == earlier:
                key = 1 - earlier - reach, earlier - later
                if found.get(key, -1) < -later:
                    found[key] = -later
        up = link[state]
        ends[state] = None
        if not up:
            continue
        small, reach = ends[up], length[up]
        if small is None:
            ends[up] = large
            continue
        if len(small) > len(large):
            small, large = large, small
        pairs = met.setdefault(up, [])
        # Neighbours are those of the other set as it was: two of one set have met in a longer state.
        places = [bisect_left(large, x) for x in small]
        for x, at in zip(small, places, strict=True):
            if at < len(large) and large[at] - x <= reach:
                pairs.append((x, large[at]))
            if at and x - large[at - 1] <= reach:
                pairs.append((large[at - 1], x))
        for gone, (x, at) in enumerate(zip(small, places, strict=True)):
            large.insert(at + gone, x)
        ends[up] = large
    return found


def _stretches(symbols: np.ndarray, base: int, words: int, times: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, symbols) of the stretches that can hold runs: all their words occur ``times`` in the stretch they come from."""
    open_ = [(base, symbols)]
    while open_:
        base, symbols = open_.pop()
        if len(symbols) < words:
            continue
        _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[inverse] < times)
        if not len(rare):
            yield base, symbols
            continue
        parts = list(zip([0, *(rare + 1).tolist()], [*rare.tolist(), len(symbols)], strict=True))
        parts = [(a, b) for a, b in parts if b - a >= words]
        if 2 * sum(b - a for a, b in parts) > len(symbols):  # parting again would not pay
            yield from ((base + a, symbols[a:b]) for a, b in parts)
        else:
            open_ += [(base + a, symbols[a:b]) for a, b in parts]


def find_runs(words: list, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """Runs of a sequence of words by start, then period; ``min_exponent`` is 2 at least."""
    if len(words) < min_words:
        return []
    seen: dict = {}
    symbols = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    runs = []
    for base, part in _stretches(symbols, 0, max(min_words, min_exponent), min_exponent):
        for (start, period), last in squares(part.tolist()).items():
            length = last - start + 1
            if length >= max(min_words, min_exponent * period):
                runs.append((base + start, length, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _runs_of(batches: Iterator[pa.RecordBatch], words: int, exponent: int) -> Iterator[pa.RecordBatch]:
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for piece in pieces(batch, 1):
            sizes, found, kept = [], [], []
            for text in piece.column(1).to_pylist():
                # Splitting bytes cuts at the blank and the five controls only, as the words are defined.
                split = (text or "").encode().split()
                runs = find_runs(split, words, exponent)
                if runs:
                    keep = np.ones(len(split), bool)
                    for start, length, period in runs:
                        keep[start + period : start + length] = False
                    kept.append(b" ".join([split[i] for i in np.flatnonzero(keep).tolist()]))
                else:
                    kept.append(b" ".join(split))
                sizes.append(len(split))
                found.append([{"start": a, "length": b, "period": c} for a, b, c in runs])
            yield pa.record_batch(
                [piece.column(0), pa.array(sizes, pa.int64()), pa.array(found, run), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (array of start, length, period), collapsed.

    Words are what blanks, tabs and line ends part, and count from 0. ``runs`` holds, by start and period, every stretch
    of at least ``min_words`` words and ``min_exponent`` times its smallest period that no neighbouring word extends.
    ``collapsed`` is the text of the words outside runs and of each run's first period, joined by one blank; a word that
    one run drops is dropped.

    A null or empty text has no words and no runs, and an empty ``collapsed``. Repeated rows and null ids are kept as
    they are; an empty table gives an empty result; further columns are ignored, whatever their names. A text is one
    task's work: some 0.5 kB for each word of its stretches, however long the text.
    """
    if min_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(lambda batches: _runs_of(batches, min_words, min_exponent), schema)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, also where a lambda uses it for each entry."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_repeated_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text), where one text in ten repeats a part of its own from some word on.

    With h the CRC-32 of the decimal id and g a tenth of it, texts of h % 10 = 0 and n > 0 words get words i >= a = g % n
    from place a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8) in whole numbers. Other texts, null ones and those of null
    ids stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(words, place(i))), " "))

    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    edited = F.when(h % 10 == 0, _bind(words, repeat))
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(edited, F.col(text)).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Digest columns of ``periodic_runs``: the run of greatest exponent, every run and the collapsed text.

    Exponents are compared exactly, as products of whole numbers: ties go to the smallest start, then period. Without
    a run the four columns of the best one are null.
    """
    none = F.expr("cast(null as struct<start: long, length: long, period: long>)")
    higher = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", none, lambda a, b: F.when(a.isNull() | higher(b, a), b).otherwise(a))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
