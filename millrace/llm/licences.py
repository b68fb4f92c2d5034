"""Licence phrases and notices in whole texts, by a positional index of rare licence words.

The templates' words form an index: word -> (template, position). A first pass counts over all documents in how many of
them each of these words occurs. The second looks up, for each file and template, the licence words of highest inverse
document frequency that the file holds, and intersects their postings by relative position: file position less template
position is the same for words of one copy, up to a few words put in or left out. Where enough of them agree, the
template's mandatory phrases are looked up in that stretch word for word.

The base phrases are templates that are mandatory as a whole, found the same way: by the rarest word's postings, the
other words at their places after and before it.

Two numbers a licence word travel to the tasks (a few hundred words, whatever the corpus); no text shuffles.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import pieces

ANCHORS = 6  # words of a template that are looked up in a file, rarest first
SLACK = 3  # words by which the places of one copy's words may differ

# The phrases whose every place counts, and their labels.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

# Label, text of a notice, and the phrases without which it is not that notice.
NOTICES = (
    ("agpl-3.0", "GNU Affero General Public License, version 3", ("affero general public license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        ("except in compliance with the license", "apache org licenses license 2 0"),
    ),
    ("bsd", "Released under the BSD License", ("bsd license",)),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", ("cc by nc nd 4 0",)),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    ("cc0-1.0", "Licensed under CC0 1.0 Universal", ("cc0 1 0",)),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        ("gnu general public license", "free software foundation"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("for any purpose with or without fee is hereby granted",),
    ),
    ("lgpl", "GNU Lesser General Public License", ("lesser general public license",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: Every byte as the words see it: A-Z lower-cased, letters, digits and all of UTF-8 beyond ASCII kept, the rest blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters that are no ASCII but 0-9 and letters, A-Z lower-cased, in UTF-8."""
    return (text or "").encode().translate(_BYTES).split()


@dataclass(frozen=True)
class Template:
    """A text to find. Without ``required`` phrases, it is one as a whole."""

    label: str
    words: tuple[bytes, ...]
    required: tuple[tuple[bytes, ...], ...]
    base: bool

    @property
    def needed(self) -> frozenset[bytes]:
        """Words without which a file cannot hold the template."""
        return frozenset(w for phrase in self.required for w in phrase)


def templates(phrases=PHRASES, notices=NOTICES) -> list[Template]:
    """Base phrases, then notices. A phrase or notice without a word is refused."""
    made = [Template(label, tuple(words_of(x)), (tuple(words_of(x)),), True) for label, x in phrases]
    made += [Template(label, tuple(words_of(x)), tuple(tuple(words_of(p)) for p in required), False) for label, x, required in notices]
    if not all(t.words and t.required and all(t.required) for t in made):
        raise ValueError("a template needs words and mandatory phrases")
    return made


def _rarest(words, rarity: dict[bytes, float]) -> list[bytes]:
    """Distinct words, the highest inverse document frequency first; ties by their bytes."""
    return sorted(set(words), key=lambda w: (-rarity[w], w))


def _places(postings: dict[bytes, list[int]], held: dict[bytes, set[int]], phrase: tuple[bytes, ...], rarity) -> list[int]:
    """Starts of a phrase: the places of its rarest word where the postings of all others hold the places beside it."""
    rare = min(phrase, key=lambda w: (-rarity[w], w))
    at = phrase.index(rare)
    starts = (p - at for p in postings[rare])
    return [s for s in starts if all(s + k in held[w] for k, w in enumerate(phrase))]


def _agreeing(postings: dict[bytes, list[int]], template: Template, anchors: list[bytes], need: int) -> list[tuple[int, int]]:
    """(least, greatest) shift of the stretches where ``need`` anchors stand within ``SLACK`` words of their places."""
    where: dict[bytes, list[int]] = {}
    for k, w in enumerate(template.words):
        where.setdefault(w, []).append(k)
    votes = sorted((p - k, w) for w in anchors for k in where[w] for p in postings[w])
    found: list[tuple[int, int]] = []
    within: Counter[bytes] = Counter()
    low = 0
    for shift, w in votes:
        within[w] += 1
        while votes[low][0] < shift - SLACK:
            gone = votes[low][1]
            within[gone] -= 1
            if not within[gone]:
                del within[gone]
            low += 1
        if len(within) >= need:
            if found and votes[low][0] <= found[-1][1]:
                found[-1] = found[-1][0], shift
            else:
                found.append((votes[low][0], shift))
    return found


def find_licences(words: list[bytes], known: list[Template], rarity: dict[bytes, float]) -> list[tuple[str, bool, int, int, float]]:
    """(label, base, start, end, score) of what a file's words hold, by template and place.

    ``score`` is 1 for a base phrase; for a notice the share of its words, weighed by rarity, in the stretch found.
    """
    present = rarity.keys() & set(words)
    open_ = [t for t in known if t.needed <= present]
    if not open_:
        return []
    sought = {}
    for t in open_:
        rare = _rarest([w for w in t.words if w in present], rarity)[:ANCHORS]
        sought[t] = rare
    wanted = {w for t in open_ for w in (*sought[t], *t.needed)}
    postings: dict[bytes, list[int]] = {w: [] for w in wanted}
    for i, w in enumerate(words):
        if w in wanted:
            postings[w].append(i)
    held = {w: set(x) for w, x in postings.items()}
    found = []
    for t in open_:
        size = len(t.words)
        phrases = [_places(postings, held, p, rarity) for p in t.required]
        if t.base:
            found += [(t.label, True, s, s + size, 1.0) for s in phrases[0]]
            continue
        if not all(phrases):
            continue
        need = max(2, (min(ANCHORS, len(set(t.words))) + 1) // 2)
        weight = Counter(t.words)
        total = sum(n * rarity[w] for w, n in weight.items())
        for first, last in _agreeing(postings, t, sought[t], need):
            low, high = max(0, first - SLACK), min(len(words), last + size + SLACK)
            inside = all(any(low <= s and s + len(p) <= high for s in starts) for p, starts in zip(t.required, phrases, strict=True))
            if inside:
                shown = weight & Counter(words[low:high])
                share = sum(n * rarity[w] for w, n in shown.items()) / total
                found.append((t.label, False, max(0, first), min(len(words), last + size), min(1.0, share)))
    return found


def _count(batches: Iterator[pa.RecordBatch], vocabulary: set[bytes]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    rows = 0
    for batch in batches:
        for piece in pieces(batch, 0):
            for text in piece.column(0).to_pylist():
                counts.update(vocabulary.intersection(words_of(text)))
            rows += piece.num_rows
    named = [None, *counts]
    yield pa.record_batch(
        [pa.array(named, pa.binary()).cast(pa.string()), pa.array([rows, *counts.values()], pa.int64())], ["word", "docs"]
    )


def word_rarity(texts: DataFrame, text: str, known: list[Template]) -> dict[bytes, float]:
    """Inverse document frequency over all rows, of the templates' words; above zero also for words of every row."""
    vocabulary = {w for t in known for w in (*t.words, *t.needed)}
    part = texts.select(F.col(text).cast("string")).mapInArrow(lambda b: _count(b, vocabulary), "word string, docs long")
    # At most one row a word of the templates.
    counts = {r.word: r.docs for r in part.groupBy("word").agg(F.sum("docs").alias("docs")).collect()}
    rows = counts.get(None, 0)
    return {w: math.log1p((1 + rows) / (1 + counts.get(w.decode(), 0))) for w in vocabulary}


_MATCH = "struct<label: string, base: boolean, start: long, end: long, score: double>"


def _scan(batches: Iterator[pa.RecordBatch], known: list[Template], rarity: dict[bytes, float]) -> Iterator[pa.RecordBatch]:
    match = pa.list_(
        pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    )
    names = ("label", "base", "start", "end", "score")
    for batch in batches:
        for piece in pieces(batch, 1):
            sizes, found = [], []
            for text in piece.column(1).to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                found.append([dict(zip(names, x, strict=True)) for x in find_licences(words, known, rarity)])
            yield pa.record_batch([piece.column(0), pa.array(sizes, pa.int64()), pa.array(found, match)], ["doc_id", "n_words", "matches"])


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, matches (array of label, base, start, end, score).

    Positions are numbers of words, ends exclusive. Every place of a base phrase is a match; a notice is one where its
    rare words stand at their relative places and all its mandatory phrases stand in that stretch. No count is limited.

    A null or empty text has no words and no matches, but counts as a document. Repeated rows and null ids are kept as
    they are; an empty table gives an empty result; further columns are ignored, whatever their names.
    """
    known = templates(phrases, notices)
    rarity = word_rarity(docs, text, known)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _scan(b, known, rarity), f"doc_id {kind}, n_words long, matches array<{_MATCH}>")


def _labels(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def licence_labels(found: DataFrame) -> DataFrame:
    """Counts, places and labels of the matches of ``scan_licences``."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
