"""Substring deduplication by sliding sentence spans.

Sentences are cut further at places that only the words around them decide, so that a passage falls into the same pieces
wherever it stands. From each piece on (and back from each, where asked) the shortest run of at least ``MIN_SENTENCES``
pieces with at least ``MIN_WORDS`` words is hashed; both kinds together cover all pieces of a repeated stretch. Runs that
occur more than once anywhere are repeated; the first occurrence (smallest id, then position) stays, and every piece
that another occurrence covers is removed. Of a repeated passage, only words at its two edges can stay, up to the
nearest place where both copies are cut.

A text's own repeats are found where it is parsed; only the first of equal runs of a text is compared with other texts.
These are counted by a 64-bit hash first; only runs whose hash repeats (a broadcast Bloom filter of bounded size tells)
go on with their 128-bit hash and position, and only texts that repeat others shuffle. All
texts of a batch are parsed and hashed together in numpy: a run's hash is a difference of running polynomial sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import pieces
from millrace.llm.exact_dedup import filter_bits, membership_filter, with_may_repeat
from millrace.runtime import cut

MIN_SENTENCES = 2
MIN_WORDS = 12
REACH = 3  # words looked at on either side of a cut within a sentence

_BLANK = np.zeros(0x110000, bool)
_BLANK[[i for i in range(0x3001) if chr(i).isspace()]] = True
_LOWER = np.arange(0x110000, dtype=np.uint64)
_LOWER[:0x1F000] = [ord(chr(i).lower()[0]) for i in range(0x1F000)]
_LOWER[ord("ς")] = ord("σ")  # what a capital sigma becomes depends on its place
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


_POWER = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_INVERSE = [np.uint64(pow(int(x), -1, 1 << 64)) for x in _POWER]


class _Pieces:
    """The pieces of many texts: arrays over all pieces, in the texts' order, and where each text's pieces begin.

    ``start`` and ``end`` are code points of the own text, ``words`` counts; ``total`` and ``sums`` run over all texts.
    """

    def __init__(self, texts: list[str]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        code = np.frombuffer("".join(f"{x}\n" for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = _BLANK[code]
        edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.cumsum(sizes) - sizes
        n = len(starts)
        if not n:
            self.start = self.end = self.words = np.zeros(0, np.int64)
            self.total, self.of, self.sums = np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64), []
            return
        stop = np.isin(code[ends - 1], (33, 46, 63))
        after = np.searchsorted(starts, np.flatnonzero(code == 10))  # words before a line feed; one ends each text
        stop[after[after > 0] - 1] = True
        place = np.arange(starts[0], len(code)) - np.repeat(starts, np.diff(starts, append=len(code)))
        signs = _mixed(_LOWER[code[starts[0] :]] + place.astype(np.uint64) * _MIX[0])
        signs[blank[starts[0] :]] = 0
        word = _mixed(np.add.reduceat(signs, starts - starts[0]))
        rank = np.zeros(n + 2 * REACH, np.uint64)  # before and after all texts as at a sentence's end
        rank[REACH:-REACH] = np.where(stop, np.uint64(0), _mixed(word * _MIX[0] + np.roll(word, -1)) | np.uint64(1))
        low = rank[REACH:-REACH].copy()
        for i in range(2 * REACH + 1):
            np.minimum(low, rank[i : i + n], out=low)
        stop |= low == rank[REACH:-REACH]
        last = np.flatnonzero(stop)
        first = np.append(0, last[:-1] + 1)
        owner = np.searchsorted(offsets, starts[first], "right") - 1
        self.of = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.start, self.end = starts[first] - offsets[owner], ends[last] - offsets[owner]
        self.start[self.of[:-1][np.diff(self.of) > 0]] = 0
        self.words = last - first + 1
        self.total = np.append(0, np.cumsum(self.words))
        word[first] = _mixed(word[first] ^ _MIX[1])  # where pieces begin counts
        self.sums = []
        for power, inverse in zip(_POWER, _INVERSE, strict=True):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(word * np.multiply.accumulate(np.full(n, power)), out=sums[1:])
            self.sums.append((sums, np.multiply.accumulate(np.append(np.uint64(1), np.full(n, inverse)))))
            word = _mixed(word + _MIX[2])

    def hashes(self, first: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of the runs of pieces [first, stop)."""
        low, high = self.total[first], self.total[stop]
        return [_mixed((sums[high] - sums[low]) * back[low] + (high - low).astype(np.uint64)) for sums, back in self.sums]

    def runs(self, back: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first piece, piece after the last) of the shortest run on from each piece, and ``back`` from each."""
        pieces, counts = np.arange(len(self.words)), np.diff(self.of)
        owner = np.repeat(np.arange(len(counts)), counts)
        stop = np.maximum(pieces + MIN_SENTENCES, np.searchsorted(self.total, self.total[:-1] + MIN_WORDS))
        there = stop <= self.of[owner + 1]
        if not back:
            return owner[there], pieces[there], stop[there]
        ending = pieces + 1
        begin = np.minimum(ending - MIN_SENTENCES, np.searchsorted(self.total, self.total[1:] - MIN_WORDS, "right") - 1)
        fits = begin >= self.of[owner]
        fits[fits] = ~(there[begin[fits]] & (stop[begin[fits]] == ending[fits]))  # a run on from there as well
        return tuple(np.concatenate([x[there], y[fits]]) for x, y in ((owner, owner), (pieces, begin), (stop, ending)))


    def split_runs(self, back: bool) -> tuple[tuple, tuple]:
        """The runs (text, first, stop, h1, h2) that no earlier run of their text equals, and those that one does."""
        text, first, stop = self.runs(back)
        order = np.argsort(first, kind="stable")
        text, first, stop = text[order], first[order], stop[order]
        columns = text, first, stop, *(self.hashes(first, stop) if len(text) else [np.zeros(0, np.uint64)] * 2)
        key = columns[3] ^ _mixed(columns[4] + text.astype(np.uint64) * _MIX[0])
        new = np.zeros(len(text), bool)
        new[np.unique(key, return_index=True)[1]] = True
        return tuple(x[new] for x in columns), tuple(x[~new] for x in columns)


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of the sentences: text up to ``.``, ``!`` or ``?`` before a blank, or up to a line's end.

    A sentence is also cut after a word whose hash (with the next word's) is the least of all within ``REACH`` words,
    unless it begins or ends within these. Nothing farther off counts, neither the sentence's length nor its start.
    """
    found = _Pieces([text])
    return list(zip(found.start.tolist(), found.end.tolist(), found.words.tolist(), strict=True))


def _hash_runs(batches: Iterator[pa.RecordBatch], back: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, 2):
            found = _Pieces(piece.column(2).fill_null("").to_pylist())
            (text, first, stop, h1, h2), _ = found.split_runs(back)
            if not len(text):
                continue
            owner = pa.array(text)
            yield pa.record_batch(
                {
                    "doc_id": piece.column(0).take(owner),
                    "text_hash": piece.column(1).take(owner),
                    "first": pa.array((first - found.of[text]).astype(np.int32)),
                    "size": pa.array((stop - first).astype(np.int32)),
                    "h1": pa.array(h1.view(np.int64)),
                    "h2": pa.array(h2.view(np.int64)),
                }
            )


def _without(text: str, start: np.ndarray, gone: np.ndarray) -> str:
    """The text without the pieces that are ``gone``; they begin at ``start``."""
    turns = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    edges = np.append(start, len(text))[turns].tolist()
    return "".join(text[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(text)], strict=True))


def _remove(batches: Iterator[pa.RecordBatch], back: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, 1):
            texts, covered = piece.column(1).to_pylist(), piece.column(2).to_pylist()
            found = _Pieces(texts)
            _, (_, first, stop, _, _) = found.split_runs(back)  # repeated within their text
            spans = [(found.of[i] + r["first"], r["size"]) for i, x in enumerate(covered) for r in x or ()]
            others = np.array(spans, np.int64).reshape(-1, 2)
            change = np.zeros(len(found.start) + 1, np.int64)
            np.add.at(change, np.append(first, others[:, 0]), 1)
            np.add.at(change, np.append(stop, others.sum(axis=1)), -1)
            gone = np.cumsum(change)[:-1] > 0
            removed = np.diff(np.append(0, np.cumsum(gone))[found.of])
            left = [
                _without(texts[i], found.start[a:b], gone[a:b]) if n else texts[i]
                for i, (a, b, n) in enumerate(zip(found.of[:-1].tolist(), found.of[1:].tolist(), removed.tolist(), strict=True))
            ]
            yield pa.record_batch(
                {
                    "doc_id": piece.column(0),
                    "text": pa.array(left, pa.string()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "removed_chars": pa.array([len(t) - len(x) for t, x in zip(texts, left, strict=True)], pa.int64()),
                }
            )


def drop_repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """doc_id, text without repeated sentence spans, n_removed (sentences) and removed_chars: one row a row.

    Without ``back``, only the shortest run on from each sentence counts, so that the last sentences of a repeated
    passage stay where they are too short for a run of their own; with it, the shortest run back from each does too.
    Sentences are compared word by word, in lower case (the first character of each code point's lower-case form). A null text counts as empty; rows that agree in id and text
    count as one document, whose rows stay alike; null ids come first. Other columns are ignored, whatever their names.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_hash"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    schema = f"doc_id {kind}, text_hash long, first int, size int, h1 long, h2 long"
    spans = rows.mapInArrow(partial(_hash_runs, back=back), schema)
    twice = cut(spans.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"))
    bits = filter_bits(twice.count())
    bitmaps = cut(membership_filter(twice, "h1", bits))
    likely = cut(with_may_repeat(spans, "h1", bitmaps, bits, "likely").where("likely").drop("likely"))
    place = F.struct("doc_id", "text_hash", "first")
    groups = likely.groupBy("h1", "h2").agg(F.min(place).alias("kept"), F.max(place).alias("last")).where("not (kept <=> last)").drop("last")
    groups = cut(groups)  # so that the next join has exchanges of its own, of which Spark splits a common passage's
    later = likely.join(groups, ["h1", "h2"]).where(~place.eqNullSafe(F.col("kept")))
    by_doc = cut(
        later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "size")).alias("covered"))
    )  # at most the sentences of a document
    doc_bits = filter_bits(by_doc.count())
    doc_maps = cut(membership_filter(by_doc, "text_hash", doc_bits))
    tested = with_may_repeat(rows, "text_hash", doc_maps, doc_bits, "touched")
    side = by_doc.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "covered")
    touched = tested.where("touched").join(
        side, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left"
    )
    none = F.array().cast("array<struct<first:int,size:int>>")
    untouched = tested.where(~F.col("touched")).select("doc_id", "text", none.alias("covered"))
    both = touched.select("doc_id", "text", F.coalesce("covered", none).alias("covered")).unionByName(untouched)
    return both.mapInArrow(partial(_remove, back=back), f"doc_id {kind}, text string, n_removed long, removed_chars long")
