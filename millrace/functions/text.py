"""Text functions as columns."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

WORD = re.compile(r"\w+")  # [\p{L}\p{N}_]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalize_lines(text: Column) -> Column:
    """CRLF and CR become LF; blanks and tabs before a line end go; indentation stays. Null stays null."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "(?md)[ \t]+$", "")


def sha256_hex(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row; an expression used within a lambda is evaluated on each call."""
    return F.transform(F.array(value), body)[0]


PIECE_CHARS = 1 << 18  # characters of text whose words or shingles exist as Python strings at once


def pieces(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive runs of about ``PIECE_CHARS`` characters; a longer text stands alone."""
    start, held, chars = 0, [], 0
    for x in texts:
        x = x.as_py()
        if held and chars + len(x or "") > PIECE_CHARS:
            yield start, held
            start, held, chars = start + len(held), [], 0
        held.append(x)
        chars += len(x or "")
    if held:
        yield start, held


def row_pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch by the characters of its string column number ``text``, as :func:`pieces` has them."""
    for start, held in pieces(batch.column(text)):
        yield batch.slice(start, len(held))


def _by_piece(texts: pa.Array, make, kind: pa.DataType) -> pa.Array:
    """``make`` of each text, one piece after another, so that Python's own strings are those of one piece."""
    made = [pa.array([make(x) for x in held], kind) for _, held in pieces(texts)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def _shingles(text: str | None, size: int) -> list[str]:
    words = WORD.findall((text or "").lower())
    return list(dict.fromkeys(map(" ".join, zip(*(words[i:] for i in range(size))))))


def word_shingles(text: Column, size: int = 3) -> Column:
    """Distinct ``size``-word shingles of the lower-cased letters, digits and underscores; empty when too short or null.

    Batches of whole texts go to Python by Arrow: built-in functions would need lambdas within lambdas, which are
    interpreted for each word.
    """

    @F.arrow_udf("array<string>")
    def shingles(texts: pa.Array) -> pa.Array:
        return _by_piece(texts, lambda x: _shingles(x, size), pa.list_(pa.string()))

    return shingles(text)


def shingled(rows: DataFrame, text: str, size: int = 3) -> DataFrame:
    """``rows`` with ``shingles``, the :func:`word_shingles` of a text column, in its place, which comes last.

    The sets leave Python a piece at a time: those of a whole batch, several times its texts, are never held.
    """
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, held in pieces(batch.column(len(kept))):
                sets = pa.array([_shingles(x, size) for x in held], pa.list_(pa.string()))
                columns = [batch.column(i).slice(start, len(held)) for i in range(len(kept))]
                yield pa.record_batch([*columns, sets], [*kept, "shingles"])

    schema = StructType([rows.schema[c] for c in kept]).add("shingles", ArrayType(StringType()))
    return rows.select(*kept, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers in which every bit depends on all."""
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * _ODD
    return x ^ (x >> np.uint64(32))


@lru_cache(32)
def _powers(base: int, n: int) -> np.ndarray:
    """The powers of ``base`` from 0 to ``n - 1``, modulo 2**64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


@lru_cache(1)
def _in_words() -> np.ndarray:
    """Which code points are in words."""
    inside = np.zeros(sys.maxunicode + 1, np.int8)
    inside[[ord(c) for c in "".join(WORD.findall("".join(map(chr, range(sys.maxunicode + 1)))))]] = 1
    return inside


def shingle_codes(text: str | None, size: int) -> np.ndarray:
    """The 64-bit code of each ``size``-word shingle of the lower-cased text, by place; those of :func:`word_shingles`.

    A word's code is a polynomial of its mixed characters, taken from running sums over the text; the codes of a shingle's
    words are mixed in order. Equal shingles have equal codes in every task; two others agree once in some 2**60 by chance.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = _in_words()[points]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if len(starts) < size:
        return np.empty(0, np.uint64)
    room = 1 << max(12, len(points).bit_length())  # few sizes, so that the powers are made once
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mixed(points + _ODD) * _powers(int(_ODD), room)[: len(points)], out=sums[1:])
    of_words = _mixed((sums[ends] - sums[starts]) * _powers(int(_INVERSE), room)[starts])
    n = len(starts) - size + 1
    codes = of_words[:n]
    for i in range(1, size):
        codes = _mixed(codes + _ODD) + of_words[i : i + n]
    return _mixed(codes)


def coded(rows: DataFrame, text: str, size: int = 3, digest: bool = False) -> DataFrame:
    """``rows`` with ``codes``, the sorted distinct :func:`shingle_codes` of a text column, in its place, which comes last.

    With ``digest`` there are not the codes but ``set_hash``, the SHA-256 of them. Texts without shingles have no row.
    """
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, held in pieces(batch.column(len(kept))):
                sets = [np.unique(shingle_codes(x, size)) for x in held]
                has = np.flatnonzero([len(s) for s in sets])
                if digest:
                    made = pa.array([sha256(sets[i].tobytes()).hexdigest() for i in has], pa.string())
                else:
                    ends = np.cumsum([0, *(len(sets[i]) for i in has)], dtype=np.int32)
                    values = np.concatenate([sets[i] for i in has] or [np.empty(0, np.uint64)]).view(np.int64)
                    made = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                columns = [batch.column(i).slice(start, len(held)).take(pa.array(has)) for i in range(len(kept))]
                yield pa.record_batch([*columns, made], [*kept, "set_hash" if digest else "codes"])

    schema = StructType([rows.schema[c] for c in kept])
    schema = schema.add("set_hash", StringType()) if digest else schema.add("codes", ArrayType(LongType()))
    return rows.select(*kept, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def nfkc_casefold(text: Column) -> Column:
    """Unicode compatibility form (NFKC) with case folded; null stays null.

    Spark has neither: its ``lower`` leaves the sharp s, ligatures and raised digits. Whole texts go to Python by Arrow.
    """

    @F.arrow_udf("string")
    def folded(texts: pa.Array) -> pa.Array:
        fold = lambda x: None if x is None else x if x.isascii() and x.islower() else unicodedata.normalize("NFKC", x).casefold()
        return _by_piece(texts, fold, pa.string())

    return folded(text)


def folded_words(text: Column) -> Column:
    """The words (letters, digits, underscores) of the folded text, joined by single blanks; null stays null."""

    @F.arrow_udf("string")
    def words(texts: pa.Array) -> pa.Array:
        fold = lambda x: None if x is None else " ".join(WORD.findall(unicodedata.normalize("NFKC", x).casefold()))
        return _by_piece(texts, fold, pa.string())

    return words(text)


# The words that begin and end a passage which several questions may share.
SPAN_STARTS = ("passage", "paragraph", "context", "article", "review", "document", "premise", r"sentence(?:\s+(?:1|one))?", r"text(?:\s+(?:1|one))?")
SPAN_ENDS = ("question", "answer", "candidate", "hypothesis", r"sentence\s+(?:2|two)", r"text\s+(?:2|two)", "option", "label", "title", "category", "response")
SPAN_CHARS, SPAN_WORDS = 80, 12


def marked_spans(text: Column, starts=SPAN_STARTS, ends=SPAN_ENDS, chars: int = SPAN_CHARS, words: int = SPAN_WORDS) -> Column:
    """The distinct marked passages of a text as folded words, those of at least ``chars`` characters and ``words`` words.

    A passage begins after a start word with a colon, an equals sign or a hyphen, at the text's or a line's start or after
    a full stop and white space, and ends before an end word so marked that follows a line end or two white spaces, else
    with the text. A passage that begins within another counts as well. Empty for null.
    """
    begin = re.compile(rf"(?:^|\n|(?<=\.)\s+)(?:{'|'.join(starts)})\s*[:=\-]\s*", re.IGNORECASE)
    stop = re.compile(rf"(?:\n|\s{{2,}})(?:{'|'.join(ends)})\s*[:=\-]", re.IGNORECASE)

    @F.arrow_udf("array<string>")
    def spans(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            found: dict[str, None] = {}
            for m in begin.finditer(x or ""):
                last = stop.search(x, m.end())
                span = " ".join(WORD.findall(unicodedata.normalize("NFKC", x[m.end() : last.start() if last else None]).casefold()))
                if len(span) >= chars and span.count(" ") + 1 >= words:
                    found[span] = None
            out.append(list(found))
        return pa.array(out, pa.list_(pa.string()))

    return spans(text)
