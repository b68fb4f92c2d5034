"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. Runs of one symbol collapse to a symbol of their own; deterministic coin tossing
(lowest differing bit between neighbours, iterated) reduces the names to a few labels, local maxima of which begin
the phrases; each phrase is named by a hash of its symbols. A boundary depends on a few neighbours only, so equal
substrings get equal phrases inside, wherever they start. The signatures of a text are the names of all levels, each
counted as often as it stands. Its fingerprint keeps, in each of ``BINS`` classes of signatures, 16 bits of the smallest:
some classes for the characters, some for the phrases of about three, most for those of nine and more. Classes of the
higher levels weigh more in a likeness. A short text has few of these, so its lower levels count for more: nothing else
depends on the length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import pieces

#: Classes and weight of a class: for level 0 (characters), level 1, and all levels from 2 on.
TIERS = ((8, 1), (8, 2), (48, 4))
BINS = sum(n for n, _ in TIERS)
WEIGHTS = np.repeat([w for _, w in TIERS], [n for n, _ in TIERS])
PIECE = 1 << 18  # bytes of text parsed at once, so that the arrays stay in the processor's cache
NO_NAME = 0xFFFF  # the digits of a class without names

_U = np.uint64
_ODD = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, _U), dtype=_U)
#: The label of a symbol (column) after its neighbour (row): twice the lowest differing bit, plus the symbol's bit there.
_TOSS = np.array(
    [[2 * (d := ((x ^ y) & -(x ^ y)).bit_length() - 1) + (y >> d & 1) if x != y else 0 for y in range(128)] for x in range(128)],
    np.uint8,
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _collapse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every maximal run of a repeated name within a text becomes one symbol."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | first[1:]
    if new.all():
        return names, first
    at = np.flatnonzero(new)
    lengths = np.diff(np.append(at, len(names)))
    heads = names[at]
    many = lengths > 1
    run = _mix(heads[many].astype(_U) + lengths[many].astype(_U) * _ODD[3])
    heads[many] = (run & _U(0x7FFFFFFF)) + _U(0x110001) if heads.dtype == np.uint32 else run
    return heads, first[at]


def _phrase_starts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where phrases begin: starts of texts, and local maxima of the labels after coin tossing."""
    one = names.dtype.type(1)
    differing = np.empty_like(names)
    np.bitwise_xor(names[1:], names[:-1], out=differing[1:])
    differing[first] = names[first]
    lowest = differing & (~differing + one)
    label = np.bitwise_count(lowest - one).astype(np.uint8)
    label <<= 1
    label |= (names & lowest) != 0
    for _ in range(3):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = 0
        label = _TOSS[before, label]
    # labels are now 0 to 5, and neighbours differ
    top = np.zeros(len(label), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[:-2]
    top[:-1] &= ~first[1:]
    return top | first


def _name_phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(_phrase_starts(names, first))
    lengths = np.diff(np.append(at, len(names)))
    sums = names[at].astype(_U) * _ODD[0]
    for place in range(1, int(lengths.max())):
        some = np.flatnonzero(lengths > place)
        sums[some] += names[at[some] + place].astype(_U) * _ODD[place & 63]
    return _mix(sums + lengths.astype(_U)), first[at]


def signatures(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, names, the text that each belongs to) from the characters up, until every text is parsed to its root."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.flatnonzero(sizes)
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    sizes = sizes[owner]
    first = np.zeros(len(names), bool)
    first[np.cumsum(sizes) - sizes] = True
    level = 0
    while len(names):
        yield level, names, np.repeat(owner, sizes)
        names, first = _collapse(names, first)
        sizes = np.diff(np.append(np.flatnonzero(first), len(names)))
        single = sizes == 1  # parsed to the root
        if single.any():
            rest = np.repeat(~single, sizes)
            names, first, owner = names[rest], first[rest], owner[~single]
        if len(names):
            names, first = _name_phrases(names, first)
            sizes = np.diff(np.append(np.flatnonzero(first), len(names)))
        level += 1


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of BINS 16-bit values for each text."""
    none = np.iinfo(np.uint64).max
    smallest = np.full(len(texts) * BINS, none, _U)
    last, before = len(TIERS) - 1, 0
    tiers: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in TIERS]
    for level, names, of in signatures(texts):
        tiers[min(level, last)].append((_mix(names.astype(_U)), of))
    for (classes, _), found in zip(TIERS, tiers, strict=True):
        if found:
            names, of = _numbered(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
            place = ((names >> _U(40)) * _U(classes) >> _U(24)).astype(np.int64)
            np.minimum.at(smallest, of * BINS + before + place, names & _U((1 << 40) - 1))
        before += classes
    values = np.where(smallest != none, _mix(smallest) % _U(NO_NAME), _U(NO_NAME)).astype(np.uint16)
    return values.reshape(len(texts), BINS)


def _numbered(names: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tell the occurrences of a name within a text apart, so that a repeated phrase counts as often as it stands."""
    key = names ^ (of.astype(_U) * _ODD[7])
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    place = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
    return _mix(names[order] + place.astype(_U) * _ODD[11]), of[order]


def as_text(prints: np.ndarray) -> list[str]:
    """Lowercase hex, four digits a class."""
    return [row.hex() for row in prints.astype(">u2").view("u1").reshape(len(prints), -1).copy().view(f"V{2 * BINS}").ravel().tolist()]


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share by weight, of the classes with a name in either, of those that agree; 1 for two texts without names."""
    either = ((left != NO_NAME) | (right != NO_NAME)) @ WEIGHTS
    same = ((left == right) & (left != NO_NAME)) @ WEIGHTS
    return np.where(either > 0, same / np.maximum(either, 1), 1.0)


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every whole text.

    A null text counts as empty, whose fingerprint is ``ffff`` in each class; equal texts have equal fingerprints. One
    row a row; other columns are ignored, whatever their names.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, PIECE):
                texts = [x or "" for x in piece.column(1).to_pylist()]
                yield pa.record_batch(
                    {
                        "doc_id": piece.column(0),
                        "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                        "fingerprint": pa.array(as_text(fingerprints(texts)), pa.string()),
                    }
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")


def in_buckets(docs: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """Rows of (doc_id, text) with ``bucket``: consecutive ranges of descending doc_id, null ids in a last one.

    The cuts are approximate quantiles of the ids, so buckets are about equal and each is a bounded piece of work.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(docs.stat.approxQuantile("doc_id", shares, 0.25 / buckets)), reverse=True) if shares else []
    id_double = F.col("doc_id").cast("double")
    # Binary search of the cuts, as a column: the number of cuts above the id.
    table = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    above = F.aggregate(
        F.sequence(F.lit(0), F.lit(max(len(cuts), 1).bit_length())),
        F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")),
        lambda s, _: F.when(
            s["low"] < s["high"],
            F.when(
                F.get(table, F.floor((s["low"] + s["high"]) / 2).cast("int")) > id_double,
                F.struct((F.floor((s["low"] + s["high"]) / 2).cast("int") + 1).alias("low"), s["high"].alias("high")),
            ).otherwise(
                F.struct(s["low"].alias("low"), F.floor((s["low"] + s["high"]) / 2).cast("int").alias("high"))
            ),
        ).otherwise(s),
    )["low"]
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(above)), len(cuts) + 2


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text: see the columns below.

    In descending doc_id (nulls last, equal ids by text), the last floor(n_chars/3) code points of a text are replaced
    by the first as many of the next document's text, or all of it; after the last document comes the first. Columns:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited (likeness to the edited text) and
    near_next (to the next document). A null text counts as empty, repeated rows follow each other, a single row is
    its own next, an empty table gives an empty result. Other columns are ignored.

    Texts shuffle once, into buckets of consecutive ids; the first row of a bucket also goes to the one before it.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, _ = in_buckets(rows, wanted)
    firsts = rows.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).orderBy("bucket").collect()  # a row a bucket
    if not firsts:
        return spark.createDataFrame([], _RESULT)
    before = [(firsts[i - 1].bucket, r.doc_id) for i, r in enumerate(firsts)]
    heads = spark.createDataFrame(before, "bucket int, head_id long")
    ghosts = (
        rows.drop("bucket")
        .join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")))
        .select("doc_id", "text", "bucket", F.lit(True).alias("ghost"))
    )
    return (
        rows.select("doc_id", "text", "bucket", F.lit(False).alias("ghost"))
        .unionByName(ghosts)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("doc_id"), "text")
        .mapInArrow(_pairs, _RESULT)
    )


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The comparison over rows in order; a ghost row ends its bucket and is no document of it."""
    held: tuple | None = None  # the last row, whose next is still to come: (doc_id, text, fingerprint)
    closed = -1  # the bucket whose ghost has come
    for batch in batches:
        for piece in pieces(batch, 1, PIECE):
            ids, texts, buckets, ghosts = (c.to_pylist() for c in piece.columns)
            own = fingerprints(texts)
            done = []
            for i, (key, text, bucket, ghost) in enumerate(zip(ids, texts, buckets, ghosts, strict=True)):
                if ghost and bucket == closed:
                    continue
                if held is not None:
                    done.append((*held, text, own[i]))
                held = None if ghost else (key, text, own[i])
                closed = bucket if ghost else closed
            if done:
                yield _compared(done)


def _compared(done: list[tuple]) -> pa.RecordBatch:
    edited = []
    for _, text, _, following, _ in done:
        cut = len(text) // 3
        edited.append(text[: len(text) - cut] + following[:cut])
    own, after = np.stack([x[2] for x in done]), np.stack([x[4] for x in done])
    changed = fingerprints(edited)
    return pa.record_batch(
        {
            "doc_id": pa.array([x[0] for x in done], pa.int64()),
            "n_chars": pa.array([len(x[1]) for x in done], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            "fingerprint": pa.array(as_text(own), pa.string()),
            "edited_fingerprint": pa.array(as_text(changed), pa.string()),
            "near_edited": pa.array(likeness(own, changed)),
            "near_next": pa.array(likeness(own, after)),
        }
    )
