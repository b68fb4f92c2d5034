"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass one hashes every text to a few cells of a fixed-size table and counts the hits per cell (map-side combined);
the cells hit at least twice form a Bloom filter of the hashes that *may* repeat. Pass two tests every row
against that filter: rows that certainly do not repeat are emitted in place, only the others shuffle and are
resolved exactly on their SHA-256.

The filter holds ``bits_per_row`` bits a row, rounded up to a power of two and never more than ``max_bits``; that
bound (32 MB by default) is what is broadcast. A corpus too large for it gets a fuller filter: more rows shuffle,
the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import UPPER
from millrace.runtime import cut

BITS_PER_ROW = 8
MAX_BITS = 1 << 28
HASHES = 2
_BITMAP_BITS = 32768  # fixed by Spark's bitmap functions


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` does just that where every character outside ASCII is known to be its own lower case; the plain
    character translation, which is slower, handles the rest.
    """
    harmless = ~text.rlike(r"[^\x00-\x7F\x{A0}-\x{BF}\x{DF}-\x{FF}\x{2010}-\x{2030}]")
    return (
        F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
        .when(harmless, F.lower(text))
        .otherwise(F.translate(text, UPPER, UPPER.lower()))
    )


def text_key(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8; a null text counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _cells(key: Column, bits: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]


def repeat_filter(keyed: DataFrame, key: str, bits: int) -> DataFrame:
    """The Bloom filter of possibly repeated keys as (bucket, bitmap) rows, at most ``bits / 8`` bytes in all."""
    cell = F.explode(F.array_distinct(F.array(*_cells(F.col(key), bits)))).alias("cell")
    twice = keyed.select(cell).groupBy("cell").agg(F.count("*").alias("hits")).where("hits > 1")
    return _bitmaps(twice)


def membership_filter(keyed: DataFrame, key: str, bits: int) -> DataFrame:
    """The Bloom filter of all keys, in the form of ``repeat_filter``."""
    return _bitmaps(keyed.select(F.explode(F.array(*_cells(F.col(key), bits))).alias("cell")))


def _bitmaps(cells: DataFrame) -> DataFrame:
    return (
        cells.select(
            F.bitmap_bucket_number(F.col("cell") + 1).alias("bucket"),
            F.bitmap_bit_position(F.col("cell") + 1).alias("bit"),
        )
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def with_may_repeat(rows: DataFrame, key: str, bitmaps: DataFrame, bits: int, flag: str) -> DataFrame:
    """Add the boolean ``flag``: whether the filter holds every cell of the row's key."""
    kept = rows.columns
    hit = F.lit(True)
    for i, cell in enumerate(_cells(F.col(key), bits)):
        side = bitmaps.select(F.col("bucket").alias(f"__b{i}"), F.col("bitmap").alias(f"__m{i}"))
        rows = rows.join(F.broadcast(side), F.bitmap_bucket_number(cell + 1) == F.col(f"__b{i}"), "left")
        at = F.bitmap_bit_position(cell + 1)
        byte = F.conv(F.hex(F.substring(F.col(f"__m{i}"), F.expr("1") + (at / 8).cast("int"), F.lit(1))), 16, 10)
        bit = F.getbit(byte.cast("bigint"), (at % 8).cast("int"))
        hit = hit & F.coalesce(bit == 1, F.lit(False))
    return rows.select(*kept, hit.alias(flag))


def filter_bits(rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    """Filter size: the power of two that holds ``bits_per_row`` a row, within [one bitmap, ``max_bits``]."""
    bits = _BITMAP_BITS
    while bits < rows * bits_per_row and bits < max_bits:
        bits *= 2
    return bits


def _decide(keyed: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame, int]:
    """Decisions, filter and filter size for checkpointed (doc_id, text_sha256) rows."""
    bits = filter_bits(keyed.count(), max_bits=max_bits)
    bitmaps = cut(repeat_filter(keyed, "text_sha256", bits))
    tested = with_may_repeat(keyed, "text_sha256", bitmaps, bits, "may_repeat")
    single = tested.where(~F.col("may_repeat")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
        F.lit(1).cast("long").alias("copies"),
    )
    rows = tested.where("may_repeat").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("copies"))
    groups = rows.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
    )
    groups = cut(groups)  # so that the next join has exchanges of its own, of which Spark splits a hot text's
    repeated = (
        rows.join(groups, "text_sha256")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            "text_sha256",
            "copies",
        )
    )
    return single.unionByName(repeated), bitmaps, bits


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, copies.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as empty, texts are hashed
    whole. The largest doc_id of a group stays; nulls sort below every id, and a group of nulls only has a null
    keep_id. A row repeated with the same id and text (``copies`` > 1) is kept once. An empty table gives an empty
    result; further columns are ignored, whatever their names.
    """
    keyed = cut(docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_sha256")))
    return _decide(keyed, max_bits)[0]


def keep_first_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_dedup`` keeps.

    Rows that certainly do not repeat pass without a shuffle of their texts.
    """
    key, flag = "__text_sha256", "__may_repeat"
    keyed = cut(docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_sha256")))
    decided, bitmaps, bits = _decide(keyed, max_bits)
    tested = with_may_repeat(docs.withColumn(key, text_key(F.col(text))), key, bitmaps, bits, flag)
    keep = decided.where("kept").select(
        F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias(key), F.col("copies").alias("__copies")
    )
    held = tested.where(flag).join(keep, key).where(F.col(doc_id).eqNullSafe(F.col("__keep_id")))
    once = held.where("__copies = 1").unionByName(held.where("__copies > 1").dropDuplicates([key, "__keep_id"]))
    return tested.where(~F.col(flag)).select(*docs.columns).unionByName(once.select(*docs.columns))
