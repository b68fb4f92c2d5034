"""Line deduplication by log templates, in DataFrame operations only.

A line's tokens that hold digits become ``<*>``. A tree of fixed depth sorts the lines by their number of tokens and
their first ``DEPTH`` tokens. Within a leaf, a token stays part of the template where it stands at its place in lines of
at least ``min_docs`` documents, counted once for each distinct line and document; the other places are variable.
Templates with enough fixed tokens that occur in at least ``min_docs`` documents are boilerplate: their lines are
dropped everywhere.

Lines travel as 128-bit hashes; the tokens of a distinct line are spelled out once, however often it occurs, and only
in leaves that reach ``min_docs``. Texts without such a line do not shuffle (a Bloom filter of bounded size tells).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.llm.exact_dedup import filter_bits, membership_filter, with_may_repeat
from millrace.runtime import cut

DEPTH = 2
MIN_DOCS = 10
MIN_TOKENS = 3
MIN_FIXED = 0.6  # share of a template's tokens that must be fixed
STATE_ROWS = 100_000  # rows of the smaller states that a partition holds about
VARIABLE = "<*>"
_BLANKS = r"[ \t\x0B\f\r]+"


def _masked(line: Column) -> Column:
    """The line with single blanks and its tokens with digits masked; lines without either are only looked through."""
    single = F.when(line.rlike(r"[\t\x0B\f\r]|  |^ | $"), F.trim(F.regexp_replace(line, _BLANKS, " "))).otherwise(line)
    # Anchored where a token begins and possessive: linear in the line, however long its tokens.
    hidden = lambda x: F.regexp_replace(x, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", VARIABLE)
    return let(single, lambda x: F.when(x.rlike("[0-9]"), hidden(x)).otherwise(x))


def _lines(rows: DataFrame) -> DataFrame:
    """doc (hash of id and text), at, masked line, its hashes m1 and m2, number of tokens and leaf."""
    # Masked within the generator: a projected column would be computed anew for each use.
    masked = F.transform(F.split("text", "\n", -1), _masked)
    lines = rows.select("doc", F.posexplode(masked).alias("at", "masked")).where("masked <> ''")
    tokens = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return lines.select(
        "doc",
        "at",
        "masked",
        F.xxhash64("masked").alias("m1"),
        F.xxhash64("masked", F.lit(1)).alias("m2"),
        tokens.alias("tokens"),
        F.xxhash64(tokens, F.substring_index("masked", " ", DEPTH)).alias("leaf"),
    ).where(F.col("tokens") >= MIN_TOKENS)


def recurring_lines(rows: DataFrame, min_docs: int, min_fixed: float) -> tuple[DataFrame, DataFrame]:
    """(narrow lines, distinct lines (m1, m2, template, n_docs) of recurring templates) of (doc, text) rows."""
    narrow = cut(_lines(rows).select("doc", "at", "m1", "m2", "tokens", "leaf"))
    distinct = cut(
        narrow.select("m1", "m2", "leaf", "doc").distinct().groupBy("m1", "m2", "leaf").agg(F.count("*").alias("docs"))
    )
    leaves = distinct.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs")).where(F.col("leaf_docs") >= min_docs)
    # The keyed side of a join is materialised before it: both sides then have exchanges of their own, of which Spark
    # splits those of a hot leaf, token or line.
    wanted = cut(distinct.join(cut(leaves.select("leaf"), STATE_ROWS), "leaf", "left_semi"))
    bits = filter_bits(wanted.count())
    bitmaps = cut(membership_filter(wanted, "m1", bits))
    spelled = with_may_repeat(_lines(rows).select("m1", "m2", "masked"), "m1", bitmaps, bits, "wanted").where("wanted")
    spelled = spelled.drop("wanted").dropDuplicates(["m1", "m2"]).join(wanted, ["m1", "m2"])
    tokens = cut(spelled.select("m1", "m2", "leaf", "docs", F.posexplode(F.split("masked", " ")).alias("place", "token")))
    fixed = (
        tokens.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).drop("n")
    )
    fixed = cut(fixed.withColumn("fixed", F.lit(True)), STATE_ROWS)
    marked = tokens.join(fixed, ["leaf", "place", "token"], "left")
    shown = F.when(F.col("fixed") & (F.col("token") != VARIABLE), F.col("token")).otherwise(VARIABLE)
    templates = (
        marked.groupBy("m1", "m2")
        .agg(F.array_sort(F.collect_list(F.struct("place", shown.alias("token")))).alias("t"))  # one line's tokens
        .select("m1", "m2", F.col("t")["token"].alias("t"))
        .where(F.size(F.filter("t", lambda x: x != VARIABLE)) >= min_fixed * F.size("t"))
        .select("m1", "m2", F.array_join("t", " ").alias("template"))
    )
    templates = cut(templates, STATE_ROWS)
    counted = (
        narrow.select("m1", "m2", "doc")
        .join(templates, ["m1", "m2"])
        .select(F.xxhash64("template").alias("t1"), F.xxhash64("template", F.lit(1)).alias("t2"), "doc")
        .distinct()
        .groupBy("t1", "t2")
        .agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )
    keyed = templates.withColumns({"t1": F.xxhash64("template"), "t2": F.xxhash64("template", F.lit(1))})
    return narrow, keyed.join(counted, ["t1", "t2"]).select("m1", "m2", "template", "n_docs")


def drop_recurring_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_fixed: float = MIN_FIXED
) -> DataFrame:
    """doc_id, text without lines of recurring templates, n_dropped: one row a row.

    Lines end at line feeds; lines of fewer than three tokens are left alone. A null text counts as empty. Rows that
    agree in id and text count as one document. Other columns are ignored, whatever their names.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), content.alias("text"), F.xxhash64(F.col(doc_id), content).alias("doc")
    )
    narrow, recurring = recurring_lines(rows.select("doc", "text"), min_docs, min_fixed)
    recurring = cut(recurring.select("m1", "m2"), STATE_ROWS)
    dropped = narrow.join(recurring, ["m1", "m2"]).groupBy("doc").agg(F.collect_set("at").alias("gone"))
    dropped = cut(dropped)  # at most the lines of a document
    bits = filter_bits(dropped.count())
    bitmaps = cut(membership_filter(dropped, "doc", bits))
    tested = with_may_repeat(rows, "doc", bitmaps, bits, "touched")
    untouched = tested.where(~F.col("touched")).select("doc_id", "text", F.lit(0).cast("long").alias("n_dropped"))
    touched = tested.where("touched").join(dropped, "doc", "left")
    kept = F.array_join(
        F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False))), "\n"
    )
    return untouched.unionByName(
        touched.select("doc_id", kept.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    )
