"""A journal that a replayed batch does not change, and reports of run folders that are still being written.

A run is a folder with a receipt (one JSON object, rewritten as the run goes on) and a trace (JSON lines, appended).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from millrace.functions.calls import json_kind, json_value
from millrace.operators.ordinals import numbered
from millrace.runtime import cut

BATCH = "batch"


def append_journal(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, once: bool = True, mode: str = "append") -> StreamingQuery:
    """Append a stream to the journal at ``path``, a folder per batch, each written whole.

    A batch that is replayed after a failure has its number still and replaces its own folder, so no row is there twice
    and none is lost. ``prepare`` changes a batch before it is written; a table that it joins is read anew for each
    batch, as it is by then. ``mode`` is the stream's output mode. With ``once`` the query ends when what is there has been read. A column ``batch`` of the
    stream's own is refused, since it would be taken for the folder's.
    """
    if BATCH in stream.columns:
        raise ValueError(f"a journal names its folders by {BATCH!r}: rename that column")

    def write(rows: DataFrame, number: int) -> None:
        kept = prepare(rows) if prepare else rows
        kept.write.mode("overwrite").parquet(f"{path}/{BATCH}={number:012d}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_journal(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The journal's rows with ``batch``, the number of the batch that brought them; ``schema`` is that of the rows.

    The schema is given so that a journal of no rows, or of batches without any, reads as an empty table.
    """
    whole = StructType([*(StructField(f.name, f.dataType, True) for f in schema.fields), StructField(BATCH, LongType())])
    try:
        return spark.read.schema(whole).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def latest_of(journal: DataFrame, by: str) -> DataFrame:
    """Of rows that update each other, that of the latest batch for each ``by``; of several in a batch, any.

    Null is a key as well.
    """
    rest = [c for c in journal.columns if c != by]
    newest = journal.groupBy(by).agg(F.max_by(F.struct(*rest), BATCH).alias("newest"))
    return newest.select(by, *[F.col(f"newest.{c}").alias(c) for c in rest if c != BATCH])


def _run(path: Column, depth: int) -> Column:
    return F.element_at(F.split(path, "/"), -1 - depth)


def receipts(spark: SparkSession, pattern: str, depth: int = 1) -> DataFrame:
    """(run, receipt, fault) of the receipt files that ``pattern`` finds; a run is the folder ``depth`` above its file.

    ``receipt`` is a variant, null where ``fault`` is ``empty_receipt`` (white space alone) or ``invalid_receipt`` (not
    one JSON object). Receipts are small: each is read whole. A file without a byte gives no row, as if not there yet.
    """
    files = spark.read.text(pattern, wholetext=True).select(_run(F.col("_metadata.file_path"), depth).alias("run"), "value")
    value = files.withColumn("receipt", json_value(F.col("value")))
    fault = F.when(F.col("value").rlike(r"^\s*$"), "empty_receipt").when(~json_kind(F.col("receipt")).eqNullSafe("object"), "invalid_receipt")
    return value.select("run", F.when(fault.isNull(), F.col("receipt")).alias("receipt"), fault.alias("fault"))


def trace_rows(spark: SparkSession, pattern: str, schema: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Trace lines as rows (run, then ``schema``), and per file (run, file, rows, torn, broken).

    A line that does not end yet is left to the next reading: a file is ``torn`` where its bytes are not those of ended
    lines, and its last line is then no row even if it parses. Blank lines are skipped; other lines that are no JSON
    object are counted as ``broken`` and are no rows. The lines are kept before they are judged, so that rows and counts
    are of one reading of files that grow. Lines that repeat are rows each; empty files have no lines to tell of.
    """
    text = spark.read.option("lineSep", "\n").text(pattern)
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("id")).alias("at")
    lines = cut(text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), at, "value"))
    files = lines.groupBy("file").agg((F.sum(F.octet_length("value") + 1) != F.max("size")).alias("torn"), F.max("at").alias("last"))
    ended = lines.join(files, "file").where("not (torn and at = last) and trim(value) <> ''")
    good = json_kind(json_value(F.col("value"))).eqNullSafe("object")
    counts = ended.groupBy("file").agg(F.sum(good.cast("long")).alias("rows"), F.sum((~good).cast("long")).alias("broken"))
    none = F.lit(0).cast("long")
    state = files.join(counts, "file", "left").select(_run(F.col("file"), depth).alias("run"), "file", F.coalesce("rows", none).alias("rows"), "torn", F.coalesce("broken", none).alias("broken"))
    rows = ended.where(good).select(_run(F.col("file"), depth).alias("run"), F.from_json("value", schema).alias("row"))
    return rows.select("run", "row.*"), state


def trial_reports(trials: DataFrame, steps: DataFrame, trial: str, cost: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Trials joined to the steps of their traces: ``reports`` (trial, status, commands, success, total_reward), one row a
    trial, and ``returns`` (trial, step, return), one row a step of a complete trial.

    ``trials`` has (trial, error, success, status), ``status`` null where a trial left no trace, ``steps`` (trial, step,
    reward). A trial is ``complete`` without an error, with a trace that its selector ended or whose budget ran out, and
    with a success of 0 or 1; else ``unusable``, without reward or returns. A step's return is the success and the rewards
    from it on, a null reward counting nothing; suffix sums are taken in blocks, so a trial of any length is no one
    task's. Steps of trials not listed are left out. Trials must be unique, steps unique in a trial.
    """
    ended = F.col("status").isin("finished_by_selector", "step_budget_exhausted")
    usable = F.col("error").isNull() & F.coalesce(ended, F.lit(False)) & F.coalesce(F.col("success").isin(0, 1), F.lit(False))
    counted = steps.groupBy(trial).agg(F.count("*").alias("__n"))
    joined = trials.select(trial, "success", "status", usable.alias("__usable")).join(counted, trial, "left")
    commands = F.when(F.col("status").isNotNull(), F.coalesce("__n", F.lit(0)))
    reports = joined.select(
        trial, F.when(F.col("__usable"), "complete").otherwise("unusable").alias("status"), commands.alias("commands"), "success",
        F.when(F.col("__usable"), F.col("success") - cost * commands).alias("total_reward"),
    )
    complete = joined.where("__usable").select(trial, "success")
    placed = numbered(steps.join(complete, trial).select(trial, "step", "success", F.coalesce("reward", F.lit(0.0)).alias("reward")), [trial], [F.col("step").desc()], "back")
    return reports, _running(placed, trial)


def _running(placed: DataFrame, trial: str, block: int = 1 << 16) -> DataFrame:
    """Sums of rewards up to place ``back``: within blocks of places, plus what the blocks before hold."""
    blocks = placed.withColumn("block", F.floor((F.col("back") - 1) / block))
    held = blocks.groupBy(trial, "block").agg(F.sum("reward").alias("held"))
    earlier = Window.partitionBy(trial).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(trial, "block", F.coalesce(F.sum("held").over(earlier), F.lit(0.0)).alias("before"))
    within = F.sum("reward").over(Window.partitionBy(trial, "block").orderBy("back"))
    sums = blocks.withColumn("within", within).join(offsets, [trial, "block"])
    return sums.select(trial, "step", (F.col("success") + F.col("within") + F.col("before")).alias("return"))
