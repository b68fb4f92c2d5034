"""Structured Streaming over event files: incremental export, throughput, ledgers, windowed counts.

Lateness is this engine's own policy: events later than the watermark are dropped, as in any Spark stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of whole Parquet files as they arrive; a torn file never shows, since arrival is atomic."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows and sums of ``value`` per window and key; append mode gives a window once the watermark has passed it."""
    window = F.window(time, width)
    out = events.withWatermark(time, late).groupBy(window, by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "n", "total")


def newest_steps(events: DataFrame, by: str, step: str, value: str) -> DataFrame:
    """Update-mode rows (by, last, previous, rate): the newest step of each run and its change per step since the last export.

    State is one row a run. Steps not above the exported one are ignored, so replayed files change nothing.
    """

    def export(key, batches: Iterator[pd.DataFrame], state):
        last, held = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(step)
        if last is not None:
            rows = rows[rows[step] > last]
        if len(rows):
            newest, amount = int(rows[step].iloc[-1]), float(rows[value].iloc[-1])
            rate = None if last is None else (amount - held) / (newest - last)
            state.update((newest, amount))
            yield pd.DataFrame({by: [key[0]], "last": [newest], "previous": [last], "rate": [rate]})

    kind = events.schema[by].dataType.simpleString()
    return events.groupBy(by).applyInPandasWithState(
        export, f"{by} {kind}, last long, previous long, rate double", "last long, held double", "update", "NoTimeout"
    )


def transaction_ledger(events: DataFrame, by: str, phase: str) -> DataFrame:
    """Update-mode rows (by, started, completed, accepted, rejected, pending) of start / complete / accept / reject events.

    A completion without a pending start is an error of the source and raises, as does a verdict without a completion.
    """

    def fold(key, batches: Iterator[pd.DataFrame], state):
        started, completed, accepted, rejected = state.get if state.exists else (0, 0, 0, 0)
        for batch in batches:
            for p in batch[phase]:
                started += p == "start"
                completed += p == "complete"
                accepted += p == "accept"
                rejected += p == "reject"
        if completed > started or accepted + rejected > completed:
            raise ValueError(f"{key[0]}: more completions or verdicts than starts")
        state.update((started, completed, accepted, rejected))
        row = (key[0], started, completed, accepted, rejected, started - completed)
        yield pd.DataFrame([row], columns=[by, "started", "completed", "accepted", "rejected", "pending"])

    kind = events.schema[by].dataType.simpleString()
    counts = "started long, completed long, accepted long, rejected long"
    return events.groupBy(by).applyInPandasWithState(fold, f"{by} {kind}, {counts}, pending long", counts, "update", "NoTimeout")
