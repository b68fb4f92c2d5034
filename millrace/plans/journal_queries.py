"""Event streams kept in journals, and run folders written from events and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.runtime import ensure_checkpoint_dir
from millrace.sources.tables import table
from millrace.streaming import journal, monitor


def _folder(spark) -> str:
    """A new folder where all executors see it."""
    return f"{ensure_checkpoint_dir(spark)}/journal-{uuid.uuid4().hex}"


def _journaled(spark, sf_dir, change, files: int = 1, mode: str = "append"):
    """What ``change`` makes of the stream of events, journaled to the end; the pattern finds one file as well as a folder."""
    folder, schema = _folder(spark), table(spark, sf_dir, "events").schema
    out = change(monitor.event_stream(spark, f"{sf_dir}/events.parque[t]", schema, files))
    journal.append_journal(out, f"{folder}/rows", f"{folder}/state", mode=mode).awaitTermination()
    return journal.read_journal(spark, f"{folder}/rows", out.schema)


@query("journaled_events", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, max(ts) AS latest FROM events GROUP BY 1")
def journaled_events(spark, sf_dir):
    rows = _journaled(spark, sf_dir, lambda events: events)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.max("ts").alias("latest"))


@query("journaled_newest", "SELECT user_id, max(event_id) AS last FROM events GROUP BY 1")
def journaled_newest(spark, sf_dir):
    rows = _journaled(spark, sf_dir, lambda events: monitor.newest_steps(events.where("user_id is not null"), "user_id", "event_id", "value"), mode="update")
    return journal.latest_of(rows, "user_id").select("user_id", "last")


@query(
    "journaled_windows",
    """WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT * FROM w WHERE start + INTERVAL 2 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""",
)
def journaled_windows(spark, sf_dir):
    """All files in one batch: which rows are late would otherwise be the order of files."""
    rows = _journaled(spark, sf_dir, lambda events: monitor.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"), files=1 << 30)
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_RUNS = """WITH e AS (SELECT event_id AS step, event_id % 16 AS run, (event_id % 4) * 0.25::DOUBLE AS reward, event_id % 7 = 3 AS broken FROM events),
    r AS (SELECT run, count(*) FILTER (NOT broken) AS steps, sum(reward) FILTER (NOT broken) AS total, run % 3 AS success, run <> 5 AND run % 3 < 2 AS usable FROM e GROUP BY 1)"""


def _trials(spark, sf_dir):
    """Events dealt out to 16 run folders as traces, one line in seven broken, with a receipt in each; both read again."""
    folder, run = _folder(spark), (F.col("event_id") % 16).alias("run")
    good = F.to_json(F.struct(F.col("event_id").alias("step"), ((F.col("event_id") % 4) * 0.25).alias("reward")))
    events = table(spark, sf_dir, "events").where("event_id is not null")
    events.select(run, F.when(F.col("event_id") % 7 == 3, F.concat(good, F.lit("}"))).otherwise(good).alias("value")).write.partitionBy("run").text(f"{folder}/traces")
    runs = events.select(run).distinct().repartition("run")
    receipt = F.to_json(F.struct(F.when(F.col("run") == 5, "timeout").alias("error"), (F.col("run") % 3).alias("success"), F.lit("finished_by_selector").alias("status")))
    runs.select("run", receipt.alias("value")).write.partitionBy("run").text(f"{folder}/receipts")
    found = journal.receipts(spark, f"{folder}/receipts/*/*.txt").where("fault is null")
    field = lambda name, kind: F.try_variant_get("receipt", f"$.{name}", kind).alias(name)
    trials = found.select("run", field("error", "string"), field("success", "int"), field("status", "string"))
    steps, state = journal.trace_rows(spark, f"{folder}/traces/*/*.txt", "step long, reward double")
    return journal.trial_reports(trials, steps, "run"), state


@query("run_reports", _RUNS + """ SELECT 'run=' || run AS run, CASE WHEN usable THEN 'complete' ELSE 'unusable' END AS status, steps AS commands, success::INT AS success, CASE WHEN usable THEN success::DOUBLE - 0.01::DOUBLE * steps END AS total_reward FROM r""")
def run_reports(spark, sf_dir):
    return _trials(spark, sf_dir)[0][0]


@query(
    "run_returns",
    _RUNS + """ SELECT 'run=' || e.run AS run, step, success + sum(reward) OVER (PARTITION BY e.run ORDER BY step DESC) AS "return" FROM e JOIN r USING (run) WHERE usable AND NOT broken""",
)
def run_returns(spark, sf_dir):
    return _trials(spark, sf_dir)[0][1]


@query("trace_states", _RUNS + """ SELECT 'run=' || run AS run, count(*) FILTER (NOT broken) AS rows, count(*) FILTER (broken) AS broken, false AS torn FROM e GROUP BY ALL""")
def trace_states(spark, sf_dir):
    state = _trials(spark, sf_dir)[1]
    return state.groupBy("run").agg(F.sum("rows").alias("rows"), F.sum("broken").alias("broken"), F.max("torn").alias("torn"))
