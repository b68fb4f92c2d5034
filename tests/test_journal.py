"""Journals and run folders: replayed batches, torn lines, receipts that change, returns against plain sums."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from millrace.functions.calls import json_value
from millrace.streaming import journal


def stream(spark, folder):
    return spark.readStream.schema("k int, v int").option("maxFilesPerTrigger", 1).json(str(folder))


def run(query):
    query.awaitTermination()


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    inbox.mkdir()
    schema = stream(spark, inbox).schema
    read = lambda: sorted(tuple(r) for r in journal.read_journal(spark, out, schema).collect())
    assert read() == []
    for i in range(3):
        (inbox / f"{i}.json").write_text("".join(json.dumps({"k": i, "v": v}) + "\n" for v in [*range(i), 9, 9]))
        run(journal.append_journal(stream(spark, inbox), out, str(state)))
    before = read()
    assert before == sorted((i, v, i) for i in range(3) for v in [*range(i), 9, 9])
    # A failure after the last batch was written, before that was noted: it is run again.
    for note in (state / "commits").glob("*2*"):
        note.unlink()
    run(journal.append_journal(stream(spark, inbox), out, str(state)))
    assert read() == before
    # A half-written folder of that batch is replaced.
    for note in (state / "commits").glob("*2*"):
        note.unlink()
    shutil.rmtree(f"{out}/batch=000000000002")
    run(journal.append_journal(stream(spark, inbox), out, str(state)))
    assert read() == before
    with pytest.raises(ValueError, match="batch"):
        journal.append_journal(stream(spark, inbox).withColumnRenamed("v", "batch"), out, str(state))


def test_batches_meet_receipts_as_they_are_by_then(spark, tmp_path):
    inbox, out, runs = tmp_path / "in", str(tmp_path / "out"), tmp_path / "runs"
    inbox.mkdir()
    (runs / "1").mkdir(parents=True)
    schema = spark.createDataFrame([], "k int, v int, status string").schema

    def with_status(rows):
        found = journal.receipts(spark, f"{runs}/*/run.json")
        status = found.select(F.col("run").cast("int").alias("k"), F.try_variant_get("receipt", "$.status", "string").alias("status"))
        return rows.join(status, "k", "left")

    for i, status in enumerate(["running", "complete"]):
        (runs / "1" / "run.json").write_text(json.dumps({"status": status}))
        (inbox / f"{i}.json").write_text('{"k": 1, "v": %d}\n{"k": 2, "v": %d}\n' % (i, i))
        run(journal.append_journal(stream(spark, inbox), out, str(tmp_path / "state"), with_status))
    rows = journal.read_journal(spark, out, schema)
    assert sorted((r.k, r.v, r.status, r.batch) for r in rows.where("k = 1").collect()) == [(1, 0, "running", 0), (1, 1, "complete", 1)]
    assert {r.k: r.status for r in journal.latest_of(rows, "k").collect()} == {1: "complete", 2: None}


def test_receipts(spark, tmp_path):
    texts = {"a": '{"status": "ok",\n "n": 2}', "b": " \n", "none": "", "c": "[1]", "d": '{"status"', "e": "{} {}"}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(text)
    got = {r.run: (r.s, r.fault) for r in journal.receipts(spark, f"{tmp_path}/*/run.json").select("run", F.try_variant_get("receipt", "$.status", "string").alias("s"), "fault").collect()}
    assert got == {"a": ("ok", None), "b": (None, "empty_receipt"), "c": (None, "invalid_receipt"), "d": (None, "invalid_receipt"), "e": (None, "invalid_receipt")}


def test_traces_that_grow(spark, tmp_path):
    line = '{"step": 1}'
    texts = {
        "whole": f"{line}\n\n{line}\n  \n",
        "torn": f'{line}\n{{"step": 2}}\n{{"st',
        "unended": f"{line}\n{line}",
        "broken": f'{line}\n{{"step": \nnull\n[1]\n"é"\n',
        "crlf": f"{line}\r\n{line}\r\n",
        "only": line,
        "empty": "",
    }
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "training.jsonl").write_bytes(text.encode())
    # Blocks of some twenty bytes: lines of a file are read by several tasks.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20")
    try:
        rows, state = journal.trace_rows(spark, f"{tmp_path}/*/training.jsonl", "step int")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

    def plain(text):
        lines = text.split("\n")
        torn, lines = lines[-1] != "", [x for x in lines[:-1] if x.strip()]
        parsed = []
        for x in lines:
            try:
                parsed.append(json.loads(x))
            except ValueError:
                parsed.append(None)
        good = [x["step"] for x in parsed if isinstance(x, dict)]
        return torn, len(lines) - len(good), good

    wanted = {name: plain(text) for name, text in texts.items() if text}
    assert {r.run: (r.torn, r.broken, r.rows) for r in state.collect()} == {n: (t, b, len(g)) for n, (t, b, g) in wanted.items()}
    assert sorted(tuple(r) for r in rows.collect()) == sorted((n, step) for n, (_, _, good) in wanted.items() for step in good)


def test_trial_reports(spark):
    done = "finished_by_selector"
    trials = [("a", None, 1, done), ("b", "boom", 1, done), ("c", None, 0, None), ("d", None, 2, done), ("e", None, 0, "step_budget_exhausted"), ("f", None, None, done), ("g", None, 1, "running"), ("h", None, 1, done)]
    steps = [(t, s, None if s % 5 == 4 else s * 0.5) for t in "abdez" for s in range(7 if t != "a" else 40)]
    frame = spark.createDataFrame(trials, "t string, error string, success int, status string")
    reports, returns = journal.trial_reports(frame, spark.createDataFrame(steps, "t string, step int, reward double"), "t")
    got = {r.t: (r.status, r.commands, r.total_reward) for r in reports.collect()}
    assert got == {
        "a": ("complete", 40, 1 - 0.01 * 40), "b": ("unusable", 7, None), "c": ("unusable", None, None), "d": ("unusable", 7, None), "e": ("complete", 7, -0.01 * 7),
        "f": ("unusable", 0, None), "g": ("unusable", 0, None), "h": ("complete", 0, 1.0),
    }
    plain = {(t, s): success + sum(r or 0 for u, x, r in steps if u == t and x >= s) for t, success in (("a", 1), ("e", 0)) for u, s, _ in steps if u == t}
    assert {(r.t, r.step): r["return"] for r in returns.collect()} == plain
    placed = spark.createDataFrame([("a", i, 1, 0.5 * i, i + 1) for i in range(20)], "t string, step int, success int, reward double, back long")
    assert {r.step: r["return"] for r in journal._running(placed, "t", block=3).collect()} == {i: 1 + 0.25 * i * (i + 1) for i in range(20)}
    none = [x.limit(0) for x in (frame, spark.createDataFrame(steps, "t string, step int, reward double"))]
    assert [x.count() for x in journal.trial_reports(*none, "t")] == [0, 0]


def test_json_value_of_a_receipt_is_one_value(spark):
    (row,) = spark.createDataFrame([("{} tail",)], "t string").select(json_value(F.col("t")).alias("v")).collect()
    assert row.v is None
