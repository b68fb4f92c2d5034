"""Record scans and sinks, and the streaming operators."""

import gzip

import pandas as pd
import pytest

from millrace.sources import records
from millrace.streaming import monitor


def test_documents_with_reasons(spark, tmp_path):
    lines = ['{"source_id": "a", "text": "x"}', "", '{"source_id": "a", "text": "y"}', '{"source_id": 1, "text": "z"}', '{"source_id": "b"}', "{oops", '{"source_id": "d", "text": "x"} {}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    with gzip.open(tmp_path / "in2.jsonl.gz", "wt") as f:
        f.write('{"source_id": "c", "text": "w"}\n')
    rows = records.read_documents(spark, str(tmp_path))
    kept, ledger = records.accepted_and_excluded(rows)
    assert {r.source_id for r in kept.collect()} == {"a", "c"}
    assert sorted(r.reason for r in ledger.collect()) == ["duplicate_id", "invalid_json", "invalid_json", "source_id", "text"]


def test_sink_manifest_and_digests(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "z int, role string, a string")
    records.write_json_lines(rows, str(tmp_path / "out"), by="role")
    read = spark.read.json(str(tmp_path / "out"))
    assert read.count() == 2 and set(read.columns) == {"a", "role", "z"}
    first, second = (records.manifest(x, "role").collect() for x in (rows, rows.repartition(3)))
    assert sorted(first) == sorted(second)
    (tmp_path / "pin.bin").write_bytes(b"abc")
    files = records.file_digests(spark, str(tmp_path / "pin.bin"))
    records.require_digest(files, {"pin.bin": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"})
    with pytest.raises(ValueError):
        records.require_digest(files, {"pin.bin": "0"})
    rows.write.parquet(str(tmp_path / "p"))
    witnessed = records.parquet_with_witness(spark, str(tmp_path / "p"))
    assert witnessed.select("witness").distinct().count() == 2


def _files(folder, parts):
    folder.mkdir()
    for i, part in enumerate(parts):
        pd.DataFrame(part).to_parquet(folder / f"{i}.parquet")


def _run(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_newest_steps_ignore_replays(spark, tmp_path):
    parts = [{"run": [1, 1], "step": [1, 2], "v": [10.0, 20.0]}, {"run": [1], "step": [2], "v": [99.0]}, {"run": [1], "step": [4], "v": [50.0]}]
    _files(tmp_path / "s", parts)
    stream = monitor.event_stream(spark, str(tmp_path / "s"), "run long, step long, v double")
    got = _run(monitor.newest_steps(stream, "run", "step", "v"), "update", "steps").orderBy("last").collect()
    assert [(r.last, r.previous) for r in got] == [(2, None), (4, 2)] and got[1].rate == 15.0


def test_ledger_of_transactions(spark, tmp_path):
    _files(tmp_path / "t", [{"u": [1, 1, 2], "phase": ["start", "complete", "start"]}, {"u": [1], "phase": ["accept"]}])
    stream = monitor.event_stream(spark, str(tmp_path / "t"), "u long, phase string")
    rows = _run(monitor.transaction_ledger(stream, "u", "phase"), "update", "ledger").collect()
    assert max((r.accepted, r.pending) for r in rows if r.u == 1) == (1, 0)
    assert {r.pending for r in rows if r.u == 2} == {1}


def test_windows_equal_the_batch(spark, tmp_path):
    times = pd.date_range("2024-01-01", periods=200, freq="7min")
    _files(tmp_path / "w", [{"ts": times[i::4].astype("datetime64[us]"), "k": ["a"] * 50, "value": [1.0] * 50} for i in range(4)])
    schema = "ts timestamp, k string, value double"
    stream = monitor.event_stream(spark, str(tmp_path / "w"), schema, files_per_trigger=4)
    got = _run(monitor.windowed_counts(stream, "ts", "k"), "append", "windows")
    batch = monitor.windowed_counts(spark.read.schema(schema).parquet(str(tmp_path / "w")), "ts", "k")
    done = {(r.start, r.n) for r in got.collect()}
    assert done and done <= {(r.start, r.n) for r in batch.collect()}


