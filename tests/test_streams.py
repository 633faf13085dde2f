"""Stateful streams: order within a key beyond memory, timers, partial frames."""

import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.streaming import jobs

PROGRESS = "task string, seq long, stage string, current_step int, status string"


def test_a_key_of_many_events(spark, tmp_path):
    """Rows of one key, shuffled, in runs that are merged from list state: every tenth changes the step. Passes with a million, too."""
    n = int(os.environ.get("QUILLSTONE_EVENTS", "200000"))
    rows = spark.range(n).select(F.lit("t").alias("task"), F.col("id").alias("seq"), F.lit("s").alias("stage"), F.floor(F.col("id") / 10).cast("int").alias("current_step"), F.lit("running").alias("status"))
    rows.repartition(4, F.xxhash64("seq")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PROGRESS).parquet(str(tmp_path / "in"))
    out = jobs.run_available(jobs.progress(stream, timed=False), "million")
    assert out.agg(F.count("*"), F.sum("seq"), F.count_distinct("current_step")).first()[:] == (n // 10, 10 * (n // 10 - 1) * (n // 10) // 2, n // 10)


def test_runs_are_merged(spark, tmp_path, monkeypatch):
    """More runs than can be merged at once, by a processor whose chunks are small."""

    class Small(jobs.Order):
        def _sorted(self, frames):
            jobs.CHUNK = 7
            return super()._sorted(frames)

    events = [("a", i, "retrieval_done" if i == 0 else "token" if i % 50 else "done") for i in range(1_000)]
    df = spark.createDataFrame(events, "stream string, seq long, event string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = jobs.run_available(jobs._run(stream, "stream", Small()), "runs")
    key = lambda x: sorted((r.seq, r.event, r.before) for r in x.collect())
    assert key(got) == key(text.order_faults(df)) and got.count() == 19


def test_idle_tasks_are_forgotten(spark, tmp_path):
    """The same stage again is no change, unless the timer has run out in between."""
    src = tmp_path / "in"
    put = lambda seq: spark.createDataFrame([("t", seq, "parsing", 1, "running")], PROGRESS).coalesce(1).write.mode("append").parquet(str(src))
    put(1)
    stream = jobs.progress(spark.readStream.schema(PROGRESS).parquet(str(src)), idle=6_000)
    query = stream.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    seen = lambda: sorted(r.seq for r in spark.table("idle").collect())

    def wait(want, most):
        end = time.time() + most
        while seen() != want and time.time() < end:
            time.sleep(0.5)
        return seen()

    try:
        assert wait([1], 60) == [1]
        put(2)
        time.sleep(4)
        assert seen() == [1]
        time.sleep(14)
        put(3)
        assert wait([1, 3], 60) == [1, 3]
    finally:
        query.stop()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1_000])
def test_frames_cut_at_every_byte(spark, tmp_path, size):
    parts = [("token", json.dumps({"text": "a\n\nb é"})), ("token", "not json"), ("done", "{}"), ("", "{}")]
    whole = "".join(f"event: {e}\ndata: {d}\n\n" for e, d in parts) + "event: cut\nda"
    chunks = [("s", i, whole[i * size : (i + 1) * size]) for i in range(-(-len(whole) // size))] + [("t", 0, None), ("t", 1, "data: 1\nevent: x\n\n")]
    df = spark.createDataFrame(chunks, "stream string, seq long, chunk string").repartition(3)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, jobs.run_available(jobs.frames(stream), "frames").collect()))
    assert got == [("s", 0, "token", parts[0][1]), ("s", 2, "done", "{}"), ("t", 0, "x", "1")]
    batch = text.frames(text.assembled(df), "text").select("stream", "place", "event", "data")
    assert sorted(map(tuple, batch.collect())) == got


def test_a_key_takes_two_calls_of_state_and_no_copy_of_its_rows(monkeypatch):
    """What a key costs besides its rows: its state is read and written once, its rows are taken from the frame by columns."""
    calls, kept = [], []

    class Value:
        def exists(self):
            calls.append("exists")
            return bool(kept)

        def get(self):
            calls.append("get")
            return kept[-1] if kept else None

        def update(self, value):
            calls.append("update")
            kept.append(value)

    def copied(*args, **kwargs):
        raise AssertionError("a frame was copied")

    processor = jobs.Frames()
    processor.kept, processor.runs = Value(), []
    parts = [pd.DataFrame({"stream": "s", "seq": [3, 1], "chunk": ["a: 1\n\n", "event: e\n"]}), pd.DataFrame({"stream": "s", "seq": [2, 4], "chunk": [None, float("nan")]})]
    more = [pd.DataFrame({"stream": ["s"], "seq": [5], "chunk": ["event: f\ndata: {}\n\nda"]})]
    for name in ("astype", "where", "notna"):
        monkeypatch.setattr(pd.DataFrame, name, copied)
    assert list(processor.handleInputRows(("s",), iter(parts), None)) == [] and kept == [("", 1)]
    (given,) = processor.handleInputRows(("s",), iter(more), None)
    assert given.to_dict("records") == [{"stream": "s", "place": 1, "event": "f", "data": "{}"}] and kept[-1] == ("da", 2)
    assert calls == ["get", "update"] * 2
