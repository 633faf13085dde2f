"""Streams: progress events by task, questions against a static table, rate windows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import merge
from itertools import batched
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions import text
from ..operators import curate
from ..sources.scratch import scratch

IDLE_MS = 600_000
EVENTS = "task string, seq long, event string, stage string, current_step int, status string"


#: Rows of a key that are sorted in memory, and sorted runs of them that are merged at a time.
CHUNK, RUNS = 50_000, 24


class InOrder(StatefulProcessor):
    """Sees the rows of a key in order of `seq`, batch by batch, and keeps what `step` needs from one to the next.

    Rows of a batch come in any order. Up to `CHUNK` of them are sorted in memory; beyond that,
    sorted runs go to list state, which is not in memory, and are merged from there. `timed`
    processors forget a key `idle` milliseconds after its last row, by a timer.
    """

    rows, state, out = "", "", ""  # DDL of the rows' columns behind the key, of what is kept, and of what comes out

    def __init__(self, timed: bool = False, idle: int = IDLE_MS):
        self.timed, self.idle = timed, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.state, ttlDurationMs=2 * self.idle if self.timed else None)
        self.runs = [handle.getListState(f"run{i}", self.rows) for i in range(RUNS + 1)]

    def step(self, kept: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        """What to keep after a row, and the rows that it gives, without the key."""
        raise NotImplementedError

    def _sorted(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        names = [c.split()[0] for c in self.rows.split(", ")]
        held: list[tuple] = []
        free, used = list(self.runs), []

        def spill() -> None:
            held.sort(key=itemgetter(0))
            if len(free) == 1:  # all runs to one
                run = free.pop()
                for part in batched(self._merged(used), CHUNK):
                    run.appendList(list(part))
                for other in used:
                    other.clear()
                free.extend(used)
                used[:] = [run]
            run = free.pop()
            run.put(held)
            used.append(run)
            held.clear()

        for frame in frames:
            for row in zip(*([None if x != x else x for x in frame[c].tolist()] for c in names), strict=True):  # NaN is what pandas makes of null
                held.append(row)
                if len(held) >= CHUNK:
                    spill()
        if not used:
            held.sort(key=itemgetter(0))
            yield from held
            return
        if held:
            spill()
        yield from self._merged(used)
        for run in used:
            run.clear()

    @staticmethod
    def _merged(runs: list) -> Iterator[tuple]:
        return merge(*(map(tuple, run.get()) for run in runs), key=itemgetter(0))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        kept = self.kept.get()
        columns, out = [c.split()[0] for c in self.out.split(", ")], []
        for row in self._sorted(rows):
            kept, given = self.step(kept, row)
            out += [(key[0], *x) for x in given]
            if len(out) >= CHUNK:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if kept is not None:
            self.kept.update(tuple(kept))
        if self.timed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        if out:
            yield pd.DataFrame(out, columns=columns)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


def _run(rows: DataFrame, by: str, processor: InOrder) -> DataFrame:
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the state API needs it
    return rows.groupBy(by).transformWithStateInPandas(processor, processor.out, "append", "ProcessingTime" if processor.timed else "None")


class Changes(InOrder):
    """Events whose (stage, step) differs from the last one seen; a terminal status closes a task."""

    rows = "seq long, stage string, current_step int, status string"
    state = "stage string, step int, closed boolean"
    out = EVENTS

    def step(self, kept, row):
        stage, step, closed = kept or (None, -1, False)
        if closed:
            return kept, []
        seq, new_stage, new_step, status = row
        closed = status in ("complete", "failed")
        sent = closed or (new_stage, new_step) != (stage, step)
        event = {"complete": "complete", "failed": "error"}.get(status, "progress")
        return (new_stage, None if new_step is None else int(new_step), closed), [(seq, event, new_stage, new_step, status)] if sent else []


def progress(events: DataFrame, timed: bool = True, idle: int = IDLE_MS) -> DataFrame:
    """Changes of each task from a stream (task, seq, stage, current_step, status).

    Tasks idle for ten minutes are forgotten, unless not `timed`: a stream over what is there
    now must end, and one that waits for the clock does not.
    """
    return _run(events, "task", Changes(timed, idle))


class Order(InOrder):
    """Events that may not follow the one before them in their answer stream, over all batches."""

    rows = "seq long, event string"
    state = "before string"
    out = "stream string, seq long, event string, before string"

    def step(self, kept, row):
        before = kept[0] if kept else None
        seq, event = row
        return (event,), [] if event in text.FOLLOWERS.get(before or "", ()) else [(seq, event, before)]


def order_faults(events: DataFrame) -> DataFrame:
    """`text.order_faults` of a stream of events (stream, seq, event): the last event of each answer stream is state."""
    return _run(events, "stream", Order())


_EVENT, _DATA = (re.compile(f"(?m)^{name}: ?(.*)$") for name in ("event", "data"))


class Frames(InOrder):
    """Whole frames of chunks that may be cut anywhere; what follows the last blank line is kept for the next chunk."""

    rows = "seq long, chunk string"
    state = "tail string, place int"
    out = "stream string, place int, event string, data string"

    def step(self, kept, row):
        tail, place = kept or ("", 0)
        *whole, tail = (tail + (row[1] or "")).split("\n\n")
        given = []
        for frame in whole:
            event, data = _EVENT.search(frame), _DATA.search(frame)
            if event and data and event[1] and _is_json(data[1]):
                given.append((place, event[1], data[1]))
            place += 1
        return (tail, place), given


def _is_json(raw: str) -> bool:
    try:
        json.loads(raw, parse_constant=float.fromhex)  # NaN and Infinity are no JSON, nor hexadecimal
    except ValueError:
        return False
    return True


def frames(chunks: DataFrame) -> DataFrame:
    """(stream, place, event, data) of server-sent events from a stream of chunks (stream, seq, chunk): `text.frames` of each stream's whole text."""
    return _run(chunks, "stream", Frames())


def scan_until(judged: DataFrame, name: str, *, accept: int = curate.ACCEPT, scan: int = curate.SCAN, order: str = "pos", reason: str = "reject_reason") -> DataFrame:
    """The rows that a scan of a stream sees before it has `accept` accepted rows or `scan` rows, then it stops.

    A batch is cut by `curate.first_accepted` with what is left to accept and to scan. What was
    seen so far is counted from what was written, a folder a batch, so a batch that is run again
    replaces itself and the counters need no other state. `seen` and `accepted` count on.
    """
    spark = judged.sparkSession
    path = scratch(spark, name)
    schema = T.StructType([*judged.schema.fields, T.StructField("seen", T.LongType()), T.StructField("accepted", T.LongType())])
    sofar = lambda: spark.read.schema(schema).parquet(path)
    over: list[bool] = []

    def each(batch: DataFrame, number: int) -> None:
        done = sofar().where(F.col("batch") < number) if over_any() else None
        seen, taken = (done.agg(F.coalesce(F.max("seen"), F.lit(0)), F.coalesce(F.max("accepted"), F.lit(0))).first()) if done is not None else (0, 0)
        if taken < accept and seen < scan:
            cut = curate.first_accepted(batch, accept - taken, scan - seen, order, reason)
            cut = cut.withColumn("seen", F.col("seen") + seen).withColumn("accepted", F.col("accepted") + taken)
            cut.select(*schema.names).write.mode("overwrite").parquet(f"{path}/batch={number}")
        else:
            over.append(True)

    def over_any() -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    query = judged.writeStream.foreachBatch(each).option("checkpointLocation", scratch(spark, f"{name}-progress")).trigger(availableNow=True).start()
    while not query.awaitTermination(1) and not over:
        pass
    query.stop()
    return sofar().drop("batch") if over_any() else spark.createDataFrame([], schema)


def with_symbols(questions: DataFrame, names: DataFrame) -> DataFrame:
    """A stream of questions (question_id, question) joined to a static table of names (name, id)."""
    asked = questions.select("question_id", F.explode(text.symbols("question")).alias("name"))
    return asked.join(names, "name")


def rates(requests: DataFrame, key: str, limit: int, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Windows in which a key made more than `limit` requests, from a stream with `ts`."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", window), key).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select(F.col("window.start").alias("start"), key, "n")


def run_available(stream: DataFrame, name: str, timeout: int | None = None) -> DataFrame:
    """Runs a stream over what is there now, however long that takes if there is no `timeout`, into a table, and returns the table."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", scratch(spark, f"{name}-progress")).trigger(availableNow=True).start(path)
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(name)
    return spark.read.schema(stream.schema).parquet(path)
