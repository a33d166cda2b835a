"""The incremental computations as Structured Streaming queries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cinderframe.operators.evidence import CANDIDATE_ATTEMPTS, MISSING
from cinderframe.sources.telemetry import classify_lines, typed_events

#: Process what is there, then stop.
ONCE = {"availableNow": True}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs a state store that spills; has to be set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Telemetry lines as they are appended to a folder."""
    return spark.readStream.text(folder).withColumnRenamed("value", "line")


def start_ingest(
    lines: DataFrame, events_path: str, malformed_path: str, checkpoint: str, keep: list[str], trigger: dict | None = None
) -> StreamingQuery:
    """Typed events to one sink, unreadable lines to another.

    Each batch writes its own folder, so a batch that runs again replaces what it wrote before. `trigger` is what
    `DataStreamWriter.trigger` takes, such as `{"processingTime": "10 seconds"}`; without, everything available is processed once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        classified = classify_lines(batch).persist()
        try:
            typed_events(classified, keep).write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")
            unreadable = classified.where("malformed").select(*keep, "line")
            unreadable.write.mode("overwrite").parquet(f"{malformed_path}/batch={batch_id}")
        finally:
            classified.unpersist()

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    """Times as they are written to a folder by `beat`: how far the clock of a stream has come."""
    return spark.readStream.schema("beat timestamp").parquet(folder)


def beat(spark: SparkSession, folder: str, at: datetime) -> None:
    """Say that no row before `at` is to come, apart from what the stream's delay allows."""
    spark.createDataFrame([(at,)], "beat timestamp").write.mode("append").parquet(folder)


def with_heartbeat(stream: DataFrame, beats: DataFrame, time: str, delay: str) -> DataFrame:
    """The stream with a watermark that follows its own rows and the heartbeat.

    Without new rows a watermark stands still, and the newest windows and deadlines with it. Heartbeats pass the
    watermark as rows without values and are left out behind it.
    """
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields if f.name != time]
    marks = beats.select(F.col("beat").cast(stream.schema[time].dataType).alias(time), *empty, F.lit(True).alias("_beat"))
    both = stream.withColumn("_beat", F.lit(False)).unionByName(marks).withWatermark(time, delay)
    # a condition on the time stays above the watermark
    return both.where(F.when(F.col(time).isNull(), False).otherwise(~F.col("_beat"))).drop("_beat")


def windowed_throughput(
    events: DataFrame, keys: list[str], time: str, value: str, window: str = "1 hour", delay: str = "10 minutes",
    accuracy: int | None = None, beats: DataFrame | None = None,
) -> DataFrame:
    """Checks and p95 per tumbling window; rows later than `delay` are dropped.

    A window is told when the watermark has passed its end; with heartbeats `beats`, that needs no later row of the stream.
    With `accuracy` the percentile is approximate and its state bounded; without, it is exact and the
    state of an open window grows with its distinct values.
    """
    if accuracy:
        p95 = F.percentile_approx(value, 0.95, accuracy)
    else:
        p95 = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").cast("long")
    counted = (
        (events.withWatermark(time, delay) if beats is None else with_heartbeat(events, beats, time, delay))
        .groupBy(*keys, F.window(time, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("checks"), F.sum(value).alias("busy_ns"), p95.alias("p95_ns"))
    )
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return counted.select(
        *keys,
        F.col("w.start").alias("window_start"),
        "checks",
        "busy_ns",
        "p95_ns",
        (F.col("checks") / seconds).alias("checks_per_second"),
    )


def first_seen(reports: DataFrame, fingerprint: str, time: str, delay: str) -> DataFrame:
    """First report of each fingerprint; a fingerprint may come again after `delay` without one."""
    return reports.withWatermark(time, delay).dropDuplicatesWithinWatermark([fingerprint])


class _RetryFold(StatefulProcessor):
    """Attempts of one candidate in order; one verdict, at the deadline at the latest, then silence."""

    def __init__(self, max_attempts: int, patience_ms: int | None):
        self.max_attempts, self.patience_ms = max_attempts, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "due int, held string, seen int, deadline bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, held, seen, deadline = 1, {}, 0, None
        if self.progress.exists():
            due, text, seen, deadline = self.progress.get()
            held = json.loads(text)
        latest = None
        for frame in rows:
            if due:
                kept = frame[frame["attempt"].between(due, self.max_attempts)]
                held.update({str(a): r for a, r in zip(kept["attempt"], kept["result"])})
                seen = max([seen, *map(int, kept["attempt"])])
            if self.patience_ms is not None and len(frame):
                newest = frame["time"].max()
                latest = newest if latest is None else max(latest, newest)
        verdict = None
        while due and str(due) in held:
            result = held.pop(str(due))
            if result != MISSING or due == self.max_attempts:
                verdict, due, held = (result, due), 0, {}
            else:
                due += 1
        if latest is not None:
            wanted = int(latest.timestamp() * 1000) + self.patience_ms
            if deadline is None or wanted > deadline:
                if deadline is not None:
                    self.handle.deleteTimer(deadline)
                self.handle.registerTimer(wanted)
                deadline = wanted
        self.progress.update((due, json.dumps(held), seen, deadline))
        if verdict:
            yield self._told(key, verdict)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The deadline: what arrived ahead of its turn counts now, and nothing is kept."""
        if self.progress.exists():
            due, text, seen, _ = self.progress.get()
            held = json.loads(text)
            self.progress.clear()
            if due:
                decided = [int(a) for a, r in held.items() if r != MISSING]
                yield self._told(key, (held[str(min(decided))], min(decided)) if decided else (MISSING, seen))

    @staticmethod
    def _told(key, verdict) -> pd.DataFrame:
        return pd.DataFrame({"candidate": [key[0]], "verdict": [verdict[0]], "attempts": [verdict[1]]})

    def close(self) -> None:
        pass


def retry_verdicts(
    attempts: DataFrame, max_attempts: int = CANDIDATE_ATTEMPTS, time: str | None = None, patience_s: int = 3600,
    delay: str = "10 minutes", beats: DataFrame | None = None,
) -> DataFrame:
    """Verdict per candidate as soon as it is decided or its attempts are used up.

    `attempts`: `candidate bigint`, `attempt`, `result`. State per candidate is at most the attempts
    that arrived ahead of their turn. With a `time` column, a candidate that is undecided `patience_s` seconds after its newest
    attempt is told as it stands, and its state is removed, decided or not; the clock is the watermark, which heartbeats
    `beats` move on. Without one, nobody waits in vain only if every candidate uses its attempts up, and state stays.
    """
    use_rocksdb(attempts.sparkSession)
    kept = attempts
    if time is not None:
        timed = attempts.withColumnRenamed(time, "time")
        kept = timed.withWatermark("time", delay) if beats is None else with_heartbeat(timed, beats, "time", delay)
    return kept.groupBy("candidate").transformWithStateInPandas(
        _RetryFold(max_attempts, None if time is None else patience_s * 1000),
        outputStructType="candidate bigint, verdict string, attempts bigint",
        outputMode="Append",
        timeMode="None" if time is None else "EventTime",
    )


class _ContentChanges(StatefulProcessor):
    """Accepted checks of one run whose content differs from the one kept before."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "t_ns bigint, content bigint, deadline bigint")

    def handleInputRows(self, key, rows, timerValues):
        last, deadline = None, None
        if self.kept.exists():
            *last, deadline = self.kept.get()
        changes = []
        # all rows of the micro-batch in one order; how Arrow cuts them into frames must not matter
        for t, content in sorted((int(t), int(c)) for frame in rows for t, c in zip(frame["t_ns"], frame["content"])):
            if last is not None and t < last[0]:
                continue
            if last is None or content != last[1]:
                changes.append((key[0], t, content))
            last = (t, content)
        if last is not None:
            wanted = None if self.idle_ms is None else last[0] // 1_000_000 + self.idle_ms
            if wanted != deadline:
                if deadline is not None:
                    self.handle.deleteTimer(deadline)
                self.handle.registerTimer(wanted)
            self.kept.update((*last, wanted))
        if changes:
            yield pd.DataFrame(changes, columns=["run", "t_ns", "content"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


def snapshot_changes(accepted: DataFrame, idle_s: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """Every change of the snapshot of a run: `accepted(run, t_ns, content)`.

    The rows of a run in one micro-batch are taken in the order of time; a row behind what an earlier
    batch kept is stale. A task holds one run's rows of one micro-batch, which the source's rate limits. With
    `idle_s`, a run without a row for that long, by the watermark of the row times, is forgotten; if it comes back, its first
    snapshot counts as a change.
    """
    use_rocksdb(accepted.sparkSession)
    timed = accepted
    if idle_s is not None:
        timed = accepted.withColumn("time", F.timestamp_micros(F.call_function("div", F.col("t_ns"), F.lit(1000).cast("long")))).withWatermark("time", delay)
    return timed.groupBy("run").transformWithStateInPandas(
        _ContentChanges(None if idle_s is None else idle_s * 1000),
        outputStructType="run bigint, t_ns bigint, content bigint",
        outputMode="Append",
        timeMode="None" if idle_s is None else "EventTime",
    )


def run_to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> None:
    """Process everything available into parquet, then stop; with another `trigger`, go on until the query is stopped.

    In update mode each batch replaces its own folder; the reader takes the highest batch.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE))
    if mode == "update":
        save = lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")
        query = writer.outputMode("update").foreachBatch(save).start()
    else:
        query = writer.outputMode(mode).format("parquet").start(path)
    query.awaitTermination()
