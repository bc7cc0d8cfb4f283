"""Streams with typed state and timers: joins that wait for a late side, and the Kalman filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from touchline.operators.groups import starts
from touchline.operators.stateful import NUMBERS, KalmanSeries

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


def deferred_join(requests: DataFrame, results: DataFrame, key: str, wait: Column, late: str) -> DataFrame:
    """Requests (key, asked_at, ...) with each result (key, ready_at, ...) ready from asked_at until ``wait`` after it; a request without any comes once, with nulls.

    Both sides are streams, of which either may be late by ``late``. A request is kept until the watermark of
    both sides has passed its time and wait: only then it is known that no result can come any more. wait is an interval expression.
    """
    left = requests.withWatermark("asked_at", late)
    right = results.withColumnRenamed(key, "__key").withWatermark("ready_at", late)
    near = (F.col(key) == F.col("__key")) & (F.col("ready_at") >= F.col("asked_at")) & (F.col("ready_at") <= F.col("asked_at") + wait)
    return left.join(right, near, "left_outer").drop("__key")


class KalmanProcessor(StatefulProcessor):
    """Filters the frames of the series of a group as they come; a timer drops series that have ended.

    State, an entry or NUMBERS entries a series: its key, last time and frame, and its filter's numbers. It is read and written once a batch
    and group, because a call and a round trip to the store a series would cost more than its filter.
    """

    def __init__(self, key: str, kind: str, idle_ms: int):
        self.key, self.kind, self.idle_ms = key, kind, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", f"keys array<{self.kind}>, last array<long>, frame array<long>, numbers array<double>")

    def _read(self) -> dict:
        if not self.state.exists():
            return {}
        keys, last, frame, numbers = self.state.get()
        return {k: (t, KalmanSeries.of(f, numbers[i * NUMBERS : (i + 1) * NUMBERS])) for i, (k, t, f) in enumerate(zip(keys, last, frame, strict=True))}

    def _write(self, held: dict) -> None:
        if not held:
            self.state.clear()
            return
        numbers = [x for _, series in held.values() for x in series.numbers()]
        self.state.update((list(held), [t for t, _ in held.values()], [int(series.frame) for _, series in held.values()], numbers))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values([self.key, "frame"]).reset_index(drop=True)
        heads = np.append(starts(frames, [self.key]), len(frames))
        names, at_ms, numbers = frames[self.key].tolist(), frames["at_ms"].to_numpy(), frames["frame"].to_numpy()
        boxes = frames[["cx", "cy", "aspect", "h"]].to_numpy(float)
        path, gate, held = np.empty((len(frames), 4)), np.empty(len(frames)), self._read()
        for low, high in zip(heads[:-1], heads[1:], strict=True):
            last, series = held.get(names[low], (0, KalmanSeries()))
            path[low:high], gate[low:high] = series.follow(numbers[low:high], boxes[low:high])
            held[names[low]] = max(last, int(at_ms[low:high].max())), series
        self._write(held)
        self.handle.registerTimer(max(last for last, _ in held.values()) + self.idle_ms)
        out = pd.DataFrame({"key": frames[self.key], "frame": numbers})
        for i, c in enumerate(("cx", "cy", "aspect", "h")):
            out[c] = path[:, i]
        out["gate"] = gate
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() - self.idle_ms
        held = self._read()
        kept = {k: v for k, v in held.items() if v[0] > end}
        if len(kept) < len(held):
            self._write(kept)
        return iter(())

    def close(self) -> None:
        pass


def kalman_stream(measures: DataFrame, key: str, checkpoint: str, out: str, late: str = "1 hour", idle_ms: int = 3_600_000, groups: int = 1024) -> StreamingQuery:
    """Filtered boxes of a stream of measures (key, at, frame, cx, cy, aspect, h; nulls where nothing was seen), appended to ``out``.

    Frames of a series must come in order from batch to batch; within one they are sorted. Frames
    left out are steps without a measure. Series, whose keys are not null, are dealt by hash into groups, whose state is held at once; their number must stay as it is while
    the checkpoint is used. A series is forgotten when the watermark, ``late`` behind
    the latest time ``at``, is idle_ms past its last frame and the last one that its group had in its last batch.
    """
    spark = measures.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # the only store that keeps typed state and timers
    kind = measures.schema[key].dataType.simpleString()
    schema = f"key {kind}, frame long, cx double, cy double, aspect double, h double, gate double"
    numbers = (F.col(c).cast("double").alias(c) for c in ("cx", "cy", "aspect", "h"))
    try:
        rows = measures.withWatermark("at", late).select(key, "at", F.unix_millis("at").alias("at_ms"), F.col("frame").cast("long").alias("frame"), *numbers)
        dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(key), F.lit(groups)))
        found = dealt.groupBy("__deal").transformWithStateInPandas(KalmanProcessor(key, kind, idle_ms), schema, "Append", "EventTime")
        writer = found.withColumnRenamed("key", key).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)


def read_rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream over the turns of a folder (windows.in_turns)."""
    return spark.readStream.schema(schema).parquet(f"{folder}/turn=*")
