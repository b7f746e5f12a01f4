"""X: Structured Streaming twins of the batch features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def ingest_stream(spark: SparkSession, path: str, schema: str, pattern: str | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet folder as a stream; the sink's checkpoint makes it resumable and exactly-once."""
    r = spark.readStream.schema(schema)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run_available(sdf: DataFrame, out: str, checkpoint: str, mode="append") -> DataFrame:
    """Drain what is available into parquet and read it back; a second call continues from the checkpoint."""
    q = sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(out)


def stream_tumbling(sdf, key, ts, dur="5 minutes", late="10 minutes", amount=None, signed=None) -> DataFrame:
    """Count, volume and signed imbalance per key and window; rows behind the watermark are dropped."""
    g = sdf.withWatermark(ts, late).groupBy(F.window(ts, dur), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount).alias("volume"), F.sum(signed).alias("_signed"))
    return g.select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "volume",
                    F.when(F.col("volume") != 0, F.col("_signed") / F.col("volume")).otherwise(0.0).alias("imbalance"))


def stream_sliding(sdf, key, ts, dur="1 hour", slide="5 minutes", late="10 minutes", amount=None) -> DataFrame:
    """Overlapping windows."""
    g = sdf.withWatermark(ts, late).groupBy(F.window(ts, dur, slide), key).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("volume"))
    return g.select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "volume")


def stream_dedup(sdf, keys, ts, late="10 minutes") -> DataFrame:
    """First row per key combination while the watermark remembers it."""
    return sdf.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


class RunningState(StatefulProcessor):
    """Totals of a key and the items met so far, one map entry per item; both end ``idle_ms`` of event time after the key's last row."""

    def __init__(self, names: tuple[str, str, str, str, str], idle_ms: int | None):
        self.key, self.ts, self.order, self.amount, self.item = names
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n bigint, volume double, last_ms bigint")
        self.items = handle.getMapState("items", "item string", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, volume, last = self.totals.get() if self.totals.exists() else (0, 0.0, 0)
        pdf = pd.concat(list(rows)).sort_values([self.ts, self.order], kind="stable")
        amount = pdf[self.amount].fillna(0.0).to_numpy(dtype=float)
        names = pdf[self.item].astype(str)
        counts = names.value_counts()
        new = {i for i in counts.index if not self.items.containsKey((i,))}
        first = (~names.duplicated() & names.isin(new)).to_numpy(dtype="int32")
        before = volume + np.concatenate([[0.0], np.cumsum(amount)])
        out = pd.DataFrame({self.key: key[0], self.order: pdf[self.order].to_numpy(), "prior_count": n + np.arange(len(pdf)),
                            "prior_volume": before[:-1], "first_seen": first})
        for i, c in counts.items():
            self.items.updateValue((i,), (int(c) + (0 if i in new else self.items.getValue((i,))[0]),))
        newest = max(int(last), int(pdf[self.ts].max().timestamp() * 1000))
        self.totals.update((int(n) + len(pdf), float(before[-1]), newest))
        if self.idle_ms is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(newest + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.totals.clear()
        self.items.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_running_state(sdf, key: str, ts: str, order: str, amount: str, item: str, key_type="bigint", late="10 minutes", idle: str | None = None) -> DataFrame:
    """Prior count, prior volume and first-seen flag per row, in event-time order inside a batch.

    State lives in RocksDB, one value per key and one map entry per (key, item), so it is not limited by memory and a row touches
    its own item only.  Rows behind the watermark (``late``) are dropped; a null amount counts as 0.  With ``idle`` a key's state
    ends that long after its last row, in event time, and starts anew with the next row; without it the state is kept, as the
    definition over all prior rows needs.  Twins: W01, W02 and W16.
    """
    spark = sdf.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    out = f"{key} {key_type}, {order} bigint, prior_count bigint, prior_volume double, first_seen int"
    rows = sdf.select(key, ts, order, amount, item).withWatermark(ts, late)
    return rows.groupBy(key).transformWithStateInPandas(
        RunningState((key, ts, order, amount, item), idle_ms), out, "Append", "None" if idle is None else "EventTime")


def stream_enrich(sdf, dim: DataFrame, on) -> DataFrame:
    """Stream joined with a static table; the planner broadcasts it only below its size threshold."""
    return sdf.join(dim, on, "left")
