"""Structured Streaming forms of the batch operators, run over what is available and then stopped."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from factloom.operators.progress import gate_step
from factloom.session import shared_dir


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, one file or a folder, as a stream of its files."""
    path = path.rstrip("/")
    # A stream's plain path must be a folder; a pattern that only this path matches may also be a file.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Append a stream's available rows to a new table in the shared folder and read it back."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    job = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def deduplicated(stream: DataFrame, key: list[str], time: str, delay: str = "45 days") -> DataFrame:
    """The first row of each operation key (ST-2); keys are remembered for `delay` of event time, which bounds the state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def minute_counts(stream: DataFrame, key: str, time: str, limit: int, delay: str = "5 minutes") -> DataFrame:
    """Requests of each key and minute, how many were within the limit and how many not (ST-1); a minute is given out when the watermark has passed it."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, "1 minute"), key).agg(F.count("*").alias("n_requests"))
    over = F.greatest(F.col("n_requests") - limit, F.lit(0))
    return counted.select(F.col("window.start").alias("minute"), key, "n_requests", (F.col("n_requests") - over).alias("n_authorized"), over.alias("n_limited"))


def deliveries(stream: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Queue rows of a stream of events (ST-7): an equi-join with the subscriptions' kinds, with an idempotency key.

    subscriptions: subscription_id, kinds (array, at least one).
    """
    wanted = subscriptions.select("subscription_id", F.explode("kinds").alias("event_type"))
    return stream.join(wanted, "event_type").withColumn("delivery_key", F.concat_ws(":", "subscription_id", "event_id"))


#: transformWithState keeps its values and timers in this store.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_stateful(stream: DataFrame, path: str) -> DataFrame:
    """Append a stateful stream's available rows to `path`/rows, its state beside it, and read all rows there.

    Started again with the same path, a stream goes on where it stopped.
    """
    conf, (name, store) = stream.sparkSession.conf, _STORE
    before = conf.get(name, None)
    conf.set(name, store)
    try:
        job = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


class _Gate(StatefulProcessor):
    """Holds the last release of a key; see gated_releases."""

    def __init__(self, key: str, order: list[str], value: str, good: str, ratio: float):
        self.key, self.order, self.value, self.good, self.ratio = key, order, value, good, ratio

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "release double")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable", na_position="first")
        last = self.last.get()[0] if self.last.exists() else None
        before, made = last, []
        for v, good in zip(batch[self.value].astype(object), batch[self.good].astype(object), strict=True):
            last, *out = gate_step(self.ratio, last, None if pd.isna(v) else v, False if pd.isna(good) else bool(good))
            made.append(out)
        if last is not None and last != before:
            self.last.update((last,))
        batch["gate_decision"], batch["released_value"] = [m[0] for m in made], pd.Series([m[1] for m in made], index=batch.index, dtype="float64")
        yield batch

    def close(self) -> None:
        pass


def gated_releases(stream: DataFrame, key: str, order: list[str], value: str, good: str, ratio: float = 0.5, path: str | None = None) -> DataFrame:
    """A stream's available rows through the gate with last-known-good (ST-3), as progress.released_values does for a table.

    The last release of each key is a value in the state store: a batch reads
    and writes the state of its own keys only, and only where it changed. Rows
    of one batch are taken in event order, so a task holds a key's rows of one
    batch; a row that comes in a later batch counts as later. Null keys are one
    key. path: where rows and state are kept, to go on from later; a new folder
    if none is given.
    """
    path = path or f"{shared_dir(stream.sparkSession)}/gated-{uuid.uuid4().hex}"
    schema = T.StructType([*stream.schema.fields, T.StructField("gate_decision", T.StringType()), T.StructField("released_value", T.DoubleType())])
    gated = stream.groupBy(key).transformWithStateInPandas(statefulProcessor=_Gate(key, order, value, good, ratio), outputStructType=schema, outputMode="Append", timeMode="None")
    return run_stateful(gated, path)


class _Expiry(StatefulProcessor):
    """Holds when a fact was last verified, with a timer at its deadline; see expiries."""

    def __init__(self, keys: list[str], verified: str, ttl_ms: int):
        self.keys, self.verified, self.ttl_ms = keys, verified, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("verified", "micros long")

    def handleInputRows(self, key, rows, timerValues):
        newest = max((t.value // 1000 for batch in rows for t in batch[self.verified] if not pd.isna(t)), default=None)
        before = self.at.get()[0] if self.at.exists() else None
        if newest is not None and (before is None or newest > before):
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.ttl_ms)
            self.at.update((newest,))
            self.handle.registerTimer(newest // 1000 + self.ttl_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        deadline = pd.Timestamp(self.at.get()[0] + self.ttl_ms * 1000, unit="us")
        yield pd.DataFrame([[*key, deadline]], columns=[*self.keys, "deadline"])

    def close(self) -> None:
        pass


def expiries(stream: DataFrame, keys: list[str], verified: str, ttl_seconds: int, delay: str = "0 seconds", path: str | None = None) -> DataFrame:
    """Facts that turn stale without any new row of their own (ST-4): keys and deadline, once for each time that a deadline passes.

    Each fact has one event-time timer, ttl_seconds after it was last verified;
    a newer row moves the timer. It fires when the latest event time of the
    whole stream, less `delay`, is past the deadline, as timers do in whole
    milliseconds; rows later than that are not taken. Rows without a time change nothing. path: as
    in gated_releases.
    """
    path = path or f"{shared_dir(stream.sparkSession)}/expiries-{uuid.uuid4().hex}"
    fields = [f for k in keys for f in stream.schema.fields if f.name == k]
    schema = T.StructType([*fields, T.StructField("deadline", T.TimestampType())])
    rows = stream.select(*keys, verified).withWatermark(verified, delay)
    fired = rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Expiry(keys, verified, ttl_seconds * 1000), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return run_stateful(fired, path)


def expired(facts: DataFrame, verified: str, ttl_seconds: int, clock: DataFrame, time: str) -> DataFrame:
    """Facts that turned stale without any new row of their own (ST-4): past the deadline by a stream's latest event time.

    clock: what has arrived so far; no clock, no expiry. Adds deadline.
    """
    now = clock.agg(F.max(F.col(time).cast("timestamp"))).first()[0]
    due = facts.withColumn("deadline", F.timestamp_micros(F.unix_micros(F.col(verified).cast("timestamp")) + ttl_seconds * 1_000_000))
    return due.where(F.col("deadline") < F.lit(now).cast("timestamp"))
