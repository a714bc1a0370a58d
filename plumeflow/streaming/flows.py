"""Flows that run as far as there is input, stop, and go on from their checkpoint: followed logs, bans, polled mail.

Each takes a folder that files drop into, a checkpoint folder and a sink folder. Sinks are partitions by batch id that a
repeated batch overwrites with the same rows, so that a run which ended between sink and commit changes nothing when it is done again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import shared
from .events import classified_lines

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def land(rows: DataFrame, folder: str, as_text: bool = False) -> None:
    """Adds files to a folder that a flow reads."""
    if as_text:
        rows.write.mode("append").text(folder)
    else:
        rows.write.mode("append").parquet(folder)


def drain(stream: DataFrame, checkpoint: str, write, mode: str = "append") -> None:
    """Runs a stream over all that has arrived, from where the checkpoint ends, and stops. write(batch, id) has to be idempotent."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def to_folder(sink: str):
    """A writer of each batch to its own partition; empty batches leave nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return write


def read_sink(spark: SparkSession, sink: str, schema: T.StructType | str) -> DataFrame:
    """All batches of a sink, with their id as ``batch``."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not shared.exists(spark, sink):
        return spark.createDataFrame([], kind).withColumn("batch", F.lit(0).cast("long"))
    return spark.read.schema(T.StructType([*kind.fields, T.StructField("batch", T.LongType())])).parquet(sink)


# --- followed logs ----------------------------------------------------------------------------------------------------

BANDS = "start timestamp, category string, band string, n long"


def follow_log(spark: SparkSession, folder: str, checkpoint: str, sink: str, window: str = "1 hour", late: str = "1 day") -> None:
    """SRC11/STM05/STM07: counts of parsed lines by window, class and latency band; a window's counts are kept until the watermark passes it.

    Each batch writes the counts that it has changed; ``band_counts`` takes the last of each.
    """
    lines = spark.readStream.schema("line string").text(folder).withColumn("line_no", F.lit(0).cast("long"))
    rows = classified_lines(lines).where("parsed").withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", window).alias("w"), "category", "band").agg(F.count("*").alias("n"))
    drain(counts.select(F.col("w.start").alias("start"), "category", "band", "n"), checkpoint, to_folder(sink), "update")


def band_counts(spark: SparkSession, sink: str) -> DataFrame:
    return read_sink(spark, sink, BANDS).groupBy("start", "category", "band").agg(F.max_by("n", "batch").alias("n"))


# --- bans -------------------------------------------------------------------------------------------------------------

BANNED = "key string, from_us long, until_us long"


class Bans(StatefulProcessor):
    """STM06: state of a key: the times of up to ``most`` - 1 events that still count, and the end of its ban; a timer drops both when neither matters any more."""

    def __init__(self, most: int, find_us: int, ban_us: int):
        self.most, self.find_us, self.ban_us = most, find_us, ban_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "t long")
        self.until = handle.getValueState("until", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for part in rows for t in part["t"])
        recent = [t for (t,) in self.recent.get()]
        until = self.until.get()[0] if self.until.exists() else times[0]
        found = []
        for t in times:
            if t < until:
                continue
            recent = [r for r in recent if t - r < self.find_us] + [t]
            if len(recent) == self.most:
                until, recent = t + self.ban_us, []
                found.append((str(key[0]), t, until))
        if recent:
            self.recent.put([(t,) for t in recent])
        else:
            self.recent.clear()
        self.until.update((until,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max([until, *(t + self.find_us for t in recent)]) // 1000 + 1)
        yield pd.DataFrame(found, columns=["key", "from_us", "until_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.until.clear()
        yield pd.DataFrame({"key": [], "from_us": [], "until_us": []}).astype({"key": str, "from_us": "int64", "until_us": "int64"})

    def close(self) -> None:
        pass


def ban_flow(spark: SparkSession, folder: str, schema: T.StructType, checkpoint: str, sink: str, key: str, most: int, find_s: int, ban_s: int, late: str = "10 minutes") -> None:
    """Bans from files of events (key, ts) that arrive in order of time, up to ``late``."""
    events = spark.readStream.schema(schema).parquet(folder).select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    rows = events.where("ts is not null").withColumn("t", F.unix_micros("ts")).withWatermark("ts", late)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # the store that lists and timers need
    try:
        out = rows.groupBy("key").transformWithStateInPandas(Bans(most, find_s * 1_000_000, ban_s * 1_000_000), BANNED, "Append", "EventTime")
        drain(out, checkpoint, to_folder(sink))
    finally:
        spark.conf.set(_PROVIDER, before)


# --- polled mail ------------------------------------------------------------------------------------------------------


def route_mail(spark: SparkSession, folder: str, keys: list[str], reason: Column):
    """STM01: a writer of batches: mails with a reason against them go to ``bad``, the first of each key that no earlier batch has to ``good``.

    What earlier batches have is read from the sink, without this batch and later ones, so that a batch which is
    done again finds what it found before. Keys are compared null-safely.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("reason", reason)
        marked.where("reason is not null").write.mode("overwrite").parquet(f"{folder}/bad/batch={batch_id}")
        good = marked.where("reason is null").drop("reason").dropDuplicates(keys)
        known = read_sink(spark, f"{folder}/good", batch.schema).where(F.col("batch") < batch_id).select(F.struct(*keys).alias("_k"))
        new = good.withColumn("_k", F.struct(*keys)).join(known, "_k", "left_anti").drop("_k")
        new.write.mode("overwrite").parquet(f"{folder}/good/batch={batch_id}")

    return write


def mail_flow(spark: SparkSession, inbox: str, schema: T.StructType, checkpoint: str, folder: str, keys: list[str], reason: Column, files_per_batch: int = 10) -> None:
    """STM01/SRC01: takes what has arrived in the inbox, a few files a batch, and routes it."""
    mails = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)
    drain(mails, checkpoint, route_mail(spark, folder, keys, reason))
