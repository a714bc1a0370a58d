"""Structured Streaming forms of the incremental operators.

State is bounded by watermarks, which the batch forms do not need; they are
arguments, and so are all thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import logs


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """STM01/SRC01: files that drop into a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_of_key(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """STM04/SNK01: one row of each key while the watermark remembers it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, length: str, *dims: str, ts: str = "ts", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """STM10: counts by tumbling or sliding windows."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *dims).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *dims, "n")


def window_bans(stream: DataFrame, key: str, most: int, find: str = "600 seconds", slide: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """STM06: keys with ``most`` events or more in a sliding window; bans are found to within a slide."""
    return counts_by_window(stream, find, key, slide=slide, late=late).where(F.col("n") >= most)


def classified_lines(lines: DataFrame) -> DataFrame:
    """STM05/STM07/SRC11: lines of an access log with class and latency band; stateless."""
    rows = logs.parse_access(lines)
    return rows.withColumn("category", logs.access_class()).withColumn("band", logs.realtime_band(F.col("request_time")))


def _seconds(stream: DataFrame, key: str, late: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return stream.select(F.col(key).cast("string").alias(key), at.alias("ts"), (F.unix_micros(at) / 1e6).alias("s")).withWatermark("ts", late)


def _keep_until(state: GroupState, second: float) -> None:
    """The state goes once the watermark has passed a time."""
    state.setTimeoutTimestamp(max(int(second * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def exact_bans(stream: DataFrame, key: str, most: int, find_s: int = 600, ban_s: int = 3600, late: str = "10 minutes") -> DataFrame:
    """STM06: (key, from_s, until_s): a ban begins with the event that makes ``most`` within ``find_s`` seconds, and events during a ban do not count. stream: key, ts.

    A key's state is dropped when neither its events nor its ban matter to the watermark any more.
    """
    schema = f"{key} string, from_s double, until_s double"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, until = state.get if state.exists else ([], 0.0)
        recent, out = list(recent), []
        times = sorted(t for pdf in batches for t in pdf["s"])
        for t in times:
            if t < until:
                continue
            recent = [r for r in recent if r > t - find_s] + [t]
            if len(recent) >= most:
                until = t + ban_s
                out.append((k[0], t, until))
                recent = []
        state.update((recent, until))
        _keep_until(state, max([until, *(r + find_s for r in recent)]))
        yield pd.DataFrame(out, columns=[key, "from_s", "until_s"])

    rows = _seconds(stream, key, late)
    return rows.groupBy(key).applyInPandasWithState(run, schema, "recent array<double>, until double", "append", GroupStateTimeout.EventTimeTimeout)


def admit(times: list[float], rate: float, burst: int, level: float = 0.0, last: float | None = None) -> tuple[list[bool], float, float | None]:
    """STM08: a leaky bucket: for each time (ascending) whether it is admitted; with the bucket's level and time afterwards."""
    out = []
    for t in times:
        leaked = max(0.0, level - (t - last) * rate) if last is not None else 0.0
        ok = leaked + 1 <= burst + 1
        out.append(ok)
        level, last = (leaked + 1 if ok else leaked), t
    return out, level, last


def rate_limited(stream: DataFrame, key: str, rate: float, burst: int, late: str = "10 minutes") -> DataFrame:
    """STM08: (key, s, status): 200 or 429 for each event, by a leaky bucket of each key; an empty bucket is dropped."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, last = state.get if state.exists else (0.0, None)
        times = sorted(t for pdf in batches for t in pdf["s"])
        ok, level, last = admit(times, rate, burst, level, last)
        state.update((level, last))
        _keep_until(state, last + level / rate)
        yield pd.DataFrame({key: [k[0]] * len(times), "s": times, "status": [200 if x else 429 for x in ok]})

    rows = _seconds(stream, key, late)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} string, s double, status int", "level double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def split_dead_letters(batch: DataFrame, valid, write_good, write_bad) -> None:
    """STM01: for foreachBatch: rows that fail ``valid`` go to the dead-letter writer, the others on."""
    marked = batch.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    write_good(marked.where("_ok").drop("_ok"))
    write_bad(marked.where("not _ok").drop("_ok"))
