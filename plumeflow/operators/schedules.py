"""STM03: when triggers fire, as tables, and which firing takes an event. Times are microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sequential as seq

SECOND = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def fixed_rate(spark: SparkSession, start_us: int, end_us: int, every_s: int) -> DataFrame:
    """Fire times from start on, every so many seconds, up to the end."""
    return spark.range(max(0, (end_us - start_us) // (every_s * SECOND) + 1)).select((F.lit(start_us) + F.col("id") * (every_s * SECOND)).alias("fire"))


def calendar(spark: SparkSession, first_day: str, days: int, at: str, zone: str, weekdays: tuple[int, ...] = ()) -> DataFrame:
    """Fire times at a time of day ('HH:MM') in a zone, on the given days of the week (1 is Monday; none given: all)."""
    day = F.date_add(F.lit(first_day).cast("date"), F.col("id").cast("int"))
    rows = spark.range(days).select(day.alias("day"))
    if weekdays:
        rows = rows.where((F.weekday("day") + 1).isin(*weekdays))
    local = F.concat(F.col("day").cast("string"), F.lit(f" {at}:00 {zone}")).cast("timestamp")
    return rows.select(F.unix_micros(local).alias("fire"))


def fixed_delay(runs: DataFrame, order: str, took_us: Column, start_us: int, delay_s: int) -> DataFrame:
    """Runs, one after the other, with fire: each begins ``delay_s`` seconds after the end of the one before, which takes ``took_us``.

    A prefix sum of what the earlier runs take, over slices.
    """
    whole = took_us.cast("long") + delay_s * SECOND
    out = seq.running(runs.withColumn("_one", F.lit(1)), ["_one"], [order], {"_upto": ("sum", whole)})
    return out.select(*runs.columns, (F.lit(start_us) + F.col("_upto") - whole).alias("fire"))


def taken_by(events: DataFrame, fires: DataFrame, at: Column, group: list[str]) -> DataFrame:
    """events with fire: the first firing of the same group at the event's time or later; null if there is none."""
    return seq.nearest(fires.withColumn("_fire", F.col("fire")), events, group, "fire", "_fire", at, "fire", after=True)
