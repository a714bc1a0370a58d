"""Where jobs keep what they must not lose, and joins that check a size first."""

from __future__ import annotations

import gc
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side of a join is broadcast; a larger side is shuffled.
BROADCAST_BYTES = 16 << 20
#: Whether a job's shuffle files go with its end. Else Spark deletes them when the driver's objects for it are collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_settled: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and all is on one machine (as in tests), one in the session's warehouse."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df in the shared folder and reads it again: lineage ends there, and any executor may go. What was shuffled for it is deleted when it is written."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _settled[out] = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes the files of settled tables that nothing will read any more; other tables are left alone."""
    for table in tables:
        path = _settled.pop(table, None) if table is not None else None
        if path:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def swept(df: DataFrame) -> None:
    """Has the driver collect its garbage: Spark deletes the shuffle files of a finished job only when the driver's objects for it are collected, which may be hours later."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def broadcast_rows(df: DataFrame, limit: int = BROADCAST_BYTES) -> int:
    """Rows of df that fit in ``limit`` bytes of a hashed relation: 48 a row, 8 a number, 32 any other column."""
    return limit // (48 + sum(8 if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else 32 for f in df.schema.fields))


def is_small(side: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """True if a settled table of short columns may be broadcast. It is counted here, no further than the limit."""
    rows = broadcast_rows(side, limit)
    return side.limit(rows + 1).count() <= rows


def small_or_shuffled(side: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """side, marked for broadcast if it takes at most ``limit`` bytes."""
    return F.broadcast(side) if is_small(side, limit) else side


def bounded_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """df, its session set to hand rows to Python in batches of ``size`` bytes, where it has no limit of its own: long texts then take no more memory than short ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if int(conf.get(key).rstrip("bB")) >= 64 << 20:  # the default
        conf.set(key, str(size))
    return df


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one, that no column of df has or begins with."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name
