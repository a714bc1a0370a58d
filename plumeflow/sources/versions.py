"""Tables that are replaced as a whole: snapshots of two tables published together, and a daily archive with history.

Data are written first, in folders of their own, and a small manifest, renamed into place, makes them visible.  A writer that
is lost leaves folders that no manifest names, which no reader sees; its work can be done again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sequential import kept
from . import shared

_MANIFEST = "day string, status string, n_items long, error string, version string"


class Snapshots:
    """SNK09: one snapshot of header and items for each day; the first that is published for a day stays.

    A computation that fails publishes a header FAILED with no items, and its error goes on to the caller; a later
    success takes the place of failures. item_schema is that of the items.
    """

    def __init__(self, spark: SparkSession, folder: str, item_schema: T.StructType | str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = T._parse_datatype_string(item_schema) if isinstance(item_schema, str) else item_schema

    def save(self, day: str, compute: Callable[[], DataFrame]) -> bool:
        """Computes, writes and publishes the items of a day. False, with nothing visible, if the day has a snapshot already."""
        if f"{day}.SUCCESS.json" in shared.names(self.spark, f"{self.folder}/manifest"):
            return False
        version = uuid.uuid4().hex
        try:
            compute().write.parquet(f"{self.folder}/items/version={version}")
            n = self.spark.read.schema(self.schema).parquet(f"{self.folder}/items/version={version}").count()
        except Exception as x:
            self._publish(day, "FAILED", 0, version, f"{type(x).__name__}")
            raise
        return self._publish(day, "SUCCESS", n, version, None)

    def _publish(self, day: str, status: str, n: int, version: str, error: str | None) -> bool:
        manifest = json.dumps({"day": day, "status": status, "n_items": n, "error": error, "version": version})
        return shared.publish(self.spark, f"{self.folder}/manifest/{day}.{status}.json", manifest)

    def headers(self) -> DataFrame:
        """(day, status, n_items, error, version), one row for each day: the success if there is one."""
        folder = f"{self.folder}/manifest"
        if not shared.exists(self.spark, folder):
            return self.spark.createDataFrame([], _MANIFEST)
        rows = self.spark.read.schema(_MANIFEST).json(folder)
        return rows.groupBy("day").agg(F.max_by(F.struct("status", "n_items", "error", "version"), F.col("status")).alias("h")).select("day", "h.*")

    def items(self) -> DataFrame:
        """Items of all published snapshots, with their day; headers are few, one for each day."""
        folder = f"{self.folder}/items"
        good = self.headers().where("status = 'SUCCESS'").select("day", "version")
        if not shared.exists(self.spark, folder):
            return self.spark.createDataFrame([], self.schema).join(good.select("day"), F.lit(False))
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("version", T.StringType())])).parquet(folder)
        return rows.join(F.broadcast(good), "version").drop("version")


class Archive:
    """SNK10: what each user was shown on a day, with history: versions with valid_from and valid_to, and reads as of a time.

    ``history`` holds every version that was saved, in partitions (day, valid_from) that a repeated save replaces
    with the same rows. ``current`` holds the last version of each user, in partitions by day that are overwritten one by one.
    A user's archive of a day can be refreshed ``refreshes`` times. rows: user_id and any columns, several rows for a user.
    """

    def __init__(self, spark: SparkSession, folder: str, refreshes: int = 1):
        self.spark, self.folder, self.refreshes = spark, folder.rstrip("/"), refreshes

    def save(self, rows: DataFrame, day: str, at: str) -> DataFrame:
        """Saves rows as the version of ``at`` for those users who may have one (a first one, or a refresh that is left), and returns these users."""
        users = rows.select("user_id").distinct()
        if shared.exists(self.spark, f"{self.folder}/history"):
            earlier = self._read("history").where((F.col("day") == day) & (F.col("valid_from") < at))
            had = earlier.select("user_id", "valid_from").distinct().groupBy("user_id").agg(F.count("*").alias("n"))
            users = users.join(had.where(F.col("n") > self.refreshes), "user_id", "left_anti")
        users = kept(users)
        new = kept(rows.join(users, "user_id", "left_semi").withColumns({"day": F.lit(day), "valid_from": F.lit(at)}))
        self._overwrite(new, "history", "day", "valid_from")
        if shared.exists(self.spark, f"{self.folder}/current"):
            # what stays of the day is read in full before its partition is overwritten
            others = self._read("current").where(F.col("day") == day).join(users, "user_id", "left_anti")
            new = kept(new.unionByName(others))
        self._overwrite(new, "current", "day")
        return users

    def _overwrite(self, rows: DataFrame, table: str, *by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{table}")

    def _read(self, table: str) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(f"{self.folder}/{table}")
        return rows.withColumns({c: F.col(c).cast("string") for c in ("day", "valid_from") if c in rows.columns})

    def current(self, day: str) -> DataFrame:
        return self._read("current").where(F.col("day") == day)

    def history(self) -> DataFrame:
        """All versions with valid_to, which is null for the last one of a user and day."""
        rows = self._read("history")
        versions = rows.select("user_id", "day", "valid_from").distinct()
        later = versions.select("user_id", "day", F.col("valid_from").alias("_later"))
        # a user has at most ``refreshes`` + 1 versions of a day, so that this join stays small
        ends = versions.join(later, ["user_id", "day"]).groupBy("user_id", "day", "valid_from").agg(F.min(F.when(F.col("_later") > F.col("valid_from"), F.col("_later"))).alias("valid_to"))
        return rows.join(ends, ["user_id", "day", "valid_from"])

    def as_of(self, at: str) -> DataFrame:
        """The rows that were valid at a time."""
        return self.history().where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
