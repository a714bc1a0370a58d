"""Folders that the driver and all executors share, and files that appear in them whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and all is on one machine, as in tests, a folder of the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, none if it is not there."""
    fs = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(_path(spark, folder))) if fs.exists(_path(spark, folder)) else []


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file under another name and renames it into place: readers see all of it or none. False if the place is taken.

    The rename is atomic where the store's is (HDFS, local files); names that begin with _ are not read by Spark.
    """
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/_{name}.{uuid.uuid4().hex}"
    fs = _file_system(spark, path)
    out = fs.create(_path(spark, draft), False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri() if "://" in path else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(_path(spark, draft), _path(spark, path), options)
    except Exception:
        fs.delete(_path(spark, draft), False)
        if fs.exists(_path(spark, path)):
            return False
        raise
    return True
