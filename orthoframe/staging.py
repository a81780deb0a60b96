"""Tables that a computation writes once and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode, if unset, a folder that goes at exit."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="orthoframe-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, where nothing lies yet."""
    return f"{shared_folder(spark)}/orthoframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written and read back: computed once, with true sizes, and safe from lost executors."""
    spark = rows.sparkSession
    path = new_folder(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
