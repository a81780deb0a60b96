"""Shared helpers: the cluster's shared folder, materialised tables, let-bindings, patterns."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is ASCII space and \t \n \v \f \r; words are runs of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


_local: list[str] = []
_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, as in local tests, a temporary folder is made and removed at exit.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="orthoframe-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orthoframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_tables(spark: SparkSession) -> None:
    """Deletes all tables of this session from the shared folder; no earlier result may be read after."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/orthoframe/{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    This cuts lineage, survives lost executors, and gives the optimizer true sizes, so that
    only tables that are in fact small get broadcast. The files stay until :func:`drop_table`,
    as a result may still need them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    if _made:
        _made[-1].append(path)
    return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all tables that were materialised inside; no result may read them after."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`materialize` returned and nothing needs now."""
    drop_path(df.sparkSession, df.table_path)


def release(df: DataFrame) -> None:
    """Lets Spark delete shuffle files that no DataFrame needs any more, which waits for a collection."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas of ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """Names like ``names`` that clash with none of ``taken`` (compared without case)."""
    have = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
