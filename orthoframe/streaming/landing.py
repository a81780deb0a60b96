"""A landing folder of multiview specs as a stream: each batch of new files is planned and handed on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import expand

SPEC = "base string, sides array<string>"


def watch_specs(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 100) -> StreamingQuery:
    """Runs ``handle(rows, batch)`` on (base, side_idx, side) of new spec files, each once, until none is left."""
    specs = spark.readStream.schema(SPEC).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return expand(specs).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
