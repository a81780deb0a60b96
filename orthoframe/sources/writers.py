"""Writers: ASCII clouds and cached rasters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.triangulation import ply_line

FPC = ("x", "y", "z", "diffuse_red", "diffuse_green", "diffuse_blue", "views")
BASIC = ("x", "y", "z", "red", "green", "blue")


def header(n: int, names: tuple[str, ...]) -> str:
    """A cloud's header: floats for places, bytes for the rest."""
    kinds = [f"property {'float' if k < 3 else 'uchar'} {n_}" for k, n_ in enumerate(names)]
    return "\n".join(["ply", "format ascii 1.0", f"element vertex {n}", *kinds, "end_header"])


def _count(rows: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Writes rows, and counts them on the way."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def _write_header(spark: SparkSession, path: str, n: int, names: tuple[str, ...]) -> None:
    spark.createDataFrame([(header(n, names),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def write_ply(points: DataFrame, path: str, views: int | None = None) -> int:
    """Writes X, Y, Z, r, g, b (and a constant ``views``) as one cloud of text parts; returns its size.

    Header and parts of vertices, in order of their names, make up the file: :func:`join_ply` puts them
    together. Vertices are written by all tasks, and counted on the way.
    """
    extra = [] if views is None else [F.lit(views)]
    lines = points.select(ply_line(*[F.col(c) for c in "XYZrgb"], *extra).alias("value"))
    n = _count(lines, lambda rows: rows.write.mode("overwrite").text(f"{path}/vertices"))
    _write_header(points.sparkSession, path, n, BASIC if views is None else FPC)
    return n


def append_ply(points: DataFrame, path: str, old: int) -> int:
    """Adds vertices to a cloud of ``old`` vertices, and rewrites its header with the new number."""
    lines = points.select(ply_line(*[F.col(c) for c in "XYZrgb"]).alias("value"))
    n = old + _count(lines, lambda rows: rows.write.mode("append").text(f"{path}/vertices"))
    _write_header(points.sparkSession, path, n, BASIC)
    return n


def join_ply(spark: SparkSession, path: str, file: str) -> None:
    """Makes one PLY file of a cloud's header and vertices; bytes are streamed, not held.

    The file gets its name when it is whole.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    draft, whole = at(f"{file}.part"), at(file)
    fs = whole.getFileSystem(conf)
    out = fs.create(draft, True)
    for folder in ("header", "vertices"):
        source = at(f"{path}/{folder}")
        found = sorted((f for f in source.getFileSystem(conf).listStatus(source) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
        for f in found:
            into = f.getPath().getFileSystem(conf).open(f.getPath())
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, 1 << 16, False)
            into.close()
    out.close()
    fs.delete(whole, False)
    fs.rename(draft, whole)


def write_raster(tiles: DataFrame, path: str) -> None:
    """Caches rows of rasters, dealt by image; values are 32-bit floats (as a cached raster holds them).

    Images that the rows have are replaced; all others in the cache stay.
    """
    key = [c for c in ("base", "side", "img", "out") if c in tiles.columns]
    tiles.repartition(*key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(path)


def write_clouds(points: DataFrame, path: str) -> None:
    """Caches the points of clouds, dealt by base; clouds of other bases in the cache stay."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("base").parquet(path)


def cached(spark: SparkSession, path: str, keys: Sequence[str], schema: str) -> DataFrame:
    """What a cache holds, with its keys as strings; without a cache, no rows of that schema."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = ", ".join([schema, *[f"{k} string" for k in keys]])
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)
