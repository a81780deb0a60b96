"""The survey's catalog as snapshots of seven tables, and set-based queries over them.

The rows of a table lie in parts, Parquet folders ``<root>/<table>/parts/<name>`` that never change. A
snapshot is a file ``<root>/<table>/snapshots/<number>`` that lists parts; the highest number is the
table. It is written beside its place and renamed to it, so a snapshot is there whole or not at all, and
after a crash the last whole one stands. An append adds a part and lists it; a write lists its own part
alone. One writer at a time; two that take the same number don't both succeed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import CATALOG
from ..staging import stage


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> tuple:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self, table: str) -> int | None:
        """The number of the table's last whole snapshot."""
        path, fs = self._path(f"{table}/snapshots")
        if not fs.exists(path):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit()), default=None)

    def parts(self, table: str) -> list[str]:
        """Names of the parts that the table has now."""
        n = self.version(table)
        if n is None:
            raise LookupError(f"no table {table} in {self.root}")
        path, _ = self._path(f"{table}/snapshots/{n:010d}")
        return [r["value"] for r in self.spark.read.text(path.toString()).collect() if r["value"]]

    def exists(self) -> bool:
        """All seven tables are there."""
        return all(self.version(t) is not None for t in CATALOG)

    def create(self) -> None:
        """Makes the tables that are missing, empty."""
        for table in CATALOG:
            if self.version(table) is None:
                self._commit(table, [])

    def read(self, table: str) -> DataFrame:
        found = self.parts(table)
        if not found:
            return self.spark.createDataFrame([], CATALOG[table])
        return self.spark.read.schema(CATALOG[table]).parquet(*[f"{self.root}/{table}/parts/{p}" for p in found])

    def _commit(self, table: str, parts: list[str]) -> None:
        n = (self.version(table) or 0) + 1
        draft, fs = self._path(f"{table}/snapshots/_{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray("".join(f"{p}\n" for p in parts).encode()))
        out.close()
        place, _ = self._path(f"{table}/snapshots/{n:010d}")
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer made snapshot {n} of {table}")

    def _part(self, table: str, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        schema = self.spark.createDataFrame([], CATALOG[table]).schema
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(f"{self.root}/{table}/parts/{name}")
        return name

    def write(self, table: str, rows: DataFrame) -> None:
        """Makes a snapshot of these rows alone."""
        self._commit(table, [self._part(table, rows)])

    def append(self, table: str, rows: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
        """Adds rows with new keys in the given order, and returns them with their keys.

        Only the new rows are written, and what gave them is computed once.
        """
        old = self.parts(table)
        added = new_keys(rows, self.read(table), key, order)
        self._commit(table, [*old, self._part(table, added)])
        return added


    def delete_clouds(self, names: DataFrame) -> None:
        """Removes the clouds of base images (img_name), and that they are ready, where there are any."""
        clouds, stereo, image = (self.read(t) for t in ("point_cloud", "multi_stereo", "image"))
        gone = clouds_by_base(clouds, stereo, image).join(names, "img_name", "left_semi").select("pc_id")
        kept = delete_clouds(clouds, stereo, image, names)
        cleared = stereo.join(gone.selectExpr("pc_id", "true AS gone"), "pc_id", "left").selectExpr(
            "ms_id", "base_img_id", "overlapping_bounds", "CASE WHEN gone THEN false ELSE pc_ready END AS pc_ready", "CASE WHEN gone THEN NULL ELSE pc_id END AS pc_id"
        )
        self.write("multi_stereo", cleared)
        self.write("point_cloud", kept)


def new_keys(rows: DataFrame, table: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """``rows`` with ``key`` numbered on from the table's largest, in order.

    Rows are sorted over all tasks and written once; a row's number is its place in its part after the
    sizes of earlier parts, of which there are as many as tasks.
    """
    numbered = stage(rows.drop(key).orderBy(*order).withColumn("place_", F.monotonically_increasing_id()), "new-keys")
    part, inside = F.shiftrightunsigned("place_", 33), F.col("place_").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"))
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"))
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("last_"))  # one row
    out = numbered.withColumn("inside_", inside).withColumn("part_", part).join(before, "part_").join(F.broadcast(last))
    return out.withColumn(key, (F.col("last_") + F.col("before_") + F.col("inside_") + 1).cast("int")).drop("part_", "place_", "inside_", "before_", "last_")


def image_names(image: DataFrame) -> DataFrame:
    return image.select("img_name")


def image_params(image: DataFrame, param: DataFrame, name: str) -> DataFrame:
    """Parameters of the image of a name."""
    return param.join(image.filter(F.col("img_name") == name).select("img_param_id"), "img_param_id", "left_semi")


def setting(settings: DataFrame, name: str) -> DataFrame:
    """One value of the settings' single row; unknown names are an error."""
    if name not in settings.columns:
        raise KeyError(name)
    return settings.select(name).limit(1)


def named_pairs(pair: DataFrame, image: DataFrame) -> DataFrame:
    """Pairs with base_name and side_name; pairs of unknown images are left out."""
    base = image.select(F.col("img_id").alias("base_img_id"), F.col("img_name").alias("base_name"))
    side = image.select(F.col("img_id").alias("side_img_id"), F.col("img_name").alias("side_name"))
    return pair.join(base, "base_img_id").join(side, "side_img_id")


def rectification(pair: DataFrame, params: DataFrame) -> DataFrame:
    return pair.select("img_pair_id", "rect_param_id").join(params, "rect_param_id")


def clouds_by_base(cloud: DataFrame, stereo: DataFrame, image: DataFrame) -> DataFrame:
    """(img_name, pc_id) of bases that have a cloud."""
    named = stereo.join(image, stereo["base_img_id"] == image["img_id"]).select("img_name", "pc_id")
    return named.join(cloud.select("pc_id"), "pc_id")


def has_stereo(image: DataFrame, stereo: DataFrame) -> DataFrame:
    """(img_name, found) for every image: whether a multi-stereo row has it as base."""
    bases = stereo.select(F.col("base_img_id").alias("img_id"), F.lit(True).alias("found")).distinct()
    return image.join(bases, "img_id", "left").select("img_name", F.coalesce("found", F.lit(False)).alias("found"))


def state(in_table: DataFrame, on_disk: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., in_db, on_disk, action) for everything that is in either; one join for all."""
    a = in_table.select(*keys, F.lit(True).alias("in_db")).distinct()
    b = on_disk.select(*keys, F.lit(True).alias("on_disk")).distinct()
    out = a.join(b, list(keys), "full_outer").na.fill(False, ["in_db", "on_disk"])
    action = F.when(F.col("in_db") & F.col("on_disk"), "load").when(F.col("in_db"), "recompute").otherwise("register")
    return out.withColumn("action", action)


def plan(wanted: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What to do for each wanted key: its state's action, or ``compute``."""
    out = wanted.join(known, list(keys), "left").na.fill(False, ["in_db", "on_disk"])
    return out.withColumn("action", F.coalesce("action", F.lit("compute")))


def set_cloud(stereo: DataFrame, clouds: DataFrame) -> DataFrame:
    """multi_stereo with pc_id and pc_ready taken from (base_img_id, new_pc_id)."""
    out = stereo.join(clouds.select("base_img_id", "new_pc_id"), "base_img_id", "left")
    has = F.col("new_pc_id").isNotNull()
    out = out.withColumns({"pc_id": F.coalesce("new_pc_id", "pc_id"), "pc_ready": has | F.col("pc_ready")})
    return out.select(*stereo.columns)


def delete_clouds(cloud: DataFrame, stereo: DataFrame, image: DataFrame, names: DataFrame) -> DataFrame:
    """point_cloud without the clouds of the named bases (img_name)."""
    gone = clouds_by_base(cloud, stereo, image).join(names, "img_name", "left_semi").select("pc_id")
    return cloud.join(gone, "pc_id", "left_anti")


def chosen(bases: DataFrame, names: str | None, column: str = "base") -> DataFrame:
    """Bases in a comma-separated list (spaces around names ignored); None keeps all."""
    if names is None:
        return bases
    return bases.filter(F.col(column).isin([n.strip() for n in names.split(",")]))


def expand(spec: DataFrame) -> DataFrame:
    """(base, sides) -> (base, side_idx, side); a base without sides gives no rows."""
    return spec.select("base", F.posexplode("sides").alias("side_idx", "side"))


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def cache_names(base: Column, side: Column) -> dict[str, Column]:
    """Names by which a pair's rasters are kept."""
    both = F.concat(stem(base), F.lit("_"), stem(side))
    suffixes = {"disparity": ".tif", "warped": "_warped_RL.tif", "deviations": "_deviations.tif", "mask": "_mask.tif"}
    return {k: F.concat(both, F.lit(s)) for k, s in suffixes.items()} | {"rectified": F.concat(stem(base), F.lit("_rectified.tif"))}


def has_database(spark: SparkSession, name: str) -> bool:
    """Whether a database of that name exists, upper or lower case alike."""
    return name.lower() in {d.name.lower() for d in spark.catalog.listDatabases()}


def create_database(spark: SparkSession, name: str) -> None:
    """Makes a database if none of that name exists, upper or lower case alike."""
    if not has_database(spark, name):
        quoted = name.replace("`", "``")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{quoted}`")
