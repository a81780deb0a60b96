"""The survey's catalog and reconstruction behind a few calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import catalog as ops
from .operators.catalog import Catalog
from .operators.reconstruction import batch_plan, build_catalog, reconstruct
from .sources import readers, writers


def stem_of(name: str) -> str:
    """A file name without its last extension."""
    return name.rpartition(".")[0] or name


class SurveyClient:
    def __init__(self, spark: SparkSession, settings: Settings) -> None:
        self.spark, self.settings = spark, settings
        self.catalog = Catalog(spark, settings.cache("catalog"))

    def initialize(self, calibration: str, images: str, las: str) -> Catalog:
        """Builds the catalog from a calibration file, image files and a ground cloud."""
        cameras = readers.read_calibration(self.spark, calibration).join(readers.image_sizes(self.spark, images), "img_name")
        self.catalog = build_catalog(self.spark, self.catalog.root, cameras, readers.read_las(self.spark, las), self.settings.epsg, self.settings.downsample_factor)
        return self.catalog

    def list_images(self) -> DataFrame:
        return ops.image_names(self.catalog.read("image"))

    def image_params(self, name: str) -> DataFrame:
        return ops.image_params(self.catalog.read("image"), self.catalog.read("image_param"), name)

    def global_param(self, name: str):
        """The value of a setting; unknown names are an error."""
        row = ops.setting(self.catalog.read("globals"), name).first()
        return None if row is None else row[0]

    def delete_point_cloud(self, name: str) -> None:
        """Removes the cloud of a base image, and that it is ready, if there is one."""
        self.catalog.delete_clouds(self.spark.createDataFrame([(name,)], "img_name string"))

    def plan(self, spec: str, in_db: DataFrame, on_disk: DataFrame) -> DataFrame:
        """What a batch has to do for each base of a spec."""
        return batch_plan(readers.read_spec(self.spark, spec), in_db, on_disk, self.settings.base_filter)

    def reconstruct(self, images: str, spec: str | DataFrame, size: int = 1024, **options) -> DataFrame:
        """Points of all bases of a spec (a path, or rows of base and sides), from image files."""
        rows = readers.read_spec(self.spark, spec) if isinstance(spec, str) else spec
        if self.settings.model_path is not None:
            options = {"model_path": self.settings.model_path} | options
        return reconstruct(self.catalog, readers.read_images(self.spark, images, size), rows, self.settings, **options)

    def run_multiview(self, images: str, base: str, sides: list[str], **options) -> DataFrame:
        """Points of one base image with its sides."""
        return self.reconstruct(images, self.spark.createDataFrame([(base, sides)], "base string, sides array<string>"), **options)

    def export_cloud(self, points: DataFrame, base: str, file: str) -> int:
        """Writes a base's points as one PLY file with the number of views; returns their number."""
        own = points.filter(F.col("base") == base)
        first = own.select("views").first()
        folder = f"{self.settings.cache('ply')}/{stem_of(base)}"
        n = writers.write_ply(own, folder, first["views"] if first else 1)
        writers.join_ply(self.spark, folder, file)
        return n
