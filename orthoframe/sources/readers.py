"""Readers: calibration text, image sizes, PPM images as tiles, LAS heights, PLY clouds, specs."""

from __future__ import annotations

import struct
import urllib.parse
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the calibration file and the names that the library gives them.
CALIBRATION = {
    "#label": "img_name", "X0": "x", "Y0": "y", "Z0": "z", "c": "c", "x0": "x0", "y0": "y0", "omega[deg]": "omega", "phi[deg]": "phi", "kappa[deg]": "kappa",
    "a3": "a3", "a4": "a4", "a5": "a5", "a6": "a6", "rho0": "rho0",
}


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """A camera for each line of a file of columns separated by white space, after a header that
    starts with ``#label``; ``ord`` keeps the lines' order. Columns may stand in any order."""
    lines = spark.read.text(path, wholetext=False).filter(F.trim("value") != "")
    head = lines.filter(F.trim("value").startswith("#label")).first()
    if head is None:
        raise ValueError(f"no header in {path}")
    names = head["value"].split()
    missing = [c for c in CALIBRATION if c not in names]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    parts = lines.filter(~F.trim("value").startswith("#label")).select(F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("ord"))
    columns = [(F.col("p")[names.index(c)] if n == "img_name" else F.col("p")[names.index(c)].cast("double")).alias(n) for c, n in CALIBRATION.items()]
    return parts.select("ord", *columns)


def _size(data: bytes) -> tuple[int, int]:
    """(rows, cols) from the header of a PPM, PGM, PNG, JPEG or TIFF file."""
    if data[:2] in (b"P5", b"P6"):
        cols, rows = _pnm_header(data)[:2]
        return rows, cols
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        cols, rows = struct.unpack(">II", data[16:24])
        return rows, cols
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            kind, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return struct.unpack(">HH", data[at + 5 : at + 9])
            at += 2 + length
    if data[:4] in (b"II*\0", b"MM\0*"):
        e = "<" if data[:2] == b"II" else ">"
        at = struct.unpack(e + "I", data[4:8])[0]
        tags = {}
        for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
            entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
            tag, kind = struct.unpack(e + "HH", entry[:4])
            tags[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
        return tags[257], tags[256]
    raise ValueError("an image of an unknown kind")


def _pnm_header(data: bytes) -> tuple[int, int, int, int]:
    """cols, rows, largest value, and where the pixels start."""
    at, found = 2, []
    while len(found) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        found.append(int(data[at:end]))
        at = end
    return found[0], found[1], found[2], at + 1


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(img_name, nrows, ncols) of the image files of a folder, from their headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                rows, cols = _size(row["content"])
                yield pa.RecordBatch.from_pylist([{"img_name": row["path"].rpartition("/")[2], "nrows": rows, "ncols": cols}], pa.schema([("img_name", pa.string()), ("nrows", pa.int32()), ("ncols", pa.int32())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "img_name string, nrows int, ncols int")


def _cut(name: str, pixels: np.ndarray, size: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tiles of an 8-bit image (rows, cols, bands), one at a time."""
    rows, cols, bands = pixels.shape
    for y in range(0, rows, size):
        for x in range(0, cols, size):
            part = pixels[y : y + size, x : x + size].astype(np.float32) / np.float32(255)
            out = {"img": name, "ty": y // size, "tx": x // size, "y0": y, "x0": x, "h": part.shape[0], "w": part.shape[1], "bands": bands, "data": part.ravel()}
            yield pa.RecordBatch.from_pylist([out], arrow)


def read_images(spark: SparkSession, path: str, size: int = 1024) -> DataFrame:
    """Tile rows (img, ty, tx, y0, x0, h, w, bands, data) of 8-bit images, values 0 to 1.

    PPM and PGM files are read here; JPEG, PNG, BMP, GIF and TIFF files by Spark's image source, which
    decodes them in the executors. Grey images have one band, others three.
    """
    schema = "img string, ty int, tx int, y0 int, x0 int, h int, w int, bands int, data array<float>"
    arrow = pa.schema([("img", pa.string()), *[(n, pa.int32()) for n in ("ty", "tx", "y0", "x0", "h", "w", "bands")], ("data", pa.list_(pa.float32()))])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = (batch.column(c)[i].as_py() for c in ("path", "content"))
                cols, rows, top, at = _pnm_header(content)
                if top != 255:
                    raise ValueError(f"{name}: values up to 255")
                bands = 3 if content[:2] == b"P6" else 1
                yield from _cut(name.rpartition("/")[2], np.frombuffer(content, np.uint8, rows * cols * bands, at).reshape(rows, cols, bands), size, arrow)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, cols, channels, data = (batch.column(c)[i].as_py() for c in ("origin", "height", "width", "nChannels", "data"))
                pixels = np.frombuffer(data, np.uint8).reshape(rows, cols, channels)
                pixels = pixels if channels == 1 else pixels[..., 2::-1]  # blue comes first, transparency last
                yield from _cut(urllib.parse.unquote(name.rpartition("/")[2]), pixels, size, arrow)

    own = spark.read.format("binaryFile").option("pathGlobFilter", "*.p[pgn]m").load(path).select("path", "content").mapInArrow(plain, schema)
    image = spark.read.format("image").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG,png,PNG,bmp,gif,tif,tiff,TIF,TIFF}").load(path)
    return own.unionByName(image.select("image.*").drop("mode").mapInArrow(decoded, schema))


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of the points of LAS files (formats 0 to 10, uncompressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("content")[i].as_buffer()
                head = bytes(data[:375])
                if head[:4] != b"LASF" or head[104] & 0x80:
                    raise ValueError("an uncompressed LAS file")
                start, width, n = struct.unpack("<I", head[96:100])[0], struct.unpack("<H", head[105:107])[0], struct.unpack("<I", head[107:111])[0]
                if head[25] >= 4 and not n:
                    n = struct.unpack("<Q", head[247:255])[0]
                scale, offset = np.array(struct.unpack("<3d", head[131:155])), np.array(struct.unpack("<3d", head[155:179]))
                kind = np.dtype({"names": ["x", "y", "z"], "formats": ["<i4"] * 3, "offsets": [0, 4, 8], "itemsize": width})
                points = np.frombuffer(data, kind, n, start)
                for at in range(0, n, 1 << 16):
                    part = points[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part[a] * scale[k] + offset[k]) for k, a in enumerate("xyz")], ["x", "y", "z"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "x double, y double, z double")


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of the vertices of ASCII clouds, as 32-bit numbers widened to doubles.

    In a file with a header, vertices are as many lines after it as the header says; other elements,
    such as faces, are left out. Files without one (parts of vertices) hold vertices only. The order
    of lines follows from the byte at which a split of a file starts.
    """
    from pyspark.sql.window import Window

    meta = F.col("_metadata")
    lines = spark.read.text(path).select(F.trim("value").alias("value"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = lines.join(blocks, ["file", "block"]).withColumn("at", F.col("before") + F.col("id") - F.col("first"))
    count = F.regexp_extract("value", r"\Aelement\s+vertex\s+([0-9]+)", 1)
    heads = placed.groupBy("file").agg(
        F.max(count.try_cast("bigint")).alias("vertices"),
        F.min(F.when(F.col("value") == "end_header", F.col("at"))).alias("end"),
    )
    whole = F.col("end").isNotNull() & F.col("vertices").isNotNull()
    inside = (F.col("at") > F.col("end")) & (F.col("at") <= F.col("end") + F.col("vertices"))
    p = F.split("value", r"\s+")
    number = p[0].rlike(r"\A[-+0-9.]|\A(?i:nan|inf)") & (F.size(p) >= 3)
    vertices = placed.join(heads, "file").filter(F.when(whole, inside).otherwise(number)).select(p.alias("p"))
    return vertices.select(*[F.col("p")[i].cast("float").cast("double").alias(n) for i, n in enumerate("xyz")])


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    """(base, sides) of a multiview spec in JSON lines."""
    return spark.read.schema("base string, sides array<string>").json(path)
