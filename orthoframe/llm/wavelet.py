"""Token ids as wavelet matrices (Claude, Navarro and Ordóñez, 2015), one per shard.

A shard holds the ids of consecutive documents in one row of a compressed Parquet file: a
bit-plane for each bit of an id, from the highest, where every plane stably moves the ids with
a 0 before those with a 1 for the planes below; the number of zeros of each plane; and counts of
ones before every 512th bit. From this :class:`WaveletMatrix` gives any id by its position,
counts an id up to a position (rank), and finds the positions of an id (select: a binary search in
the counts, then the bits of one block), without other copies.

Documents are dealt by ranges of their id and sorted, so shards in order of (part, number) hold
them in ascending order. A task keeps one shard in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import encoder
from .common import materialize, read

END_ID = 0
#: Ids after which a shard is closed; documents are not cut.
SHARD = 1 << 20
BLOCK = 512
#: Positions that one step of a select looks for; each reads a block of its plane.
SELECTED = 1 << 15


class WaveletMatrix:
    """Ids of one shard as bit-planes with counts."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: np.ndarray, ranks: np.ndarray) -> None:
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids, "<u4")
        n = len(ids)
        depth = max(1, int(ids.max()).bit_length()) if n else 1
        ids = ids.astype(np.uint16) if depth <= 16 else ids
        planes, zeros, ranks = [], [], []
        for level in range(depth - 1, -1, -1):
            packed = np.packbits((ids & ids.dtype.type(1 << level)) != 0, bitorder="little")
            planes.append(packed)
            ranks.append(_block_ranks(packed))
            low = _picked(ids, ~packed)
            zeros.append(len(low))
            ids = np.concatenate([low, _picked(ids, packed)])
        return cls(n, planes, np.array(zeros, np.int64), np.array(ranks, np.uint32))

    def to_columns(self) -> tuple[int, int, list[int], bytes, bytes]:
        return self.n, len(self.planes), self.zeros.tolist(), b"".join(p.tobytes() for p in self.planes), self.ranks.astype("<u4").tobytes()

    @classmethod
    def from_columns(cls, n: int, depth: int, zeros: list[int], planes: bytes, ranks: bytes) -> WaveletMatrix:
        width = (n + 7) // 8
        data = np.frombuffer(planes, np.uint8)
        return cls(n, [data[i * width : (i + 1) * width] for i in range(depth)], np.array(zeros, np.int64), np.frombuffer(ranks, "<u4").reshape(depth, -1))

    def rank1(self, level: int, position: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        position = np.asarray(position, np.int64)
        block = position // BLOCK
        out = self.ranks[level][block].astype(np.int64)
        plane = self.planes[level]
        first = block * (BLOCK // 8)
        offsets = np.arange(BLOCK // 8)
        at = first[..., None] + offsets
        full = np.clip(position[..., None] - 8 * at, 0, 8)
        data = plane[np.minimum(at, max(len(plane) - 1, 0))] if len(plane) else np.zeros_like(at, np.uint8)
        masked = data & ((1 << full) - 1).astype(np.uint8)
        return out + np.bitwise_count(masked).sum(axis=-1, dtype=np.int64)

    def _bit(self, level: int, position: np.ndarray) -> np.ndarray:
        return (self.planes[level][position >> 3] >> (position & 7).astype(np.uint8)) & 1

    def access(self, positions: np.ndarray) -> np.ndarray:
        """Ids at the positions."""
        at = np.asarray(positions, np.int64)
        out = np.zeros(at.shape, np.uint32)
        for level in range(len(self.planes)):
            one = self._bit(level, at).astype(bool)
            ones = self.rank1(level, at)
            out = (out << np.uint32(1)) | one
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        depth = len(self.planes)
        if token >> depth:
            return 0, 0
        for level in range(depth):
            ones = self.rank1(level, np.array([start, end]))
            if token >> (depth - 1 - level) & 1:
                start, end = (self.zeros[level] + ones).tolist()
            else:
                start, end = int(start - ones[0]), int(end - ones[1])
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often a token stands in [start, end)."""
        start, end = self._range(token, start, self.n if end is None else end)
        return end - start

    def select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Positions of the ``k``-th ones (or zeros) of a plane, from 0; there must be as many."""
        k = np.asarray(k, np.int64)
        before, plane = self.ranks[level].astype(np.int64), self.planes[level]
        if not bit:
            before = np.minimum(BLOCK * np.arange(len(before)), self.n) - before
        out = np.empty(k.shape, np.int64)
        for at in range(0, len(k), SELECTED):
            part = k[at : at + SELECTED]
            block = np.searchsorted(before, part, side="right") - 1
            left = part - before[block]
            places = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
            data = plane[np.minimum(places, len(plane) - 1)]
            data = data if bit else ~data
            counts = np.bitwise_count(data).astype(np.int64)
            upto = counts.cumsum(axis=1)
            byte = (upto <= left[:, None]).sum(axis=1)
            here = np.arange(len(part))
            left -= upto[here, byte] - counts[here, byte]
            bits = np.unpackbits(data[here, byte][:, None], axis=1, bitorder="little")
            out[at : at + SELECTED] = block * BLOCK + 8 * byte + (bits.cumsum(axis=1) <= left[:, None]).sum(axis=1)
        return out

    def occurrences(self, token: int) -> np.ndarray:
        """Ascending positions of a token: its range at the lowest level, traced upwards by select."""
        start, end = self._range(token, 0, self.n)
        at = np.arange(start, end)
        depth = len(self.planes)
        for level in range(depth - 1, -1, -1):
            one = token >> (depth - 1 - level) & 1
            at = self.select(level, one, at - (self.zeros[level] if one else 0))
        return np.sort(at)

    def tokens(self) -> np.ndarray:
        """All ids, from the lowest plane upwards."""
        depth = len(self.planes)
        kind = np.uint16 if depth <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(depth - 1, -1, -1):
            one = np.unpackbits(self.planes[level], bitorder="little", count=self.n).view(bool)
            above = np.empty_like(out)
            z = self.zeros[level]
            above[~one] = out[:z]
            above[one] = out[z:] | kind(1 << (depth - 1 - level))
            out = above
        return out.astype("<u4")


def _picked(ids: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Ids whose bit in a plane is set."""
    kind = pa.from_numpy_dtype(ids.dtype)
    mask = pa.Array.from_buffers(pa.bool_(), len(ids), [None, pa.py_buffer(plane)])
    return pa.Array.from_buffers(kind, len(ids), [None, pa.py_buffer(ids)]).filter(mask).to_numpy()


def _block_ranks(packed: np.ndarray) -> np.ndarray:
    counts = np.bitwise_count(packed)
    width = BLOCK // 8
    counts = np.append(counts, np.zeros(-len(counts) % width, np.uint8)).reshape(-1, width).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)


def write_shards(docs: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID, shard: int = SHARD, special_as_text: bool = False) -> None:
    """Encodes every whole text, appends ``end_id``, and writes shards in order of the id.

    Rows: part, number, n, depth, zeros, planes, ranks, ids (of the documents), lengths. Null
    and empty texts have ``end_id`` alone; null ids come first; rows with the same id keep no
    order among them. An empty table gives no shard. Columns other than these two are not read. A very
    long text is held whole with its ids, and its shard is as long. The string of a special token gets
    its id, as the library does it, unless ``special_as_text``.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id")
    int_, long, binary = T.IntegerType(), T.LongType(), T.BinaryType()
    columns = [("part", int_), ("number", int_), ("n", long), ("depth", int_), ("zeros", T.ArrayType(long)), ("planes", binary), ("ranks", binary), ("ids", T.ArrayType(rows.schema["id"].dataType)), ("lengths", T.ArrayType(long))]
    schema = T.StructType([T.StructField(n, t) for n, t in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, special_as_text).encode_batch, np.array([end_id], "<u4").tobytes()
        part, number, size = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        docs: list = []
        id_type = None

        def close() -> pa.RecordBatch:
            nonlocal number, size
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4"))
            lengths = [len(x) // 4 for x in held]
            values = (part, number, *matrix.to_columns(), docs, lengths)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(id_type), pa.list_(pa.int64()))
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [n for n, _ in columns])
            number, size = number + 1, 0
            held.clear()
            docs.clear()
            return out

        for batch in batches:
            id_type = batch.column("id").type
            for doc, ids in zip(batch.column("id").to_pylist(), encode(batch.column("text")), strict=True):
                data = ids + end
                held.append(data)
                docs.append(doc)
                size += len(data) // 4
                if size >= shard:
                    yield close()
        if held:
            yield close()

    ordered.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, number, before): ids of all shards before each.

    Parts are summed first, so the one global running sum has a row for each part only.
    """
    parts = shards.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("parts_before"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    own = shards.select("part", "number", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inside"))
    return own.join(parts, "part").select("part", "number", (F.col("parts_before") + F.col("inside")).cast("long").alias("before"))


_SHARD_COLUMNS = ("part", "number", "n", "depth", "zeros", "planes", "ranks")


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, of which one shard at a time becomes Python objects."""
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix.from_columns(row["n"], row["depth"], row["zeros"], row["planes"], row["ranks"])


def read_documents(shards: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids): each document's ids, decoded from its shard's planes."""
    id_type = shards.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("id", id_type), T.StructField("inside", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for row in _one_by_one(batch):
                data = _matrix(row).tokens().tobytes()
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                pieces = [data[4 * i : 4 * j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                k = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * k, pa.int32()), pa.array([row["number"]] * k, pa.int32()), pa.array(row["ids"], kind), pa.array(starts), pa.array(lengths), pa.array(pieces, pa.binary())],
                    schema.names,
                )

    return shards.select(*_SHARD_COLUMNS, F.col("ids"), "lengths").mapInArrow(run, schema)


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """(part, number, n_found): how often a token stands in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _one_by_one(batch)
            yield pa.RecordBatch.from_pylist([{"part": r["part"], "number": r["number"], "n_found": _matrix(r).count(token)} for r in rows], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n_found", pa.int64())]))

    return shards.select(*_SHARD_COLUMNS).mapInArrow(run, "part int, number int, n_found long")


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """(part, number, position): where a token stands, from the start of its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _one_by_one(batch):
                found = _matrix(r).occurrences(token)
                k = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * k, pa.int32()), pa.array([r["number"]] * k, pa.int32()), pa.array(found, pa.int64())], ["part", "number", "position"])

    return shards.select(*_SHARD_COLUMNS).mapInArrow(run, "part int, number int, position long")


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: writes the shards of all documents and reads every document back from them."""
    import public_tokenizers

    from .common import new_path

    path = new_path(spark, "wavelet")
    write_shards(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    shards = spark.read.parquet(path)
    starts = materialize(shard_starts(shards), "shard-starts")
    found = read_documents(shards).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return found.join(starts, ["part", "number"]).select(F.col("id").alias("doc_id"), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
