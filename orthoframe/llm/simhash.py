"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most ``2 r`` bits apart have a value at most ``r`` bits from both. Each
distinct fingerprint therefore emits all values within ``r`` bits (its ball); fingerprints that
emit the same value meet there. The fingerprints in one such bucket lie in one ball of radius
``r``, so a bucket holds at most as many as a ball (65 for ``r = 1``), whatever the data: no
bucket is ever hot. In a bucket, neighbours in sorted order are compared and linked, which
connects the same fingerprints as all pairs would, since all of them lie within ``2 r`` bits.

Documents with equal fingerprints are one node from the start, so copies cost nothing after a
first grouped minimum. Components of the links come from :mod:`.components`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_table, fresh, materialize, read
from .components import components

#: Shingles whose hashes are counted at once; bounds memory on very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 for a text without words.

    Letters A-Z count as lower case; words are runs without ASCII white space; a text of fewer
    than ``width`` words is one shingle. A bit is 1 if more than half of the hashes have it.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :][:n].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = [digest(line[i:j], seed) for i, j in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)]
        counts += _bit_counts(np.array(hashes, "<u8"))
    ones = np.packbits(2 * counts > n, bitorder="little")
    return int(ones.view("<u8")[0])


def print_of(hashes: np.ndarray) -> int:
    """Fingerprint of hashes of a set of shingles (its bits as a signed integer); 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += _bit_counts(hashes[at : at + CHUNK])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # sums of 255 bits fit a byte, which keeps them fast
        out += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return out


def with_fingerprints(docs: DataFrame, text_column: str, out: str, width: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` without the text, with a long column ``out`` that holds the fingerprint's bits."""
    keep = [c for c in docs.columns if c != text_column]
    schema = docs.select(keep).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_column)
            prints = np.array([fingerprint(t.as_py(), width, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(prints, pa.int64())], [*keep, out])

    return docs.mapInArrow(run, schema)


def ball(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` bits, as signed integers."""
    out = []
    for k in range(radius + 1):
        for bits in combinations(range(64), k):
            mask = sum(1 << b for b in bits)
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(node, print) with distinct prints -> links (a, b) that connect all pairs in reach.

    ``distance`` is even, as prints in one ball of half of it are then all in reach of each other,
    and at most 4: a ball of radius 2 already has 2,081 values.
    """
    if distance not in (0, 2, 4):
        raise ValueError("a distance of 0, 2 or 4 bits")
    if distance == 0:
        return prints.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    masks = F.explode(F.array(*[F.lit(m).cast("long") for m in ball(distance // 2)]))
    emitted = prints.select("node", "print", masks.alias("mask")).select("node", "print", F.col("print").bitwiseXOR(F.col("mask")).alias("value"))
    bucket = Window.partitionBy("value").orderBy("print")
    met = emitted.select("node", "print", F.lag("node").over(bucket).alias("other"), F.lag("print").over(bucket).alias("other_print"))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("other_print"))) <= distance
    return met.filter(F.col("other").isNotNull() & near).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, distance: int = 2, seed: int = 42
) -> DataFrame:
    """(id, print, component) for each row: fingerprint and smallest id of its component.

    Null texts count as empty: fingerprint zero, linked like any other. Rows without an id get a
    component only through others: it is null if no row of the component has an id. Repeated
    rows are returned as often as they come; an empty table gives no rows. Very long texts are hashed
    whole, in chunks. Other columns are not read, so their names may be any.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = materialize(with_fingerprints(rows, "text", "print", width, seed), "prints")
    # null ids have a print, and take part; the print itself names a node
    nodes = materialize(rows.groupBy("print").agg(F.min("id").alias("first")), "print-nodes")
    found = components(links(nodes.select(F.col("print").alias("node"), "print"), distance))
    roots = materialize(nodes.join(found.select(F.col("node").alias("print"), "root"), "print", "left"), "print-roots")
    # the smallest id of a component: over its prints, of which a hot one counts once
    label = F.coalesce("root", "print")
    least = materialize(roots.groupBy(label.alias("root")).agg(F.min("first").alias("component")), "print-least")
    named = roots.select("print", label.alias("root")).join(least, "root").select("print", "component")
    named = materialize(named, "print-named")
    for table in (nodes, found, roots, least):
        drop_table(table)
    return rows.join(named, "print").select("id", "print", "component")


def drop_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, distance: int = 2, seed: int = 42
) -> DataFrame:
    """``docs`` with one row for each component: that with the smallest id.

    Rows with the same id count as one document, of which one row stays (the first by a hash of
    all columns). Rows without an id can't be told apart or named, and all stay.
    """
    names = docs.columns
    keep_id, n, order = fresh(names, "kept_id", "kept_n", "kept_order")
    found = near_duplicates(docs, id_column, text_column, width, distance, seed)
    stays = found.filter(F.col("id") == F.col("component")).groupBy("id").agg(F.count(F.lit(1)).alias(n))
    kept = docs.join(stays.withColumnRenamed("id", keep_id), F.col(id_column) == F.col(keep_id))
    by_content = Window.partitionBy(id_column).orderBy(F.xxhash64(*[F.col(c) for c in names]))
    first = kept.filter(F.col(n) > 1).withColumn(order, F.row_number().over(by_content)).filter(F.col(order) == 1)
    single = kept.filter(F.col(n) == 1).select(names).unionByName(first.select(names))
    return single.unionByName(docs.filter(F.col(id_column).isNull()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: each document's fingerprint and the smallest doc_id that links reach from it."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
