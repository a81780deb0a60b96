"""Near-duplicates by similarity of word shingles: SimHash balls first, prefix filtering for the rest.

Two documents are linked when the Jaccard similarity of their sets of word shingles (five words)
is at least 0.8. Every such pair is found, in buckets of any size:

1. **Balls.** Each set has a 64-bit SimHash fingerprint, and fingerprints within two bits meet by the
   balls of half that radius (:func:`.simhash.links`); pairs that meet are candidates. So are sets of equal
   fingerprint, each with the first of them. This finds most copies with few changes.
2. **Prefixes.** Fingerprints of sets at a similarity of 0.8 mostly lie further apart, so the rest needs
   another way. All documents put their shingles into one order. The larger of two sets at a
   similarity ``t`` has at most ``n - ceil(t * n)`` shingles of its own, and so has the smaller one; so the
   first shared shingle is among the first ``n - ceil(t * n) + 1`` of both. A document emits those (its
   prefix), and a bucket holds the documents that emit the same shingle (Chaudhuri et al., 2006;
   Xiao et al., 2008). In a bucket, each document is a candidate with the one that has the shingle earliest.
3. Verified links give first components, so a family of copies costs its members and not their pairs.
   Then all pairs of a bucket across components are candidates, unless they can't be linked: what
   comes after the shared shingle is too short in one of them (this holds for the bucket of the
   first shared shingle), or their parity sketches differ in more bits than the sets may differ in
   shingles. (A shingle flips one bit of a sketch, so no more bits differ than shingles do.)
4. Candidates are verified by the exact similarity.

Which order it is does not change the result, only the cost. Shingles that are common in a sample
of the documents come last, by their number there; the others go by their hash. So a passage that
many documents share makes no large buckets. Where all that a document has is common (in a large family
of copies), its buckets may be large; these are known beforehand, as there are ``COMMON`` at most, and get
their first document by a grouped minimum that is broadcast, so that no task gathers one of them.

Step 3 compares all members of a bucket that no link joined, which is quadratic in their number.

Tables of sketches and sets grow with the documents; joins with them shuffle at every size.

Equal word sequences are one node from the start. Links and prefixes stay distributed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import drop_table, fresh, materialize, release
from .components import components
from .simhash import links, print_of

WIDTH = 5
SIMILARITY = 0.8
#: Bits in which fingerprints may differ that meet in balls.
DISTANCE = 2
#: 64-bit words of the shortest parity sketch, which holds half as many shingles as bits.
WORDS = 16
#: One document in so many is sampled for common shingles.
SAMPLED = 16
#: Shingles that so many sampled documents have are common, of which at most ``COMMON`` go last.
OFTEN = 3
COMMON = 1 << 15


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """Distinct hashes of the shingles; fewer words than ``width`` are one shingle, none give none."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh3_64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :][:n].tolist(), strict=True)
    return np.unique(np.fromiter((digest(line[i:j]) for i, j in spans), np.uint64, n))


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def prefix_length(n: int, similarity: float) -> int:
    """How many of its ``n`` shingles a set emits; one at least is shared at the similarity."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles by the low bits of their hashes, as 64-bit words.

    There are ``WORDS`` words, doubled until the bits are twice the shingles; a half added to the
    other by exclusive or is the sketch of half the length.
    """
    bits = max(64 * WORDS, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64 * WORDS
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded(words: np.ndarray) -> np.ndarray:
    """The sketch of ``WORDS`` words."""
    return np.bitwise_xor.reduce(words.reshape(-1, WORDS), axis=0)


def _prefixes(docs: DataFrame, width: int, similarity: float, common: np.ndarray, times: np.ndarray) -> DataFrame:
    """(id, text) -> (id, twin, n, print, rare, prefix, sketch, folded).

    ``common`` shingles (ascending) go last in the order, by ``times``; the prefix has ``rare`` others first.
    """
    longs = T.ArrayType(T.LongType())
    fields = [T.StructField("twin", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("print", T.LongType()), T.StructField("rare", T.IntegerType()), T.StructField("prefix", longs), T.StructField("sketch", longs), T.StructField("folded", longs)]
    schema = T.StructType([docs.schema["id"], *fields])

    def prefix(hashes: np.ndarray) -> tuple[np.ndarray, int]:
        length = rare = prefix_length(len(hashes), similarity)
        if len(common) and len(hashes):
            at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
            often = np.where(common[at] == hashes, times[at], 0)
            rare = min(length, int((often == 0).sum()))
            hashes = hashes[np.argsort(often, kind="stable")]
        return hashes[:length].view(np.int64), rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            words = [_split(t.as_py()) for t in batch.column("text")]
            sets = [_hashes(w, width) for w in words]
            sketches = [sketch(h) for h in sets]
            prefixes = [prefix(h) for h in sets]
            columns = [
                batch.column("id"),
                pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()),
                pa.array([len(h) for h in sets], pa.int32()),
                pa.array([print_of(h) for h in sets], pa.int64()),
                pa.array([r for _, r in prefixes], pa.int32()),
                pa.array([p for p, _ in prefixes], pa.list_(pa.int64())),
                pa.array(sketches, pa.list_(pa.int64())),
                pa.array([folded(x) for x in sketches], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) of the most common shingles of a sample of documents, and their numbers there."""
    sample = docs.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0)
    each = _shingle_sets(sample, width).select(F.explode("shingles").alias("shingle"))
    times = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= OFTEN)
    found = times.orderBy(F.desc("times"), "shingle").limit(COMMON).toPandas()
    hashes = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["times"].to_numpy(np.int64)[order]


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, text) -> (id, shingles)."""
    schema = T.StructType([docs.schema["id"], T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_hashes(_split(t.as_py()), width).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return docs.mapInArrow(run, schema)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, n, at, hub) of all buckets with two nodes or more; ``hub`` has the key earliest."""
    emitted = nodes.select("node", "n", "rare", F.posexplode("prefix").alias("at", "key"))
    hub, members = F.min(F.struct("at", "node")), F.count(F.lit(1))
    bucket = Window.partitionBy("key")
    rare = emitted.filter("at < rare").select("key", "node", "n", "at", hub.over(bucket)["node"].alias("hub"), members.over(bucket).alias("members"))
    often = emitted.filter("at >= rare").select("key", "node", "n", "at")
    hubs = materialize(often.groupBy("key").agg(hub["node"].alias("hub"), members.alias("members")), "similar-hubs")
    met = rare.unionByName(often.join(F.broadcast(hubs), "key"))  # at most COMMON rows
    return met.filter("members > 1").drop("members")


def _balls(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or meet in a ball; a pair for each link."""
    first = materialize(nodes.groupBy("print").agg(F.min("node").alias("node")), "similar-prints")
    same = nodes.select("print", F.col("node").alias("a")).join(first.select("print", F.col("node").alias("b")), "print").filter("a <> b").select("a", "b")
    met = links(first.select(F.col("print").alias("node"), "print"), DISTANCE)
    for side in "ab":
        met = met.join(first.select(F.col("print").alias(side), F.col("node").alias(f"node_{side}")), side)
    return same.unionByName(met.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")))


def _bits_allowed(similarity: float) -> Column:
    """In how many shingles two sets of ``n_a`` and ``n_b`` may differ."""
    return (F.col("n_a") + F.col("n_b")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6


def _near(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) whose sizes and sketches allow a link."""
    out = pairs.distinct()
    for side in "ab":
        out = out.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")).hint("merge"), side)
    # sizes that allow a link are within a factor of 1 / similarity, so for 0.5 and more sketches are at most doubled
    out = out.filter(F.least("n_a", "n_b") + 1e-6 >= F.greatest("n_a", "n_b") * F.lit(similarity))
    half = F.least(F.size("sketch_a"), F.size("sketch_b"))

    def fold(words: Column) -> Column:
        twice = F.zip_with(F.slice(words, F.lit(1), half), F.slice(words, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(words) > half, twice).otherwise(words)

    differ = F.zip_with(fold(F.col("sketch_a")), fold(F.col("sketch_b")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    bits = F.aggregate(differ, F.lit(0), lambda total, x: total + x)
    unlike = (F.greatest(F.size("sketch_a"), F.size("sketch_b")) <= 2 * half) & (bits > _bits_allowed(similarity))
    return out.filter(~unlike).select("a", "b")


def _across(named: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of a bucket with different labels that may be linked."""
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    again = materialize(named.join(mixed, "key").join(nodes.select("node", "folded").hint("merge"), "node"), "similar-mixed")
    sides = [again.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "at", "label", "folded")]) for side in "ab"]
    # shingles that both may share, from the bucket's on, against those that they need
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = rest + 1e-6 >= (F.col("n_a") + F.col("n_b")) * F.lit(similarity / (1 + similarity))
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.get("folded_a", F.lit(k)).bitwiseXOR(F.get("folded_b", F.lit(k)))) for k in range(WORDS)])
    met = sides[0].join(sides[1], "key").filter((F.col("label_a") < F.col("label_b")) & enough & (bits <= _bits_allowed(similarity)))
    pairs = met.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"))
    out = materialize(_near(pairs, nodes, similarity), "similar-across")
    drop_table(again)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs whose shingle sets have at least the similarity; sets are made for their documents only."""
    pairs = materialize(pairs, "similar-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(_shingle_sets(texts.join(needed.hint("merge"), "id", "left_semi"), width), "similar-sets")
    out = pairs
    for side in "ab":
        out = out.join(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"set_{side}")).hint("merge"), side)
    shared = F.size(F.array_intersect("set_a", "set_b"))
    joint = F.size("set_a") + F.size("set_b") - shared
    out = materialize(out.filter(shared >= F.lit(similarity) * joint).select("a", "b"), "similar-links")
    drop_table(pairs)
    drop_table(sets)
    return out


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component) for each row with an id: the smallest id that links reach from it.

    Null texts count as empty; texts without words are equal to each other and to no other. Rows
    that repeat an id with different texts link those texts. Rows without an id are left out. An
    empty table gives no rows. Very long texts are cut into shingles whole, in one task's memory. Sets of
    exactly the similarity are linked. Other columns are not read, so their names may be any.
    """
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("id is not null")
    rows = materialize(_prefixes(texts, width, similarity, *_common(texts, width)), "similar-prefixes")
    # equal word sequences: the smallest id stands for all
    first = F.first(F.struct("n", "print", "rare", "prefix", "sketch", "folded")).alias("of")
    twins = materialize(rows.groupBy("twin").agg(F.min("id").alias("node"), first), "similar-twins")
    nodes = twins.select("node", "of.*")
    same = materialize(rows.select("id", "twin").join(twins.select("twin", "node"), "twin").select("id", "node"), "similar-same")
    drop_table(rows)
    met = materialize(_buckets(nodes), "similar-buckets")
    star = met.filter("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"))
    balls = materialize(_balls(nodes), "similar-balls")
    release(texts)
    first = _verified(_near(star.unionByName(balls), nodes, similarity), texts, width, similarity)
    drop_table(balls)
    roots = components(first)
    named = met.join(roots, "node", "left").select("key", "node", "n", "at", F.coalesce("root", "node").alias("label"))
    named = materialize(named, "similar-labels")
    drop_table(met)
    release(texts)
    across = _across(named, nodes, similarity)
    second = _verified(across, texts, width, similarity)
    repeats = same.filter("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    found = components(first.unionByName(second).unionByName(repeats))
    out = materialize(same.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component")), "similar-components")
    for table in (same, twins, first, roots, named, across, second, found):
        drop_table(table)
    return out


def drop_similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row for each component: that with the smallest id.

    Of several rows with that id one stays (the first by a hash of all columns). Rows without an
    id can't be told apart or named, and all stay.
    """
    names = docs.columns
    keep_id, n, order = fresh(names, "kept_id", "kept_n", "kept_order")
    found = similar_documents(docs, id_column, text_column, width, similarity)
    stays = found.filter("id = component").groupBy("id").agg(F.count(F.lit(1)).alias(n))
    kept = docs.join(stays.withColumnRenamed("id", keep_id), F.col(id_column) == F.col(keep_id))
    by_content = Window.partitionBy(id_column).orderBy(F.xxhash64(*[F.col(c) for c in names]))
    first = kept.filter(F.col(n) > 1).withColumn(order, F.row_number().over(by_content)).filter(F.col(order) == 1)
    single = kept.filter(F.col(n) == 1).select(names).unionByName(first.select(names))
    return single.unionByName(docs.filter(F.col(id_column).isNull()))
