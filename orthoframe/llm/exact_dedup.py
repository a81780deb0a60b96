"""Exact dedup with a log-structured merge index of digests, in DataFrame operations.

* **Memtable.** Each task of a flush gathers the digests of its share of a batch.
* **Flush.** A task writes what it gathered as one sorted run, a Parquet file of (digest, id). Every
  flush also writes a blocked Bloom filter of its digests (Putze et al., 2007): at most ``WORDS`` words
  of 64 bits, of which a digest sets four bits in one. No digest is shuffled for the flush.
* **Compaction.** All runs merge into one level of files sorted by digest that keep, for each
  digest, the smallest identifier, how many rows carry that identifier and how many rows there
  are. Partial sums come before the shuffle, so a group of any size moves as a few rows.
* **Lookup.** A row goes to the runs, or to the compacted level, only where the filter may hold its
  digest. A filter has a bounded number of rows, so it is broadcast and rows meet it where they are.
* **Hits**, rows whose digest the level has more than once, are verified byte by byte: smallest and
  largest text of a group are taken before the shuffle and must be equal. Texts that differ in spite
  of equal digests are grouped anew by the text itself. Texts of rows without a hit never move.

A filter that is full lets more rows through (from about a million repeated digests on, more than one
in fifty of the others); the result does not change.

Repeated rows with the smallest identifier and the same text are one document that stays.

Texts are equal when identical after each run of white space became one space.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, drop_table, fresh, materialize, read

#: Tasks that share the byte verification of one hot group.
SALTS = 32
#: 64-bit words of a filter, a power of two.
WORDS = 1 << 18


#: Runs of white space other than a single space, which would be replaced by itself.
_RUNS = rf"\x20{SPACE}+|[\x09-\x0D]{SPACE}*"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def smallest(column: str) -> Column:
    """Orders identifiers with null after every other."""
    return F.struct(F.col(column).isNull().alias("none"), F.col(column).alias("id"))


def _word(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(WORDS - 1))


def _mask(key: Column) -> Column:
    """Four bits of a word, by a hash other than the word's."""
    h = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def bloom(digests: DataFrame) -> DataFrame:
    """(word, bits) of the digests, in ``WORDS`` rows at most."""
    set_bits = digests.select(_word(F.col("digest")).alias("word"), _mask(F.col("digest")).alias("mask"))
    return materialize(set_bits.groupBy("word").agg(F.bit_or("mask").alias("bits")), "digest-filter")


def with_chance(rows: DataFrame, key: str, filter_: DataFrame, out: str) -> DataFrame:
    """``rows`` with a boolean ``out``: whether the filter may hold the digest in ``key``. No shuffle."""
    word, bits = fresh([*rows.columns, key, out], "filter_word", "filter_bits")
    table = F.broadcast(filter_.select(F.col("word").alias(word), F.col("bits").alias(bits)))  # at most WORDS rows
    met = rows.join(table, _word(F.col(key)) == F.col(word), "left")
    mask = _mask(F.col(key))
    return met.withColumn(out, F.coalesce(F.col(bits).bitwiseAND(mask) == mask, F.lit(False))).drop(word, bits)


class DigestIndex:
    """Sorted runs of (digest, id) with filters, and their compaction, in the session's shared folder.

    Null identifiers sort after all others; null texts have the digest of the empty text; an empty batch
    is a run without rows; rows that are repeated, in one batch or in several, count each. Only the two
    named columns of a batch are read.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.runs: list[tuple[DataFrame, DataFrame]] = []
        self.level: DataFrame | None = None

    def flush(self, batch: DataFrame, id_column: str, text_column: str) -> DataFrame:
        """Adds a batch as sorted runs, one a task; returns (id, digest) of its rows."""
        rows = batch.select(F.col(id_column).alias("id"), digest(F.col(text_column)).alias("digest"))
        run = materialize(rows.sortWithinPartitions("digest", "id"), "digest-run")
        self.runs.append((run, bloom(run)))
        return run

    def lookup(self, rows: DataFrame) -> DataFrame:
        """(id, digest) -> (digest, keep_id, group_size): what runs and level hold of the rows' digests.

        A digest is looked up only in those runs whose filter may hold it.
        """
        wanted = rows.select("digest").distinct()
        found = []
        for run, filter_ in self.runs:
            some = with_chance(wanted, "digest", filter_, "maybe").filter("maybe").select("digest")
            found.append(_counted(run.join(some, "digest", "left_semi")))
        if self.level is not None:
            found.append(_of_level(self.level).join(wanted, "digest", "left_semi"))
        if not found:
            return _merged(_counted(rows.limit(0))).select("digest", "keep_id", "group_size")
        return _merged(reduce(DataFrame.unionByName, found)).select("digest", "keep_id", "group_size")

    def compact(self) -> DataFrame:
        """Merges runs (and the earlier level) into (digest, keep_id, n_keep, group_size)."""
        parts = [_counted(run) for run, _ in self.runs]
        if self.level is not None:
            parts.append(_of_level(self.level))
        old, self.level = self.level, materialize(_merged(reduce(DataFrame.unionByName, parts)).sortWithinPartitions("digest"), "digest-level")
        for _, filter_ in self.runs:
            drop_table(filter_)
        if old is not None:
            drop_table(old)
        self.runs = []
        return self.level


def _counted(run: DataFrame) -> DataFrame:
    return run.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n_keep")).withColumn("group_size", F.col("n_keep"))


def _of_level(level: DataFrame) -> DataFrame:
    return level.select("digest", F.col("keep_id").alias("id"), "n_keep", "group_size")


def _merged(counted: DataFrame) -> DataFrame:
    """(digest, id, n_keep, group_size) -> (digest, keep_id, n_keep, group_size), a row for each digest."""
    by_id = counted.groupBy("digest", "id").agg(F.sum("n_keep").alias("n_keep"), F.sum("group_size").alias("group_size"))
    first = F.min(F.struct(smallest("id").alias("key"), "n_keep")).alias("first")
    merged = by_id.groupBy("digest").agg(first, F.sum("group_size").alias("group_size"))
    return merged.select("digest", F.col("first.key.id").alias("keep_id"), F.col("first.n_keep").alias("n_keep"), "group_size")


_FOUND = ("id", "digest", "keep_id", "n_keep", "group_size")


def _found(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of :func:`find_copies`, first those that the filter of all shared digests rules out, then the
    others; and that filter."""
    index = DigestIndex(docs.sparkSession)
    rows = index.flush(docs, id_column, text_column)
    level = index.compact()
    shared = level.filter("group_size > 1")
    hot = bloom(shared)
    one = F.lit(1).cast("long")
    passed = with_chance(rows, "digest", hot, "maybe")
    single = passed.filter("not maybe").select("id", "digest", F.col("id").alias("keep_id"), one.alias("n_keep"), one.alias("group_size"))
    hits = passed.filter("maybe").join(level, "digest").select(*_FOUND)
    odd = materialize(_unequal(docs, hot, text_column), "digest-odd")
    if odd.isEmpty():  # always, unless SHA-256 collides
        drop_table(odd)
        return single, hits, hot
    return single, _regrouped(docs, hits, odd, id_column, text_column), hot


def find_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, digest, keep_id, n_keep, group_size.

    ``keep_id`` is the smallest id of the rows with the same normalised text (null only if all
    of them are null), ``n_keep`` the number of rows that carry text and that id.
    Null texts count as empty; repeated rows count each; an empty table gives no rows. A very long text
    is hashed whole. Columns other than these two are not read.
    """
    single, hits, _ = _found(docs, id_column, text_column)
    return single.unionByName(hits)


def _unequal(docs: DataFrame, hot: DataFrame, text_column: str) -> DataFrame:
    """Digests whose rows don't all have the same bytes.

    A group's texts are all equal when the smallest and the largest are. They are taken in each task
    before the shuffle, and groups are dealt by digest and salt, so that a hot group moves as a few texts.
    """
    texts = docs.select(
        digest(F.col(text_column)).alias("digest"),
        F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"),
        normalised(F.col(text_column)).alias("norm"),
    )
    ends = with_chance(texts, "digest", hot, "maybe").filter("maybe").groupBy("digest", "salt").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    # the ends of equal texts are equal, so what goes on is as small as their hashes
    same = ends.select("digest", (F.col("low") == F.col("high")).alias("same"), F.sha2(F.col("low").cast("binary"), 512).alias("of"))
    return (
        same.groupBy("digest")
        .agg(F.bool_and("same").alias("same"), F.min("of").alias("low"), F.max("of").alias("high"))
        .filter(~F.col("same") | (F.col("low") != F.col("high")))
        .select("digest")
    )


def _regrouped(docs: DataFrame, found: DataFrame, odd: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The same rows, with groups of colliding digests formed by the text itself."""
    sound = found.join(odd, "digest", "left_anti").select("id", "digest", "keep_id", "n_keep", "group_size")
    again = docs.select(
        F.col(id_column).alias("id"), digest(F.col(text_column)).alias("digest"), normalised(F.col(text_column)).alias("norm")
    ).join(odd, "digest", "left_semi")
    counted = again.groupBy("norm", "id").agg(F.count(F.lit(1)).alias("n"))
    level = counted.groupBy("norm").agg(
        F.min(F.struct(smallest("id").alias("key"), "n")).alias("first"), F.sum("n").alias("group_size")
    )
    split = again.join(level, "norm").select(
        "id", "digest", F.col("first.key.id").alias("keep_id"), F.col("first.n").alias("n_keep"), "group_size"
    )
    return sound.unionByName(split)


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row for each distinct normalised text: the one with the smallest id.

    If several rows carry that id and text, one of them stays. Other columns are untouched.
    Null texts count as empty, and an id of null comes after all others. An empty table gives no rows.
    Other columns may have any names, those used inside included. Rows whose text no other row has stay
    where they are; only texts of hits are shuffled.
    """
    names = docs.columns
    key, maybe, keep_key, keep, n, order = fresh(names, "digest_of_row", "digest_maybe", "digest_of_kept", "kept_id", "kept_n", "kept_order")
    _, found, hot = _found(docs, id_column, text_column)
    stay = found.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "id").agg(F.max("n_keep").alias(n))
    stay = materialize(stay.select(F.col("digest").alias(keep_key), F.col("id").alias(keep), n), "digest-stay")
    rows = with_chance(docs.withColumn(key, digest(F.col(text_column))), key, hot, maybe)
    single = rows.filter(~F.col(maybe)).select(names)
    same = (F.col(key) == F.col(keep_key)) & F.col(id_column).eqNullSafe(F.col(keep))  # both: no key is hot
    kept = rows.filter(maybe).join(stay.hint("merge"), same)  # grows with the documents
    if stay.filter(F.col(n) > 1).isEmpty():
        return single.unionByName(kept.select(names))
    by_content = Window.partitionBy(key, id_column).orderBy(F.xxhash64(*[F.col(c) for c in names]))
    first = kept.filter(F.col(n) > 1).withColumn(order, F.row_number().over(by_content)).filter(F.col(order) == 1)
    return single.unionByName(kept.filter(F.col(n) == 1).select(names)).unionByName(first.select(names))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: each document with the id that stays for its text."""
    found = find_copies(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
