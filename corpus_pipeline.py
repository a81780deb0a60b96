"""Training-data pipeline over ``documents``: quality rules, exact dedup, near-dedup, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns
of ``documents``; the last returns the pieces of packed sequences.

All stages take nulls in any column (a null text is an empty one), empty and very long texts, repeated
rows (each is a row), empty tables (no rows) and further columns of any names, which they keep as they
are; each stage's docstring says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orthoframe.llm import exact_dedup, mixing, packing, quality_rules, simhash_similar
from orthoframe.llm.common import drop_path, new_path, read, temporary


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language.

    Null and empty texts fail the base rules; a null language is one; repeated rows pass or fail alike;
    a ratio equal to its cutoff passes; without labels only the base rules act.
    """
    return quality_rules.filter_documents(docs, read(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the one with the smallest id, and null ids after all others.

    Null texts equal empty ones; of several rows with that id and text one stays.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are similar (five-word shingles, 0.8) that with the smallest id.

    SimHash balls find most, prefix filtering the others. Texts without words are equal to each other; of
    several rows with the smallest id one stays; rows without an id can't be named, and all stay.
    """
    return simhash_similar.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is one; a document without words, or in a source without, is taken as its source's
    rate says, or not at all; rows alike in id, source and size share the copies evenly.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids; rows are packed as they come, each with its end id."""
    import public_tokenizers

    return packing.digest_rows(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, the cube method and the tokenizer are beyond SQL; tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``. A stage's tables, and its input, go when its result is written."""
    docs, earlier = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = new_path(spark, "pipeline")
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if earlier:
            drop_path(spark, earlier)
        earlier = path
    return docs
