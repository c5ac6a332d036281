"""A corpus from raw documents to packed sequences, in stages that each read what the one before kept.

Every stage takes an empty table, texts of any length and columns of any names beside those of documents,
which pass through it unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickforge.llm import common, mixing, neardup, packing, pii, quality, queries


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null and empty texts too, as they have no words; rows alike are judged alike."""
    return quality.keep_good(docs, queries.read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: links are of five-word shingles' similarity 0.8 at least.

    The least doc_id stays, nulls last, then the least text hash; null and empty texts are copies of each other.
    """
    return neardup.drop_near_copies(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, give way to their kinds; every document stays, null and empty texts as they were."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, rows alike as often together as mix() says; a null source is a source."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences; null text is one end token."""
    return queries.pack_digest(packing.pack_documents(docs, queries.vocabulary("byte_bpe_50k.json")))


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("pii", sanitise), ("mix", mix), ("pack", pack)]

#: SQL has no MinHash, co-occurrence search, tokenizer or Newton iteration of these kinds; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written; what a stage wrote goes once the next one has read it."""
    docs, begin = queries.read(spark, sf_dir, "documents"), len(common.WRITTEN)
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
        common.discard(spark, begin)
    return docs
