"""A pipeline of four operators over documents: toxicity, near-duplicates,
mixing to source weights, packing. Each stage takes what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtally.llm import mixing, packing, simhash, toxicity
from loomtally.llm.queries import vocabulary
from loomtally.session import durable
from loomtally.sources.tables import table

#: SQL can't express the fitted model, the components of near-duplicates or the encoder.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels of sf_dir, does not find toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in 0.8 of its five-word shingles: by SimHash
    fingerprints in BK-trees, their pairs checked exactly, and an exact join for what they miss."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as drawn by source weights 5, 2, 1; a row for each pass over a document."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in windows of 1024 ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("mix_sources", mix_sources), ("pack_windows", pack_windows)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written out and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
