"""Seeded, disjoint splits of documents and of whole groups.

portable: the order is an md5 key, computed where the rows are and by any SQL
engine. exact: the order of a seeded Mersenne-Twister shuffle of the sorted ids or
groups, made on the driver (ids only; for corpora whose ids fit there)."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.functions.text import portable_key
from loomtally.operators.ordered import running_before
from loomtally.session import durable


def _named(before: Column, first: int, second: int) -> Column:
    return F.when(before < first, "validation").when(before < first + second, "test").otherwise("train")


def _exact_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    names = sorted(r[0] for r in rows.select(key).distinct().collect())
    random.Random(seed).shuffle(names)
    kind = rows.schema[key].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"{key} {kind}, _order long")


def document_split(docs: DataFrame, val_docs: int, test_docs: int, seed: int = 0, mode: str = "portable") -> DataFrame:
    """pos, split: the first val_docs by the seeded order, then test_docs, then training."""
    if min(val_docs, test_docs) < 1 or docs.count() <= val_docs + test_docs:
        raise ValueError("every split needs a document")
    rows = docs.select("pos")
    keyed = rows.withColumn("_order", portable_key(seed, F.col("pos"))) if mode == "portable" else rows.join(_exact_order(rows, "pos", seed), "pos")
    placed = running_before(durable(keyed.withColumn("_one", F.lit(1)), "order"), "_one", ["_order", "pos"], out="_before")
    return placed.select("pos", _named(F.col("_before"), val_docs, test_docs).alias("split"))


def group_split(docs: DataFrame, val_docs: int, test_docs: int, seed: int = 2026, mode: str = "portable") -> DataFrame:
    """family, documents, split: whole families in the seeded order go to validation until it
    has val_docs documents, then to test until it has test_docs, then to training."""
    sizes = docs.groupBy("family").agg(F.count(F.lit(1)).alias("documents"))
    keyed = sizes.withColumn("_order", portable_key(seed, F.col("family"))) if mode == "portable" else sizes.join(_exact_order(sizes, "family", seed), "family")
    placed = durable(running_before(durable(keyed, "families"), "documents", ["_order", "family"], out="_before"), "placed")
    in_validation = placed.where(F.col("_before") < val_docs).agg(F.max(F.col("_before") + F.col("documents"))).first()[0] or 0
    split = F.when(F.col("_before") < val_docs, "validation").when(F.col("_before") - in_validation < test_docs, "test").otherwise("train")
    out = placed.select("family", "documents", split.alias("split"))
    got = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.sum("documents").alias("n")).collect()}
    if got.get("validation", 0) < val_docs or got.get("test", 0) < test_docs or not got.get("train"):
        raise ValueError("too few families for three disjoint splits")
    return out
