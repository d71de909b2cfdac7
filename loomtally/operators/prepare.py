"""Preparation of snapshots as whole plans: selection, removal of copies, splits, budgets, publication."""

from __future__ import annotations

from fractions import Fraction
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.functions.text import portable_key, text_sha256
from loomtally.operators.audit import blank_audit, disjoint_audit, distinct_counts, require_none
from loomtally.operators.dedup import anchored_dedup, exact_dedup, near_dedup
from loomtally.operators.ordered import running_before
from loomtally.operators.select import candidate_reasons, character_prefix, file_reasons, scan_until, until_characters
from loomtally.operators.split import document_split, group_split
from loomtally.session import durable
from loomtally.sources.snapshot import publish

HELD = ("train", "validation", "test")


def shuffled(docs: DataFrame, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """docs with pos renumbered from 0 in a portable pseudorandom order, within each `by`."""
    keyed = durable(docs.withColumn("_k", portable_key(seed, F.col("pos"))).withColumn("_one", F.lit(1).cast("long")), "shuffle")
    return running_before(keyed, "_one", ["_k", "pos"], list(by), out="_place").drop("pos", "_k", "_one").withColumnRenamed("_place", "pos")


def plain_snapshot(spark, path: str, target: DataFrame, general: DataFrame, val_docs: int, test_docs: int, budget: int, sources: dict[str, Any], seed: int = 0) -> dict[str, Any]:
    """Publish a snapshot of two corpora (pos, text): copies go, the general corpus loses every text
    of the target, the target is split by documents."""
    require_none(blank_audit(target.select("pos", "text").unionByName(general.select("pos", "text"))))
    own, other = exact_dedup(target), exact_dedup(general)
    kept = durable(target.join(own.select("pos"), "pos", "left_semi").select("pos", "text"), "target")
    rest = other.join(own.select("sha256"), "sha256", "left_anti").select("pos")
    named = kept.join(document_split(kept, val_docs, test_docs, seed), "pos").withColumnRenamed("split", "partition")
    texts = named.select("partition", "pos", "text").unionByName(general.join(rest, "pos", "left_semi").select(F.lit("general").alias("partition"), "pos", "text"))
    return publish(spark, path, durable(shuffled(texts, seed + 1, ("partition",)).select("partition", "pos", "text"), "snapshot"), sources, budget)


def code_snapshot(
    spark, path: str, files: DataFrame, general: DataFrame, val_docs: int, test_docs: int, budget: int, sources: dict[str, Any], max_docs: int | None = None, max_scanned: int | None = None, threshold: Fraction = Fraction(17, 20), seed: int = 2026
) -> dict[str, Any]:
    """Publish a snapshot of source files (pos, text, path, repo, family) and a general corpus (pos,
    text): reasons, a bounded scan, near-duplicates, families to one split each, shuffles, equal
    budgets, and metadata aligned with the texts."""
    reasons = durable(scan_until(file_reasons(files), max_docs, max_scanned), "reasons")
    chosen = durable(files.join(reasons.where("reason = 'selected'").select("pos"), "pos", "left_semi"), "selected")
    state, _ = near_dedup(chosen.select("pos", "text"), threshold)
    kept = durable(chosen.join(state.where("kept").select("pos"), "pos", "left_semi"), "kept")
    splits = group_split(kept.select("pos", "family"), val_docs, test_docs, seed).select("family", F.col("split").alias("partition"))
    code = durable(shuffled(kept.join(splits, "family"), seed + 10, ("partition",)), "code")
    taken = chosen.select(text_sha256(F.col("text")).alias("sha256")).distinct()  # also what near-duplicates lost
    first = exact_dedup(general).join(taken, "sha256", "left_anti").select("pos")
    prose = durable(shuffled(general.join(first, "pos", "left_semi").select("pos", "text"), seed + 1), "prose")
    texts = code.select("partition", "pos", "text").unionByName(prose.select(F.lit("general").alias("partition"), "pos", "text"))
    metadata = code.select("partition", "pos", text_sha256(F.col("text")).alias("sha256"), "repo", "family", "path")
    counts = {r["reason"]: r["n"] for r in reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each reason
    names = {r["partition"]: {"repositories": r["repositories"], "families": r["families"]} for r in distinct_counts(metadata, "partition").collect()}
    return publish(spark, path, texts, {**sources, "selection": counts, "near_duplicates": chosen.count() - kept.count(), "names": names}, budget, metadata)


def disjoint_corpus(candidates: DataFrame, references: DataFrame, candidate_characters: int, budget: int, threshold: Fraction = Fraction(17, 20), seed: int = 2026) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training, full, metadata) of a tokenizer corpus that shares no family, text or near-duplicate
    with the references (pos, text, family; positions apart from the candidates'). candidates: pos,
    text, path, repo, family. Audited before it is returned."""
    reasons = candidate_reasons(candidates, references)
    chosen = candidates.join(reasons.where("reason = 'selected'").select("pos"), "pos", "left_semi")
    chosen = durable(until_characters(chosen, candidate_characters), "candidates")
    state, _ = anchored_dedup(references.select("pos", "text"), chosen.select("pos", "text"), threshold)
    kept = durable(shuffled(chosen.join(state.where("kept").select("pos"), "pos", "left_semi"), seed), "disjoint")
    cut = durable(character_prefix(kept, budget), "training")
    hashed = lambda d: d.select("pos", "text", text_sha256(F.col("text")).alias("sha256"))
    training, full = durable(hashed(cut), "training"), durable(hashed(kept.join(cut.select("pos"), "pos", "left_semi")), "full")
    metadata = cut.select("pos", "repo", "family", "path", text_sha256(F.col("text")).alias("sha256")).join(full.select("pos", F.col("sha256").alias("full_sha256")), "pos")
    require_none(disjoint_audit(training, full, metadata, references, budget))
    return training, full, metadata
