"""Reports over runs: all pairs of a matrix, replications over seeds, one pair of checkpoint
evaluations.

Runs are rows: `runs` (regime, seed, label, status, snapshot_sha256, tokenizer_sha256, identity: a
hash of whatever else a replication must share) and `scores` (regime, seed, label, pos, sha256,
nll_nats, utf8_bytes) with a row for each document of a run's last evaluation. Arms are labelled
fit and general. Groups (pos, group) are the families of the evaluation's documents; a document
without one is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.functions.codes import identity_hash
from loomtally.functions.text import portable_key
from loomtally.operators.audit import finding, require_none
from loomtally.operators.compare import LN2, group_totals, missing_pairs, seed_summary
from loomtally.operators.ordered import running_before
from loomtally.operators.resample import bootstraps
from loomtally.session import durable

ARM = ["regime", "seed", "label"]


def complete_runs(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'complete'")


def numbered(units: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """units with unit: 0, 1, ... within `by` in a portable pseudorandom order of a key without repeats."""
    keyed = durable(units.withColumn("_k", portable_key(0, F.col(key))).withColumn("_one", F.lit(1)), "units")
    return durable(running_before(keyed, "_one", ["_k", key], by, out="unit").drop("_k", "_one"), "numbered-units")


def arms_joined(scores: DataFrame) -> DataFrame:
    """regime, seed, pos, sha256, utf8_bytes, fit_nll, general_nll of the pairs that have both arms
    (others are left out). Raises where the two arms' documents differ."""
    side = lambda label: scores.where(F.col("label") == label)
    have = side("fit").select("regime", "seed").distinct().intersect(side("general").select("regime", "seed").distinct())
    fit = side("fit").join(have, ["regime", "seed"], "left_semi").select("regime", "seed", "pos", "sha256", "utf8_bytes", F.col("nll_nats").alias("fit_nll"))
    general = side("general").join(have, ["regime", "seed"], "left_semi").select("regime", "seed", "pos", F.col("sha256").alias("_s"), F.col("utf8_bytes").alias("_b"), F.col("nll_nats").alias("general_nll"))
    both = durable(fit.join(general, ["regime", "seed", "pos"], "full_outer"), "arms")
    apart = both.where(~(F.col("sha256").eqNullSafe(F.col("_s")) & F.col("utf8_bytes").eqNullSafe(F.col("_b"))))
    require_none(finding(apart, "documents differ", F.concat_ws("/", "regime", "seed", "pos"), F.coalesce("sha256", "_s")))
    return both.drop("_s", "_b")


def intervals(pairs: DataFrame, groups: DataFrame, replicates: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """by, low, high, units: group bootstraps of all comparisons (by, pos, delta, utf8_bytes), by one plan."""
    return bootstraps(numbered(group_totals(pairs, groups, by), "group", by), replicates, seed, by)


def matrix_report(runs: DataFrame, scores: DataFrame, groups: DataFrame, baselines: DataFrame | None = None, snapshot: str | None = None, replicates: int = 4000, seed: int = 31415) -> DataFrame:
    """A row for each pair of complete runs: regime, seed, fit_bpb, general_bpb, difference, low, high,
    groups, and with baselines (label, baseline_bpb) each arm's gain over its own."""
    done = complete_runs(runs)
    if snapshot is not None:
        require_none(finding(done.where(F.col("snapshot_sha256") != snapshot), "snapshot", F.concat_ws("/", *ARM), F.col("snapshot_sha256")))
    both = durable(arms_joined(scores.join(done.select(*ARM), ARM, "left_semi")), "matrix")
    bits = lambda c: F.sum(c) / (F.sum("utf8_bytes") * LN2)
    rows = both.groupBy("regime", "seed").agg(bits("fit_nll").alias("fit_bpb"), bits("general_nll").alias("general_bpb")).withColumn("difference", F.col("fit_bpb") - F.col("general_bpb"))
    if not rows.limit(1).count():
        raise ValueError("no pair of complete runs")
    pair = ["regime", "seed"]
    deltas = both.select(*pair, "pos", (F.col("fit_nll") - F.col("general_nll")).alias("delta"), "utf8_bytes")
    out = rows.join(intervals(deltas, groups, replicates, seed, pair).withColumnRenamed("units", "groups"), pair)
    if baselines is not None:
        of = lambda label: F.broadcast(baselines.where(F.col("label") == label).select("regime", F.col("baseline_bpb").alias(f"_{label}")))  # noqa: E731  a row a regime
        out = out.join(of("fit"), "regime", "left").join(of("general"), "regime", "left")
        out = out.select("*", (F.col("_fit") - F.col("fit_bpb")).alias("fit_gain"), (F.col("_general") - F.col("general_bpb")).alias("general_gain")).drop("_fit", "_general")
    return out


def replication_audit(runs: DataFrame) -> DataFrame:
    """Audit rows: arms that appear twice for a seed, and arms whose identity or tokenizer is not
    the same for all seeds."""
    done = complete_runs(runs)
    twice = done.groupBy(*ARM).count().where("count > 1")
    kinds = done.groupBy("regime", "label").agg(F.count_distinct(F.struct("identity", "tokenizer_sha256", "snapshot_sha256")).alias("n")).where("n > 1")
    return finding(twice, "repeated arm", F.concat_ws("/", *ARM), F.col("count")).unionByName(finding(kinds, "identity", F.concat_ws("/", "regime", "label"), F.col("n")))


def replication_report(runs: DataFrame, scores: DataFrame, groups: DataFrame, regimes: list[str], seeds: list[int], replicates: int = 4000, seed: int = 31415) -> tuple[DataFrame, DataFrame]:
    """(a row a regime: what seed_summary gives, and the group bootstrap low, high of the seeds' mean
    cost; missing: regime, seed of expected pairs that lack an arm). Raises on replication_audit."""
    asked = runs.where(F.col("seed").isin(seeds))
    require_none(replication_audit(asked))
    both = durable(arms_joined(scores.join(complete_runs(asked).select(*ARM), ARM, "left_semi")), "replication")
    bits = lambda c: F.sum(c) / (F.sum("utf8_bytes") * LN2)
    values = both.groupBy("regime", "seed").agg(bits("fit_nll").alias("fit_bpb"), bits("general_nll").alias("general_bpb"))
    expected = values.groupBy("regime").agg(F.count(F.lit(1)).alias("_seeds"))
    # the same documents for all seeds
    seen = both.groupBy("regime", "pos").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(F.struct("sha256", "utf8_bytes")).alias("_kinds"), (F.avg("fit_nll") - F.avg("general_nll")).alias("delta"), F.first("utf8_bytes").alias("utf8_bytes"))
    mean = durable(seen.join(expected, "regime"), "seed-means")
    require_none(finding(mean.where("_n <> _seeds or _kinds <> 1"), "evaluation", F.concat_ws("/", "regime", "pos"), F.col("_n")))
    if not expected.limit(1).count():
        raise ValueError("no pair of complete runs")
    found = intervals(mean, groups, replicates, seed, ["regime"]).withColumnRenamed("units", "groups")
    return seed_summary(values).join(found, "regime"), missing_pairs(asked, regimes, seeds)


def sealed(result: dict[str, Any]) -> dict[str, Any]:
    """The result with a hash of itself."""
    return {**result, "payload_sha256": identity_hash({k: v for k, v in result.items() if k != "payload_sha256"})}


def require_sealed(result: dict[str, Any]) -> dict[str, Any]:
    """The result, if it is complete and matches its own hash."""
    if result.get("status") != "complete" or sealed(result) != result:
        raise ValueError("the evaluation is incomplete or was altered")
    return result


def checkpoint_pair(fit: dict[str, Any], general: dict[str, Any], fit_scores: DataFrame, general_scores: DataFrame, groups: DataFrame, snapshot: str, replicates: int = 4000, seed: int = 31415) -> DataFrame:
    """One row: fit_bpb, general_bpb, difference, relative_improvement, low, high, groups of two sealed
    evaluations (identity: snapshot_manifest_sha256, protocol) and their documents' scores (pos,
    sha256, nll_nats, utf8_bytes)."""
    for result in (fit, general):
        require_sealed(result)
        if result["identity"]["snapshot_manifest_sha256"] != snapshot:
            raise ValueError("an evaluation belongs to another snapshot")
    if fit["identity"]["protocol"] != general["identity"]["protocol"]:
        raise ValueError("the evaluations follow unlike protocols")
    arm = lambda df, label: df.select(F.lit("checkpoint").alias("regime"), F.lit(0).alias("seed"), F.lit(label).alias("label"), "pos", "sha256", "nll_nats", "utf8_bytes")
    both = durable(arms_joined(arm(fit_scores, "fit").unionByName(arm(general_scores, "general"))), "checkpoint-pair")
    bits = lambda c: F.sum(c) / (F.sum("utf8_bytes") * LN2)
    one = both.agg(bits("fit_nll").alias("fit_bpb"), bits("general_nll").alias("general_bpb"))
    found = intervals(both.select("pos", (F.col("fit_nll") - F.col("general_nll")).alias("delta"), "utf8_bytes"), groups, replicates, seed).first()
    bounds = [F.lit(found[k]).alias(a) for k, a in (("low", "low"), ("high", "high"), ("units", "groups"))]
    difference = F.col("fit_bpb") - F.col("general_bpb")
    return one.select("fit_bpb", "general_bpb", difference.alias("difference"), (-difference / F.col("general_bpb")).alias("relative_improvement"), *bounds)


def figure_rows(history: DataFrame, baselines: DataFrame) -> DataFrame:
    """history (regime, label, seed, step, bits_per_utf8_byte, utf8_bytes) with each arm's baseline
    (regime, label, baseline_bpb, utf8_bytes) and the gain over it. Raises where the bytes differ."""
    base = F.broadcast(baselines.select("regime", "label", "baseline_bpb", F.col("utf8_bytes").alias("_b")))  # a row for each arm
    rows = history.join(base, ["regime", "label"], "left")
    require_none(finding(rows.where(~F.col("utf8_bytes").eqNullSafe(F.col("_b"))), "baseline", F.concat_ws("/", "regime", "label", "step"), F.col("_b")))
    return rows.drop("_b").withColumn("gain", F.col("baseline_bpb") - F.col("bits_per_utf8_byte"))
