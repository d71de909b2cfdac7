"""Paired comparison of two arms, bootstraps over documents or groups, seed summaries
and audits of run pairs."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.operators.resample import bootstraps

LN2 = math.log(2)
KEYS = ("sha256", "characters", "utf8_bytes")


def paired(fit: DataFrame, general: DataFrame) -> DataFrame:
    """pos, delta (fit - general nats), characters, utf8_bytes and both token counts. Raises
    unless both hold the same documents."""
    g = general.select(*[F.col(c).alias(f"g_{c}") for c in ("pos", *KEYS, "nll_nats", "text_tokens")])
    both = fit.join(g, F.col("pos") == F.col("g_pos"), "full_outer")
    differ = F.col("pos").isNull() | F.col("g_pos").isNull()
    for k in KEYS:
        differ = differ | ~F.col(k).eqNullSafe(F.col(f"g_{k}"))
    if both.where(differ).limit(1).count():
        raise ValueError("the arms' documents differ")
    return both.select("pos", "sha256", "characters", "utf8_bytes", (F.col("nll_nats") - F.col("g_nll_nats")).alias("delta"), F.col("text_tokens").alias("fit_tokens"), F.col("g_text_tokens").alias("general_tokens"))


def paired_difference(pairs: DataFrame) -> DataFrame:
    """One row: fit - general in nats and bits, token ratio and reduction."""
    d, ratio = F.sum("delta"), F.sum("fit_tokens") / F.sum("general_tokens")
    return pairs.agg(
        d.alias("nll_nats"), (d / (F.sum("utf8_bytes") * LN2)).alias("bits_per_utf8_byte"), (d / (F.sum("characters") * LN2)).alias("bits_per_character"), ratio.alias("token_ratio"), (1 - ratio).alias("token_reduction")
    )


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(1e-12 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-8))


def bootstrap(units: DataFrame, replicates: int, seed: int) -> DataFrame:
    """low, high, units of one comparison (unit, delta, utf8_bytes): see bootstraps."""
    return bootstraps(units, replicates, seed)


def group_totals(pairs: DataFrame, groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, group, delta, utf8_bytes. groups: pos, group; every pair needs one."""
    joined = pairs.join(groups, "pos", "left")
    if joined.where("group is null").limit(1).count():
        raise ValueError("a document has no group")
    return joined.groupBy(*by, "group").agg(F.sum("delta").alias("delta"), F.sum("utf8_bytes").alias("utf8_bytes"))


def seed_summary(values: DataFrame) -> DataFrame:
    """regime, seeds, means, paired mean, sample deviation (null for one seed), range and
    relative difference. values: regime, seed, fit_bpb, general_bpb."""
    d = F.col("fit_bpb") - F.col("general_bpb")
    return values.groupBy("regime").agg(
        F.count_distinct("seed").alias("seed_count"),
        F.avg("fit_bpb").alias("fit_mean_bpb"),
        F.avg("general_bpb").alias("general_mean_bpb"),
        F.avg(d).alias("paired_mean_bpb"),
        F.stddev_samp(d).alias("paired_sd"),
        F.min(d).alias("paired_min"),
        F.max(d).alias("paired_max"),
        ((F.avg("fit_bpb") - F.avg("general_bpb")) / F.avg("general_bpb")).alias("relative_mean_difference"),
    )


def missing_pairs(runs: DataFrame, regimes: list[str], seeds: list[int]) -> DataFrame:
    """regime, seed of the expected pairs that lack an arm (runs: regime, seed, label, status)."""
    spark = runs.sparkSession
    wanted = spark.createDataFrame([(r, s) for r in regimes for s in seeds], "regime string, seed long")
    have = runs.where("status = 'complete'").groupBy("regime", "seed").agg(F.count_distinct("label").alias("_n")).where("_n = 2")
    return wanted.join(have, ["regime", "seed"], "left_anti")


#: Which facts of two runs must agree. where: `run` (once a run) or `step` (at each of them);
#: regime: the only regime that a rule holds for. Facts are named by their place in a run's JSON.
PAIR_RULES: tuple[tuple[str, str, str | None], ...] = (
    ("run", "status", None),
    ("run", "parameters", None),
    ("run", "initial_weights_sha256", None),
    ("run", "config.*", None),
    ("run", "steps_recorded", None),
    ("both", "exposure.padded_positions", None),
    ("both", "exposure.raw_bytes", "raw"),
    ("both", "exposure.raw_chars", "raw"),
    ("both", "exposure.target_tokens", "token"),
    ("step", "step", None),
    ("step", "validation.utf8_bytes", None),
    ("step", "validation.characters", None),
    ("step", "validation.source_documents", None),
)
#: What may differ between the arms.
FREE = ("config.label", "config.tokenizer_sha256")


def _facts(value: Any, prefix: str = "") -> dict[str, str]:
    """A JSON value's leaves by dotted names; lists of objects by their hashes."""
    if isinstance(value, dict):
        return {k: v for name, x in value.items() for k, v in _facts(x, f"{prefix}{name}.").items()}
    if isinstance(value, list):
        value = [x.get("sha256") if isinstance(x, dict) else x for x in value]
    return {prefix[:-1]: json.dumps(value, sort_keys=True)}


def run_facts(spark: SparkSession, run: dict[str, Any]) -> DataFrame:
    """place (0 for the run, i for its i-th recorded step), fact, value: a run as rows."""
    whole = _facts({k: v for k, v in run.items() if k != "history"}) | {"steps_recorded": str(len(run["history"]))}
    rows = [(0, k, v) for k, v in whole.items()]
    rows += [(i, k, v) for i, step in enumerate(run["history"], 1) for k, v in _facts({**step, "validation": {k: v for k, v in step["validation"].items() if k != "documents"}}).items()]
    return spark.createDataFrame(rows, "place long, fact string, value string")


def pair_audit(fit: DataFrame, general: DataFrame) -> DataFrame:
    """Audit rows (audit, key, detail) of two runs' facts (run_facts): one for each fact that
    PAIR_RULES want equal and that is not, or that one of them lacks, or for a run that is not complete."""
    spark = fit.sparkSession
    rules = F.broadcast(spark.createDataFrame([(w, f.replace("*", "%"), r) for w, f, r in PAIR_RULES], "_where string, _like string, _regime string"))
    named = fit.where("place = 0 and fact = 'config.regime'").select("value").first()
    regime = json.loads(named["value"]) if named else None
    g = general.select(F.col("place").alias("_p"), F.col("fact").alias("_f"), F.col("value").alias("_v"))
    both = fit.join(g, (F.col("place") == F.col("_p")) & (F.col("fact") == F.col("_f")), "full_outer").select(F.coalesce("place", "_p").alias("place"), F.coalesce("fact", "_f").alias("fact"), "value", "_v")
    here = F.when(F.col("place") == 0, F.col("_where").isin("run", "both")).otherwise(F.col("_where").isin("step", "both"))
    asked = both.where(~F.col("fact").isin(*FREE)).join(rules, here & F.expr("fact LIKE _like")).where(F.col("_regime").isNull() | F.lit(regime).eqNullSafe(F.col("_regime")))
    text = lambda c: F.coalesce(c, F.lit("nothing"))
    unlike = asked.where(~F.col("value").eqNullSafe(F.col("_v"))).select(F.lit("pair").alias("audit"), F.concat_ws("@", "fact", F.col("place").cast("string")).alias("key"), F.concat(text(F.col("value")), F.lit(" is not "), text(F.col("_v"))).alias("detail"))
    arms = fit.withColumn("_arm", F.lit("fit")).unionByName(general.withColumn("_arm", F.lit("general"))).where("place = 0 and fact = 'status'")
    open_ = arms.where("value <> '\"complete\"'").select(F.lit("incomplete").alias("audit"), F.col("_arm").alias("key"), F.col("value").alias("detail"))
    return unlike.distinct().unionByName(open_)


def parameter_count(vocab: Column | int, dim: Column | int, layers: int, length: int):
    """Parameters of a tied-embedding transformer of this shape."""
    return vocab * dim + length * dim + layers * (12 * dim * dim + 13 * dim) + 2 * dim


def size_search(corpora: DataFrame, length: int = 512, heads: int = 8, layers: int = 8) -> DataFrame:
    """corpora (vocab, target, and whatever else) with dim, parameters: for each the width (a multiple
    of heads up to 2048) whose number of parameters is nearest to the target, the smallest of equals."""
    sizes = F.transform(F.sequence(F.lit(heads), F.lit(2048), F.lit(heads)), lambda d: F.struct(F.abs(parameter_count(F.col("vocab"), d.cast("long"), layers, length) - F.col("target")).alias("off"), d.cast("long").alias("dim")))
    best = corpora.withColumn("dim", F.array_min(sizes)["dim"])
    return best.withColumn("parameters", parameter_count(F.col("vocab"), F.col("dim"), layers, length))
