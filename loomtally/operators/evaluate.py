"""Evaluation of a scorer over a held-out split, kept under the identity of what was asked.

A scorer stands for a trained model (operators/score.py): it gives costs of windows' labels. The
result is a sealed JSON file with a table of scores beside it; asking again with the same identity
returns it, asking with another for the same place is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.functions.codes import identity_hash
from loomtally.operators.audit import require_none, scored_once_audit
from loomtally.operators.blocks import chunk_windows
from loomtally.operators.diagnose import _segments
from loomtally.operators.report import require_sealed, sealed
from loomtally.operators.score import LN2, Scorer, score_rolling, score_windows
from loomtally.session import durable
from loomtally.sources.snapshot import exists, read_json, write_json

MODES, POLICIES = ("raw", "token"), ("chunks", "rolling")


def evaluate(docs: DataFrame, encode: Callable[[DataFrame], DataFrame], make: Callable[[], Scorer], context: int, bos: int, out: str, identity: dict[str, Any], mode: str = "raw", policy: str = "chunks", block_bytes: int | None = None) -> tuple[dict[str, Any], DataFrame]:
    """(result, scores: pos, nll_nats, scored_tokens, characters, utf8_bytes of every document).

    raw: documents are cut into blocks of block_bytes (context by default) that are encoded one by
    one; token: whole documents are encoded and their tokens cut. chunks: a window starts anew every
    `context` tokens; rolling: each token is scored behind up to `context` others. Every token is
    scored just once, or it raises."""
    if mode not in MODES or policy not in POLICIES:
        raise ValueError(f"mode is one of {MODES}, policy one of {POLICIES}")
    if mode == "token" and block_bytes is not None:
        raise ValueError("only raw mode has blocks")
    size = context if block_bytes is None else block_bytes
    if mode == "raw" and not 4 <= size <= context:
        raise ValueError("blocks hold 4 bytes at least and no more than the context")
    spark = docs.sparkSession
    asked = {**identity, "protocol": {"mode": mode, "policy": policy, "context": context, "block_bytes": size if mode == "raw" else None, "bos": bos}}
    if exists(spark, f"{out}.json"):
        kept = require_sealed(read_json(spark, f"{out}.json"))
        if kept["identity"] != asked or kept["identity_sha256"] != identity_hash(asked):
            raise ValueError("the place holds the evaluation of something else")
        return kept, spark.read.parquet(out)
    segments, parents = _segments(docs, "shared_raw_blocks" if mode == "raw" else "whole_documents", size)
    coded = durable(encode(segments), "evaluation-tokens")
    if mode == "raw" and coded.where(F.size("token_ids") > context).limit(1).count():
        raise ValueError("a block has more tokens than the context holds")
    scored = durable(score_windows(chunk_windows(coded, context, bos), make) if policy == "chunks" else score_rolling(coded, context, bos, make), "scored")
    require_none(scored_once_audit(coded.where(F.size("token_ids") > 0).select("pos", F.size("token_ids").cast("long").alias("n")), scored))
    sums = scored.join(parents, "pos").groupBy(F.col("parent").alias("_p")).agg(F.sum("nll_nats").alias("nll_nats"), F.sum("scored_tokens").alias("scored_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = docs.select("pos", F.length("text").cast("long").alias("characters"), F.octet_length("text").cast("long").alias("utf8_bytes")).join(sums, F.col("pos") == F.col("_p"), "left")
    rows.select("pos", zero("nll_nats"), zero("scored_tokens"), "characters", "utf8_bytes").write.parquet(out)
    scores = spark.read.parquet(out)
    total = scores.agg(F.sum("nll_nats").alias("n"), F.sum("utf8_bytes").alias("b"), F.sum("scored_tokens").alias("t"), F.count(F.lit(1)).alias("d")).first()
    bits = float(total["n"]) / total["b"] / LN2 if total["b"] else None
    result = sealed({"status": "complete", "identity": asked, "identity_sha256": identity_hash(asked), "scores": {"documents": total["d"], "nll_nats": total["n"], "utf8_bytes": total["b"], "scored_tokens": total["t"], "bits_per_utf8_byte": bits}})
    write_json(spark, f"{out}.json", result)
    return result, scores
