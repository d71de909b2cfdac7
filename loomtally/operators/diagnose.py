"""Two tokenizers compared on one corpus: coding costs of whole documents and of raw blocks under
uniform and unigram baselines, vocabulary use, and examples of their cuts.

An arm is a function from documents (pos, text) to encoded documents (pos, characters, utf8_bytes,
histogram or token_ids). Blocks are encoded one by one, since a block's border changes merges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.functions.text import text_sha256
from loomtally.operators.blocks import raw_blocks
from loomtally.operators.compare import paired, paired_difference
from loomtally.operators.score import histograms, score_counts, token_counts, unseen_of, vocabulary_usage
from loomtally.operators.ordered import running_before
from loomtally.session import durable

Encoder = Callable[[DataFrame], DataFrame]
SEGMENTATIONS = ("whole_documents", "shared_raw_blocks")


def _segments(docs: DataFrame, segmentation: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(segments pos, text; parents pos, parent)."""
    if segmentation == "whole_documents":
        return docs.select("pos", "text"), docs.select("pos", F.col("pos").alias("parent"))
    cut = durable(raw_blocks(docs, block_bytes).withColumn("_one", F.lit(1).cast("long")), "blocks")
    named = durable(running_before(cut, "_one", ["pos", "block_pos"], out="_id").select(F.col("_id").alias("pos"), F.col("pos").alias("parent"), F.col("block").alias("text")), "numbered-blocks")
    return named.select("pos", "text"), named.select("pos", "parent")


def _learned(docs: DataFrame, segmentation: str, block_bytes: int) -> DataFrame:
    """Segments to be counted only: their positions tell nothing."""
    if segmentation == "whole_documents":
        return docs.select("pos", "text")
    return raw_blocks(docs, block_bytes).select(F.monotonically_increasing_id().alias("pos"), F.col("block").alias("text"))


def _of_documents(scores: DataFrame, parents: DataFrame, docs: DataFrame) -> DataFrame:
    """Segments' scores summed to their documents, zeros for those without any."""
    sums = scores.join(parents, "pos").groupBy(F.col("parent").alias("_p")).agg(*[F.sum(c).alias(c) for c in ("nll_nats", "uniform_nats", "text_tokens", "scored_tokens")])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    own = docs.select("pos", text_sha256(F.col("text")).alias("sha256"), F.length("text").cast("long").alias("characters"), F.octet_length("text").cast("long").alias("utf8_bytes"))
    return own.join(sums, F.col("pos") == F.col("_p"), "left").select("pos", "sha256", "characters", "utf8_bytes", zero("nll_nats"), zero("uniform_nats"), zero("text_tokens"), zero("scored_tokens"))


def diagnose(train: DataFrame, evaluation: DataFrame, arms: dict[str, Encoder], vocab_size: int, controls: tuple[int, ...] = (), block_bytes: int = 128) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores: label, segmentation, baseline, pos, nll_nats, text_tokens, characters, utf8_bytes of
    each evaluation document; usage: label, segmentation and vocabulary_usage with what training
    lacks; differences: segmentation, baseline and paired_difference of fit and general). Both
    arms, fit and general, share the vocabulary's size."""
    scores, usage, differences = [], [], []
    for segmentation in SEGMENTATIONS:
        learn = _learned(train, segmentation, block_bytes)
        judged, parents = _segments(evaluation, segmentation, block_bytes)
        parts = {}
        for label in ("fit", "general"):
            counts, held = durable(token_counts(arms[label](learn)), "training-counts"), durable(histograms(arms[label](judged)), "evaluation-tokens")
            parts[label] = durable(_of_documents(score_counts(counts, held, vocab_size), parents, evaluation), "arm")
            used = vocabulary_usage(held, vocab_size, controls)
            lacks = unseen_of(counts, token_counts(held)).first()
            usage.append(used.select(F.lit(label).alias("label"), F.lit(segmentation).alias("segmentation"), "*", *[F.lit(lacks[k]).alias(k) for k in ("unseen_ids", "unseen_tokens", "unseen_fraction")]))
        for baseline, nll in (("uniform", "uniform_nats"), ("unigram", "nll_nats")):
            one = {k: p.select("pos", "sha256", "characters", "utf8_bytes", F.col(nll).alias("nll_nats"), "text_tokens") for k, p in parts.items()}
            named = [F.lit(segmentation).alias("segmentation"), F.lit(baseline).alias("baseline")]
            scores += [p.select(F.lit(k).alias("label"), *named, "pos", "nll_nats", "text_tokens", "characters", "utf8_bytes") for k, p in one.items()]
            differences.append(paired_difference(paired(one["fit"], one["general"])).select(*named, "*"))
    joined = lambda parts: parts[0] if len(parts) == 1 else joined([parts[0].unionByName(parts[1]), *parts[2:]])
    return joined(scores), joined(usage), joined(differences)


def segmentation_examples(docs: DataFrame, path: str, count: int = 3, length: int = 120) -> DataFrame:
    """pos, text, truncated, token_ids, token_symbols, starts, ends, roundtrip_exact of the beginnings
    of the first `count` documents: a report, not a filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for batch in batches:
            rows = []
            for pos, text in zip(batch["pos"].tolist(), batch["text"].tolist(), strict=True):
                short = (text or "")[:length]
                e = tok.encode(short, add_special_tokens=False)
                rows.append((pos, short, len(text or "") > length, e.ids, e.tokens, [a for a, _ in e.offsets], [b for _, b in e.offsets], tok.decode(e.ids, skip_special_tokens=False) == short))
            if rows:
                yield pd.DataFrame(rows, columns=["pos", "text", "truncated", "token_ids", "token_symbols", "starts", "ends", "roundtrip_exact"])

    schema = "pos long, text string, truncated boolean, token_ids array<int>, token_symbols array<string>, starts array<int>, ends array<int>, roundtrip_exact boolean"
    return docs.select("pos", "text").orderBy("pos").limit(count).mapInPandas(run, schema)
