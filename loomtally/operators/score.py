"""Coding costs: token counts, uniform and add-alpha unigram baselines, summaries,
vocabulary use, and a hook for external scorers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.operators.blocks import RollingViews, over_rolling
from loomtally.operators.encode import encoded_once
from loomtally.operators.portions import portions
from loomtally.session import durable

LN2 = math.log(2)


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts of an Arrow string column, ends of each text). A null is empty."""
    filled = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _over_bytes(docs: DataFrame, keep: Sequence[str], make: Callable[[np.ndarray, np.ndarray], pa.Array], name: str, kind: str) -> DataFrame:
    """pos, keep, characters, utf8_bytes and what make gives of each text's bytes, by portions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text"):
            data, ends = utf8_bytes(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], make(data, ends)], names=[*batch.schema.names[:-1], name])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("pos", *keep, F.length(text).cast("long").alias("characters"), F.octet_length(text).cast("long").alias("utf8_bytes"), text.alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, {name} {kind}")


def byte_documents(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """pos, keep, characters, utf8_bytes, token_ids of the byte tokenizer."""

    def ids(data: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(data.astype(np.int32)))

    return _over_bytes(docs, keep, ids, "token_ids", "array<int>")


def byte_histograms(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """pos, keep, characters, utf8_bytes, histogram (token, m) of each text's byte tokens: as many
    entries as it has distinct bytes, however long it is."""

    def count(data: np.ndarray, ends: np.ndarray) -> pa.Array:
        n = len(ends) - 1
        cells = np.bincount(np.repeat(np.arange(n) * 256, np.diff(ends)) + data, minlength=n * 256)
        at = np.nonzero(cells)[0]
        entries = pa.StructArray.from_arrays([pa.array((at % 256).astype(np.int32)), pa.array(cells[at].astype(np.int64))], names=["token", "m"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1) * 256).astype(np.int32)), entries)

    return _over_bytes(docs, keep, count, "histogram", "array<struct<token:int,m:bigint>>")


def histograms(encoded: DataFrame) -> DataFrame:
    """encoded with token_ids replaced by their histogram, counted within each document."""
    if "histogram" in encoded.columns:
        return encoded
    kept = [f for f in encoded.schema.fields if f.name != "token_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "token_ids"):
            lists = batch.column("token_ids")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            # a document and a token in one number, counted at once for the portion
            low, span = (int(values.min()), int(values.max()) - int(values.min()) + 1) if len(values) else (0, 1)
            cells, counts = np.unique(doc * span + values - low, return_counts=True)
            entries = pa.StructArray.from_arrays([pa.array((cells % span + low).astype(np.int32)), pa.array(counts.astype(np.int64))], names=["token", "m"])
            ends = np.searchsorted(cells, np.arange(len(lists) + 1) * span).astype(np.int32)
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), entries)], names=[*[f.name for f in kept], "histogram"])

    return encoded.select(*[f"`{f.name}`" for f in kept], "token_ids").mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "histogram array<struct<token:int,m:bigint>>")


def encoded_documents(docs: DataFrame, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """The same for a tokenizer file of the tokenizers library; literal special strings are text."""
    return encoded_once(docs, path, tuple(keep))


def lossless(docs: DataFrame, path: str) -> DataFrame:
    """Audit rows: positions of texts that the tokenizer does not give back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for batch in batches:
            texts = [t or "" for t in batch["text"].tolist()]
            back = tok.decode_batch([e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)], skip_special_tokens=False)
            yield batch.loc[[a != b for a, b in zip(texts, back, strict=True)], ["pos"]]

    return docs.select("pos", "text").mapInPandas(run, "pos long")


def token_counts(encoded: DataFrame, eos: int | None = None) -> DataFrame:
    """token, count over all documents (histogram or token_ids); with eos, one end for each
    document. Counted within documents first, so no row for each token is made."""
    each = histograms(encoded).select("histogram")
    ends = F.col("histogram") if eos is None else F.concat("histogram", F.array(F.struct(F.lit(eos).alias("token"), F.lit(1).cast("long").alias("m"))))
    return each.select(F.explode(ends).alias("x")).groupBy("x.token").agg(F.sum("x.m").alias("count"))


def check_alpha(alpha: float) -> float:
    if not math.isfinite(alpha) or alpha <= 0:
        raise ValueError("alpha must be finite and above 0")
    return float(alpha)


def unigram_nll(train: DataFrame, evaluation: DataFrame, vocab_size: int, alpha: float = 1.0, eos: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """pos, keep, scored_tokens, text_tokens, characters, utf8_bytes, nll_nats, uniform_nats of the
    evaluation documents under the add-alpha unigram of the training documents."""
    a = check_alpha(alpha)
    return score_counts(token_counts(train, eos), evaluation, vocab_size, a, eos, keep)


#: Largest vocabulary whose costs are put into the plan (doubles); beyond it they are joined.
COSTS_IN_PLAN = 1 << 18


def score_counts(counts: DataFrame, evaluation: DataFrame, vocab_size: int, alpha: float = 1.0, eos: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """As unigram_nll, from a table of counts (token, count). A document's cost is the sum over
    its histogram, so documents are not shuffled; the vocabulary's costs go with the plan."""
    a = check_alpha(alpha)
    rows = counts.limit(COSTS_IN_PLAN + 1).toPandas()  # at most a row for each token of the vocabulary, and bounded
    token, count = rows["token"].to_numpy(dtype=np.int64), rows["count"].to_numpy(dtype=np.int64)
    if counts.where(~F.col("token").between(0, vocab_size - 1)).limit(1).count() if len(rows) > COSTS_IN_PLAN else ((token < 0) | (token >= vocab_size)).any():
        raise ValueError("a token id lies outside the vocabulary")
    held = histograms(evaluation)
    tokens = F.aggregate("histogram", F.lit(0).cast("long"), lambda s, x: s + x["m"])
    if vocab_size <= COSTS_IN_PLAN:
        total = float(count.sum()) + a * vocab_size
        cost = np.full(vocab_size, math.log(total) - math.log(a))
        cost[token] = math.log(total) - np.log(count + a)
        at = F.lit(cost)
        price = F.aggregate("histogram", F.lit(0.0), lambda s, x: s + x["m"] * F.get(at, x["token"]))
        priced = held.withColumn("_nll", price + (F.lit(0.0) if eos is None else F.lit(float(cost[eos]))))
    else:
        total = counts.agg(F.sum("count")).first()[0] or 0
        cost = F.lit(math.log(total + a * vocab_size)) - F.log(F.coalesce("count", F.lit(0)) + F.lit(a))
        ends = F.col("histogram") if eos is None else F.concat("histogram", F.array(F.struct(F.lit(eos).alias("token"), F.lit(1).cast("long").alias("m"))))
        single = held.select(F.col("pos").alias("_p"), F.explode_outer(ends).alias("x")).select("_p", "x.token", "x.m")
        sums = single.join(counts, "token", "left").groupBy("_p").agg(F.coalesce(F.sum(F.col("m") * cost), F.lit(0.0)).alias("_nll"))
        priced = held.join(sums, F.col("pos") == F.col("_p"))
    scored = tokens + (0 if eos is None else 1)
    return priced.select("pos", *keep, scored.alias("scored_tokens"), tokens.alias("text_tokens"), "characters", "utf8_bytes", F.col("_nll").alias("nll_nats"), (scored * F.lit(math.log(vocab_size))).alias("uniform_nats"))


def summarize(scores: DataFrame, nll: str = "nll_nats", by: tuple[str, ...] = ()) -> DataFrame:
    """Ratios of sums over documents: nats and bits per token, character and byte."""
    total = F.sum(nll)
    per_token = total / F.sum("scored_tokens")
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("document_count"),
        F.sum("scored_tokens").alias("scored_tokens"),
        F.sum("text_tokens").alias("text_tokens"),
        F.sum("characters").alias("characters"),
        F.sum("utf8_bytes").alias("utf8_bytes"),
        total.alias("nll_nats"),
        per_token.alias("nats_per_token"),
        F.when(per_token < 709, F.exp(per_token)).alias("perplexity"),
        (total / (F.sum("characters") * LN2)).alias("bits_per_character"),
        (total / (F.sum("utf8_bytes") * LN2)).alias("bits_per_utf8_byte"),
        (F.sum("characters") / F.sum("text_tokens")).alias("characters_per_token"),
    )


def vocabulary_usage(encoded: DataFrame, vocab_size: int, controls: tuple[int, ...]) -> DataFrame:
    """One row: totals, compression, used share of the vocabulary, entropy of the tokens."""
    counts = durable(token_counts(encoded), "token-counts")
    if controls and counts.where(F.col("token").isin(*controls)).limit(1).count():
        raise ValueError("a control token stands in ordinary text")
    whole = encoded.agg(F.count(F.lit(1)).alias("d"), F.sum("characters").alias("c"), F.sum("utf8_bytes").alias("b")).first()
    documents, characters, utf8_bytes = (F.lit(int(whole[k] or 0)).cast("long") for k in ("d", "c", "b"))
    n = F.sum("count")
    # -sum(p ln p) = ln N - sum(c ln c) / N
    used = counts.agg(n.alias("tokens"), F.count(F.lit(1)).alias("unique_ids"), (F.log(n) - F.sum(F.col("count") * F.log("count")) / n).alias("entropy_nats"))
    return used.select(
        documents.alias("documents"), "tokens", characters.alias("characters"), utf8_bytes.alias("utf8_bytes"), "unique_ids",
        (characters / F.col("tokens")).alias("characters_per_token"),
        (utf8_bytes / F.col("tokens")).alias("bytes_per_token"),
        (F.col("tokens") / utf8_bytes).alias("tokens_per_byte"),
        (F.col("unique_ids") / vocab_size).alias("fraction_vocabulary"),
        (F.col("unique_ids") / (vocab_size - len(controls))).alias("fraction_noncontrol"),
        (F.col("entropy_nats") / LN2).alias("entropy_bits"),
        F.exp("entropy_nats").alias("effective_vocabulary"),
    )


def top_tokens(encoded: DataFrame, k: int = 20) -> DataFrame:
    return token_counts(encoded).orderBy(F.desc("count"), F.asc("token")).limit(k)


def unseen_tokens(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """unseen_ids, unseen_tokens, fraction of the evaluation's tokens that training lacks."""
    return unseen_of(token_counts(train), token_counts(evaluation))


def unseen_of(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """The same, from counts (token, count)."""
    seen = train.select("token", F.lit(1).alias("_seen"))
    marked = evaluation.join(seen, "token", "left")
    gone = F.col("_seen").isNull()
    unseen = F.coalesce(F.sum(F.when(gone, F.col("count"))), F.lit(0))
    return marked.agg(F.count(F.when(gone, 1)).alias("unseen_ids"), unseen.alias("unseen_tokens"), (unseen / F.sum("count")).alias("unseen_fraction"))


class Scorer(Protocol):
    """A model: negative log probabilities (nats) of the labels of a batch of windows."""

    def __call__(self, inputs: list[list[int]], labels: list[list[int]]) -> list[float]: ...


#: Rolling windows that a scorer is given at a time.
WINDOWS_AT_ONCE = 4096


def score_rolling(tokens: DataFrame, length: int, bos: int, make: Callable[[], Scorer]) -> DataFrame:
    """pos, nll_nats, scored_tokens of documents (pos, token_ids) whose tokens are each scored behind
    up to `length` others. Windows are views of a document's tokens and never rows."""

    def folder() -> Callable[[RollingViews], tuple[float, int]]:
        scorer = make()

        def fold(views: RollingViews) -> tuple[float, int]:
            total = 0.0
            for first in range(0, len(views), WINDOWS_AT_ONCE):
                end = min(len(views), first + WINDOWS_AT_ONCE)
                nll = scorer([x.tolist() for x in views.inputs(first, end)], [[x] for x in views.labels[first:end].tolist()])
                if not all(math.isfinite(x) for x in nll):
                    raise ValueError("a cost is not finite")
                total = math.fsum([total, *nll])
            return total, len(views)

        return fold

    return over_rolling(tokens, length, bos, folder, "nll_nats double, scored_tokens long")


def score_windows(windows: DataFrame, make: Callable[[], Scorer]) -> DataFrame:
    """pos, nll_nats, scored_tokens from windows (pos, inputs, labels). make() builds the
    scorer once in each task; costs are summed in double precision."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for batch in batches:
            labels = [list(x) for x in batch["labels"]]
            nll = scorer([list(x) for x in batch["inputs"]], labels)
            if not all(math.isfinite(x) for x in nll):
                raise ValueError("a cost is not finite")
            yield pd.DataFrame({"pos": batch["pos"], "nll_nats": nll, "n": [len(x) for x in labels]})

    return windows.select("pos", "inputs", "labels").mapInPandas(run, "pos long, nll_nats double, n long").groupBy("pos").agg(F.sum("nll_nats").alias("nll_nats"), F.sum("n").alias("scored_tokens"))
