"""What a training run has seen: examples, the seeded order in which they are drawn, and the
tokens, bytes and characters drawn.

An example is a raw block or a packed window. A run draws `steps` x `batch` examples from seeded
permutations of all, a new one as soon as one is used up. So an example is drawn once for each
full permutation, and once more if its rank in the last one is among the rest: a replay is one
rank for each example, never a row for each draw.

portable: a permutation is the order of an md5 key, which any SQL engine can compute. exact: the
permutations of numpy's default generator, drawn on the driver (as many numbers as draws).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.functions.text import portable_key
from loomtally.operators.audit import AUDIT
from loomtally.operators.blocks import completed_characters, raw_blocks, seeded_batches
from loomtally.operators.ordered import running_before
from loomtally.operators.portions import portions
from loomtally.operators.score import byte_documents, encoded_documents, utf8_bytes
from loomtally.session import durable


def token_extents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """pos, ids, widths, chars: a document's tokens, the bytes each stands for and the code points
    it completes. Without a tokenizer file tokens are bytes."""

    if path is None:
        return _byte_extents(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for batch in portions(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [tok.encode(t, add_special_tokens=False) for t in texts]
            widths = [[len(symbol) for symbol in e.tokens] for e in found]  # a byte-level symbol is a letter for each byte
            lists = [[e.ids for e in found], widths, [completed_characters(t, w) for t, w in zip(texts, widths, strict=True)]]
            yield pa.RecordBatch.from_arrays([batch.column("pos").cast(pa.int64()), *[pa.array(x, pa.list_(pa.int32())) for x in lists]], names=["pos", "ids", "widths", "chars"])

    return docs.select("pos", "text").mapInArrow(run, "pos long, ids array<int>, widths array<int>, chars array<int>")


def _byte_extents(docs: DataFrame) -> DataFrame:
    """token_extents of bytes, a portion of texts at a time: a byte completes a code point where
    no continuation byte follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text"):
            data, ends = utf8_bytes(batch.column("_text"))
            last = (np.append(data[1:], 0)[: len(data)] & 0xC0) != 0x80
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (data, np.ones(len(data)), last)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["pos", "ids", "widths", "chars"])

    return docs.select("pos", F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, "pos long, ids array<int>, widths array<int>, chars array<int>")


def raw_examples(docs: DataFrame, length: int, path: str | None = None) -> DataFrame:
    """example, ids, raw_bytes, raw_chars of all raw blocks, numbered in order."""
    made = durable(raw_blocks(docs, length).withColumn("_one", F.lit(1).cast("long")), "blocks")
    numbered = running_before(made, "_one", ["pos", "block_pos"], out="example").select(F.col("example").alias("pos"), F.col("block").alias("text"))
    coded = byte_documents(numbered) if path is None else encoded_documents(numbered, path)
    return coded.select(F.col("pos").alias("example"), F.col("token_ids").alias("ids"), F.col("utf8_bytes").alias("raw_bytes"), F.col("characters").alias("raw_chars"))


def _pieces(placed: DataFrame, length: int, eos: int, windows: int, tokens, wide: str) -> DataFrame:
    """example, ids, raw_bytes, raw_chars: documents (at and what `tokens` reads) cut where windows of
    the packed stream begin, a portion (by the column `wide`) at a time. tokens gives a portion's ids,
    widths and completed code points one after another, and the ends of each document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, wide):
            *columns, ends = tokens(batch)
            # a control behind each document: no bytes, no code points
            ids, widths, chars = (np.insert(c, ends[1:], x) for c, x in zip(columns, (eos, 0, 0), strict=True))
            size = np.diff(ends) + 1
            first = np.cumsum(size) - size
            place = np.arange(len(ids)) + np.repeat(batch.column("at").to_numpy(zero_copy_only=False).astype(np.int64) - first, size)
            start = np.zeros(len(ids), dtype=bool)
            start[first] = True
            start = np.flatnonzero(start | (place % length == 0))
            example = place[start] // length
            keep = example < windows
            stop = np.append(start[1:], len(ids))[keep]
            start, example = start[keep], example[keep]
            whole = ids[: stop[-1] if len(stop) else 0].astype(np.int32)  # windows rise with places, but documents need not stand in order
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(whole)).astype(np.int32)), pa.array(whole)) if len(start) and (stop[:-1] == start[1:]).all() else pa.array([ids[i:j].astype(np.int32) for i, j in zip(start.tolist(), stop.tolist(), strict=True)], pa.list_(pa.int32()))
            sums = [np.append(0, np.cumsum(c.astype(np.int64))) for c in (widths, chars)]
            yield pa.RecordBatch.from_arrays([pa.array(example), lists, *[pa.array(x[stop] - x[start]) for x in sums]], names=["example", "ids", "raw_bytes", "raw_chars"])

    return placed.mapInArrow(run, "example long, ids array<int>, raw_bytes long, raw_chars long")


def packed_examples(docs: DataFrame, length: int, bos: int, eos: int, path: str | None = None) -> tuple[DataFrame, int]:
    """(example, ids, raw_bytes, raw_chars of the labels of packed windows, in pieces that lie within
    a document; number of windows). Controls stand for no bytes. The stream's first token is bos, so
    label `at` is a document's first. Bytes as tokens stay text until they are cut."""
    if path is None:
        sized = docs.select("pos", F.coalesce("text", F.lit("")).alias("text")).withColumn("_n", F.octet_length("text").cast("long") + 1)

        def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            data, ends = utf8_bytes(batch.column("text"))
            last = (np.append(data[1:], 0)[: len(data)] & 0xC0) != 0x80
            return data.astype(np.int32), np.ones(len(data), dtype=np.int32), last.astype(np.int32), ends
    else:
        sized = durable(token_extents(docs, path).withColumn("_n", F.size("ids").cast("long") + 1), "extents")

        def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            size = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)
            return *[batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "widths", "chars")], np.append(0, np.cumsum(size))

    windows = int(sized.agg(F.sum("_n")).first()[0] or 0) // length
    placed = running_before(sized, "_n", ["pos"], out="at").drop("pos", "_n")
    return _pieces(placed, length, eos, windows, tokens, "text" if path is None else "ids"), windows


def times_drawn(spark, size: int, steps: int, batch: int, seed: int, mode: str = "portable") -> DataFrame:
    """example, times of all `size` examples."""
    if size < 1:
        raise ValueError("there are no examples")
    if mode == "exact":
        drawn = Counter(x for _, _, x in seeded_batches(size, steps, batch, seed))
        return spark.createDataFrame(sorted(drawn.items()), "example long, times long")
    full, rest = divmod(steps * batch, size)
    every = spark.range(size).select(F.col("id").alias("example"))
    if not rest:
        return every.select("example", F.lit(full).cast("long").alias("times"))
    keyed = durable(every.select("example", portable_key(seed, F.lit(full), F.col("example")).alias("_k"), F.lit(1).cast("long").alias("_one")), "permutation")
    ranked = running_before(keyed, "_one", ["_k", "example"], out="_rank")
    return ranked.select("example", (F.lit(full) + (F.col("_rank") < rest).cast("long")).cast("long").alias("times"))


def replay(examples: DataFrame, size: int, length: int, steps: int, batch: int, seed: int, mode: str = "portable") -> tuple[DataFrame, DataFrame]:
    """(token, count: the targets drawn; one row raw_chars, raw_bytes, target_tokens,
    padded_positions). examples: example, ids, raw_bytes, raw_chars, in any number of pieces."""
    times = times_drawn(examples.sparkSession, size, steps, batch, seed, mode)
    drawn = durable(examples.join(times, "example").where("times > 0"), "drawn")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "ids"):
            lists = batch.column("ids")
            weights = np.repeat(batch.column("times").to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            token, at = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            n = np.bincount(at, weights, len(token)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int32)), pa.array(n)], names=["token", "n"])

    counts = drawn.select("ids", "times").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("count"))
    total = lambda c, name: F.coalesce(F.sum(F.col("times") * c), F.lit(0)).cast("long").alias(name)
    seen = drawn.agg(total(F.col("raw_chars"), "raw_chars"), total(F.col("raw_bytes"), "raw_bytes"), total(F.size("ids"), "target_tokens"))
    return counts, seen.withColumn("padded_positions", F.lit(steps * batch * length).cast("long"))


def exposure_audit(recorded: dict[str, Any], replayed: DataFrame) -> DataFrame:
    """Audit rows: fields of a run's recorded exposure that its replay does not give."""
    got = replayed.first().asDict()
    bad = [("exposure", k, f"recorded {recorded.get(k)}, replayed {v}") for k, v in got.items() if recorded.get(k) != v]
    return replayed.sparkSession.createDataFrame(bad, AUDIT)
