"""Blocks of raw bytes and windows of tokens."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from loomtally.operators.ordered import running_before
from loomtally.operators.portions import PORTION_BYTES, portions
from loomtally.session import durable


def greedy_blocks(text: str, most: int) -> list[str]:
    """Pieces of at most `most` bytes (4 or more), each as long as it can be without
    cutting a code point. The cuts are found from the running byte count."""
    if most < 4:
        raise ValueError("a block must hold any code point")
    if len(text) == 0:
        return []
    if text.isascii():
        return [text[i : i + most] for i in range(0, len(text), most)]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
    out, start, base = [], 0, 0
    while start < len(text):
        stop = int(np.searchsorted(ends, base + most, side="right"))
        out.append(text[start:stop])
        start, base = stop, int(ends[stop - 1])
    return out


def raw_blocks(docs: DataFrame, most: int) -> DataFrame:
    """pos, block_pos, block. A fold over each text, so an Arrow stage; an empty text has none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            made = [greedy_blocks(t or "", most) for t in batch.column("text").to_pylist()]
            counts = [len(m) for m in made]
            places = np.concatenate([np.arange(c) for c in counts]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("pos").cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(made)), counts))), pa.array(places), pa.array([b for m in made for b in m], pa.string())], names=["pos", "block_pos", "block"])

    return docs.select("pos", "text").mapInArrow(cut, "pos long, block_pos long, block string")


def block_rollup(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """pos, blocks, characters, utf8_bytes, matches: blocks summed to their documents (0 for
    documents without), and whether the sums are the document's own."""
    sums = blocks.groupBy(F.col("pos").alias("_p")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("block")).alias("characters"), F.sum(F.octet_length("block")).alias("utf8_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    own = F.coalesce(F.length("text"), F.lit(0)).alias("_c"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("_b")
    return (
        docs.select("pos", *own)
        .join(sums, F.col("pos") == F.col("_p"), "left")
        .select("pos", zero("blocks"), zero("characters"), zero("utf8_bytes"), "_c", "_b")
        .withColumn("matches", (F.col("characters") == F.col("_c")) & (F.col("utf8_bytes") == F.col("_b")))
        .drop("_c", "_b")
    )


def chunk_windows(tokens: DataFrame, length: int, bos: int) -> DataFrame:
    """pos, win, inputs, labels: a document's targets cut every `length`; inputs are the
    targets shifted by one behind bos. Windows are cut within the row, so a document's
    tokens are not copied for each of them."""
    n = F.size("token_ids")
    first = lambda w: (w * length + 1).cast("int")
    # a window's inputs begin with the token before its first target
    inputs = lambda w: F.when(w == 0, F.concat(F.array(F.lit(bos)), F.slice("token_ids", 1, F.least(n, F.lit(length)) - 1))).otherwise(F.slice("token_ids", first(w) - 1, F.least(n - w * length, F.lit(length)).cast("int")))
    made = F.transform(F.sequence(F.lit(0), F.expr(f"(size(token_ids) - 1) div {length}").cast("int")), lambda w: F.struct(w.cast("long").alias("win"), inputs(w).alias("inputs"), F.slice("token_ids", first(w), length).alias("labels")))
    return tokens.where(n > 0).select("pos", F.explode(made).alias("w")).select("pos", "w.win", "w.inputs", "w.labels")


def rolling_windows(tokens: DataFrame, length: int, bos: int) -> DataFrame:
    """pos, win, inputs, label: one window for each target, with up to `length` inputs that
    end right before it; only the target is scored. A window is cut when its row is made: for
    windows as rows; what only reads them takes over_rolling."""
    i = F.col("win")
    inputs = F.when(i < length, F.concat(F.array(F.lit(bos)), F.slice("token_ids", 1, i))).otherwise(F.slice("token_ids", i - length + 1, length))
    return tokens.where(F.size("token_ids") > 0).select("pos", "token_ids", F.posexplode("token_ids").alias("win", "label")).select("pos", i.cast("long").alias("win"), inputs.alias("inputs"), "label")


@dataclass(frozen=True)
class RollingViews:
    """A document's rolling windows as views of one buffer of its tokens behind bos: window w holds
    buffer[starts[w]:ends[w]], and its target is labels[w]."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, length: int, bos: int) -> RollingViews:
        ends = np.arange(1, len(ids) + 1)
        return cls(np.concatenate([[bos], ids]).astype(np.int64), np.maximum(0, ends - length), ends)

    @property
    def labels(self) -> np.ndarray:
        return self.buffer[1:]

    def __len__(self) -> int:
        return len(self.ends)

    def inputs(self, first: int, end: int) -> list[np.ndarray]:
        """The inputs of some windows, not copied."""
        return [self.buffer[a:b] for a, b in zip(self.starts[first:end].tolist(), self.ends[first:end].tolist(), strict=True)]


def over_rolling(tokens: DataFrame, length: int, bos: int, make: Callable[[], Callable[[RollingViews], Sequence]], schema: str) -> DataFrame:
    """pos and what a function gives of each document's rolling windows (columns of schema). make()
    builds the function once in each task. Tokens come in Arrow batches and windows are views of
    them: none is copied, and none is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = make()
        for batch in portions(batches, "token_ids"):
            lists = batch.column("token_ids")
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(x or 0 for x in pc.list_value_length(lists).to_pylist())])
            rows = [fold(RollingViews.of(values[a:b], length, bos)) for a, b in itertools.pairwise(ends.tolist())]
            made = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("pos"), *[pa.array(list(c), to_arrow_type(k.dataType)) for c, k in zip(made, kinds, strict=True)]], names=["pos", *[k.name for k in kinds]])

    kinds = [k for k in StructType.fromDDL(schema).fields]
    return tokens.where(F.size("token_ids") > 0).select("pos", "token_ids").mapInArrow(run, f"pos {tokens.schema['pos'].dataType.simpleString()}, {schema}")


#: Kinds of number by width in bytes, in which ids are moved; the narrowest that holds a portion's is taken.
KINDS = {1: "<u1", 2: "<u2", 4: "<i4", 8: "<i8"}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pos, width, ids: token_ids as bytes of numbers of a width."""
    for batch in portions(batches, "token_ids"):
        lists = batch.column("token_ids")
        values, lengths = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
        width = next(w for w, k in KINDS.items() if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        ends = (np.append(0, np.cumsum(lengths, dtype=np.int64)) * width).astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(values.astype(KINDS[width]))])
        yield pa.RecordBatch.from_arrays([batch.column("pos"), pa.array(np.full(len(lists), width, np.int32)), ids], names=["pos", "width", "ids"])


def packed_stream(tokens: DataFrame, bos: int | None, eos: int | None) -> DataFrame:
    """at, n, width, ids: runs of the stream bos, then each document's tokens and eos, in order of
    pos, with the place of their first token; a control that is None is left out. ids are n
    numbers as bytes (KINDS), or n - 1 where eos follows. Places come from running sums of
    lengths, so no task holds the stream; ids are shuffled once, and rows lie in order of at
    but where ranges of pos meet."""
    packed = tokens.where("token_ids IS NOT NULL").select("pos", "token_ids").mapInArrow(_pack, f"pos {tokens.schema['pos'].dataType.simpleString()}, width int, ids binary")
    sized = durable(packed.withColumn("n", F.expr("octet_length(ids) div width") + int(eos is not None)), "stream")
    placed = running_before(sized.where("n > 0"), "n", ["pos"], out="_before").select((F.col("_before") + int(bos is not None)).alias("at"), "n", "width", "ids")
    if bos is not None:
        first = tokens.sparkSession.range(1).select(F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("n"), F.lit(8).alias("width"), F.lit(bytearray(np.int64(bos).tobytes())).alias("ids"))
        placed = first.unionByName(placed)
    return durable(placed, "placed-stream")


def _runs(batch: pa.RecordBatch, eos: int | None, kind: type) -> Iterator[tuple[int, np.ndarray]]:
    """(at, tokens with eos) of rows of a packed stream that follow each other."""
    at, n, width = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "width"))
    ids = batch.column("ids").cast(pa.large_binary())
    ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
    data = np.frombuffer(ids.buffers()[2] or b"", dtype=np.uint8)
    cuts = np.flatnonzero((at[1:] != at[:-1] + n[:-1]) | (width[1:] != width[:-1])) + 1
    for a, b in itertools.pairwise([0, *cuts.tolist(), len(at)]):
        values = data[ends[a] : ends[b]].view(KINDS[int(width[a])]).astype(kind)
        lengths = np.diff(ends[a : b + 1]) // width[a]
        closed = n[a:b] > lengths
        yield int(at[a]), np.insert(values, np.cumsum(lengths)[closed], eos) if closed.any() else values


def cut_stream(batches: Iterator[pa.RecordBatch], length: int, eos: int | None, kind: type, whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows (at, n, width, ids) of a packed stream cut at window borders: with whole win, inputs,
    labels of the windows that lie in rows that follow each other, else win, at, ids of the
    pieces of all other windows, two at most for rows that follow each other."""
    place, held, fresh = 0, np.zeros(0, kind), True  # fresh: the piece before the first border is still in held
    pieces: list[tuple[int, int, np.ndarray]] = []
    step = max(1, PORTION_BYTES // length)  # windows at a time

    def rest() -> None:
        if len(held):
            pieces.append((-(-place // length) - 1 if fresh else place // length, place, held))

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))

    def told() -> pa.RecordBatch:
        wins, places = (pa.array([p[i] for p in pieces], pa.int64()) for i in (0, 1))
        return pa.RecordBatch.from_arrays([wins, places, lists(np.concatenate([np.zeros(0, kind), *[p[2] for p in pieces]]), np.cumsum([0, *[len(p[2]) for p in pieces]]))], names=["win", "at", "ids"])

    for batch in portions(batches, "ids"):
        for at, values in _runs(batch, eos, kind):
            if at == place + len(held) and len(held):
                held = np.concatenate([held, values])
            else:
                rest()
                place, held, fresh = at, values, True
            # window w holds the places w L, ..., w L + L: the last is also the first of the next
            border = -(-place // length) * length
            if fresh and place + len(held) > border:
                if border:
                    pieces.append((border // length - 1, place, held[: border - place + 1]))
                place, held, fresh = border, held[border - place :], False
            if fresh:
                continue
            count = (len(held) - 1) // length
            for first in range(0, count if whole else 0, step):
                some = min(step, count - first)
                a, b, ends = first * length, (first + some) * length, np.arange(some + 1) * length
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(some, dtype=np.int64) + place // length + first), lists(held[a:b], ends), lists(held[a + 1 : b + 1], ends)], names=["win", "inputs", "labels"])
            place, held = place + count * length, held[count * length :].copy()
        if not whole and pieces:
            yield told()
        pieces.clear()
    rest()
    if not whole and pieces:
        yield told()


def _windows(stream: DataFrame, length: int, eos: int | None, element: str) -> DataFrame:
    """win, inputs, labels of all whole windows of a packed stream (durable); a window's labels are its
    inputs moved by one, and its last label is the next window's first input. Windows are cut where
    their tokens lie; only pieces at the ends of rows that follow each other are shuffled."""
    kind = np.int64 if element == "bigint" else np.int32
    made = stream.mapInArrow(lambda batches: cut_stream(batches, length, eos, kind, True), f"win long, inputs array<{element}>, labels array<{element}>")
    pieces = stream.mapInArrow(lambda batches: cut_stream(batches, length, eos, kind, False), f"win long, at long, ids array<{element}>")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"]))
    joined = pieces.groupBy("win").agg(ids.alias("_ids")).where(F.size("_ids") == length + 1)
    return made.unionByName(joined.select("win", F.slice("_ids", 1, length).alias("inputs"), F.slice("_ids", 2, length).alias("labels")))


def _element(tokens: DataFrame) -> str:
    return tokens.schema["token_ids"].dataType.elementType.simpleString()


def packed_windows(tokens: DataFrame, length: int, bos: int, eos: int) -> DataFrame:
    """win, inputs, labels of all floor((stream - 1) / length) windows of the packed stream."""
    return _windows(packed_stream(tokens, bos, eos), length, eos, _element(tokens))


def flat_windows(tokens: DataFrame, length: int, most: int | None = None) -> DataFrame:
    """win, inputs, labels over the documents' tokens one after another, without controls; of the
    first `most` tokens, where a budget is to be equal for two tokenizers."""
    stream = packed_stream(tokens, None, None)
    if most is not None:
        stream = stream.where(F.col("at") < most).withColumn("n", F.least("n", F.lit(most) - F.col("at")))
        stream = stream.withColumn("ids", F.substring("ids", F.lit(1), (F.col("n") * F.col("width")).cast("int")))
    return _windows(stream, length, None, _element(tokens))


def completed_characters(text: str, widths: list[int]) -> list[int]:
    """Code points completed by each token, whose byte widths in order make up the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
    used = np.cumsum(widths)
    if (int(used[-1]) if len(used) else 0) != (int(ends[-1]) if len(ends) else 0):
        raise ValueError("token widths don't add up to the text's bytes")
    return np.diff(np.searchsorted(ends, used, side="right"), prepend=0).tolist()


def seeded_batches(size: int, steps: int, batch: int, seed: int) -> list[tuple[int, int, int]]:
    """(step, slot, example): batches drawn from seeded permutations, a new one as soon as
    one is used up."""
    rng = np.random.default_rng(seed)
    order, at, out = rng.permutation(size), 0, []
    for step in range(steps):
        for slot in range(batch):
            out.append((step, slot, int(order[at])))
            at += 1
            if at == size:
                order, at = rng.permutation(size), 0
    return out
