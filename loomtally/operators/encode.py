"""Encoding by a distributed table of distinct pretokens.

A tokenizer's model sees one pretoken at a time, so equal pretokens have equal ids. Texts are
cut in Arrow batches and held by blocks of about `block_bytes`: a block lists its distinct
pretokens once, and its texts are numbers of that list. The distinct pretokens of all blocks
are encoded once each, and every block gets back the ids of its own list. What is shuffled
are blocks and distinct pretokens, never a row for each occurrence; a block bounds what a
task holds, and a frequent word is one row a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.operators.portions import portions
from loomtally.session import durable, release_memory

#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Bytes of written blocks that a task holds at a time.
GROUP_BYTES = 8 << 20


def load_tokenizer(path: str):
    """A file of the tokenizers library, in which special tokens' strings are ordinary text. Raises
    where other tokens are cut out of texts before its pretokens are."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    if any(not t.special for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("the vocabulary has added tokens that are not special")
    return tokenizer


def pretokens(tokenizer) -> Callable[[str], list[str]]:
    """What the model sees of a text, in order."""
    normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else lambda text: text
    if tokenizer.pre_tokenizer is None:
        return lambda text: [x] if (x := normalize(text)) else []
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    return lambda text: [piece for piece, _ in cut(normalize(text))]


def _blocks(docs: DataFrame, path: str, keep: list[str], block_bytes: int) -> DataFrame:
    """block, keep_... (the documents' columns), characters, utf8_bytes, sizes (pretokens of each),
    places (in words), words."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("pos", *keep)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, numbers = pretokens(load_tokenizer(path)), count(TaskContext.get().partitionId() << 32)
        columns: dict[str, list] = {c: [] for c in kinds}
        characters, utf8_bytes, sizes, places, words, held = [], [], [], [], {}, 0

        def flush() -> pa.RecordBatch:
            lists = {**{f"keep_{c}": pa.concat_arrays(x) for c, x in columns.items()}, "characters": pa.array(characters, pa.int64()), "utf8_bytes": pa.array(utf8_bytes, pa.int64()), "sizes": pa.array(sizes, pa.int32()), "places": pa.array(places, pa.int32()), "words": pa.array(list(words), pa.string())}
            one = {c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for c, x in lists.items()}
            return pa.RecordBatch.from_pydict({"block": pa.array([next(numbers)], pa.int64()), **one})

        for batch in portions(batches, "text"):
            first = 0
            for at, text in enumerate(batch.column("text").to_pylist()):
                found = cut(text) if text else []
                characters.append(len(text or ""))
                utf8_bytes.append(len((text or "").encode()))
                held += utf8_bytes[-1]
                sizes.append(len(found))
                places += [words.setdefault(w, len(words)) for w in found]
                if held >= block_bytes:
                    for c in kinds:
                        columns[c].append(batch.column(c).slice(first, at + 1 - first))
                    yield flush()
                    columns, first = {c: [] for c in kinds}, at + 1
                    characters, utf8_bytes, sizes, places, words, held = [], [], [], [], {}, 0
            for c in kinds:
                columns[c].append(batch.column(c).slice(first))
        if sizes:
            yield flush()

    lists = ", ".join(f"`keep_{c}` array<{k}>" for c, k in kinds.items())
    return docs.select(*kinds, "text").mapInArrow(run, f"block long, {lists}, characters array<long>, utf8_bytes array<long>, sizes array<int>, places array<int>, words array<string>")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """word, ids of each row of words (word): one call of the model for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_tokenizer(path).model
        for batch in batches:
            ids = [[t.id for t in model.tokenize(w)] for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def encoded_once(docs: DataFrame, path: str, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """pos, keep, characters, utf8_bytes, token_ids of every document (pos, text), as the library
    encodes its text without special tokens; a null text is empty. Raises where a text that is
    not empty has no tokens."""
    keep = list(keep)
    blocks = durable(_blocks(docs, path, keep, block_bytes), "pretokens", group_bytes=GROUP_BYTES)
    table = encode_words(blocks.select(F.explode("words").alias("word")).distinct(), path)
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("place", "word"))
    told = asked.join(table, "word").select("of", "place", "ids")

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        column = lambda c: left.column(c).combine_chunks().flatten()
        order = pc.sort_indices(right.column("place"))
        lists = right.column("ids").combine_chunks().take(order)
        flat, length = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(length) - length
        places, sizes = column("places").to_numpy(zero_copy_only=False), column("sizes").to_numpy(zero_copy_only=False)
        each = length[places]
        at = np.repeat(start[places] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])]
        if ((np.diff(ends) == 0) & (column("utf8_bytes").to_numpy(zero_copy_only=False) > 0)).any():
            raise ValueError("a text that is not empty has no tokens")
        ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[at].astype(np.int32) if len(at) else np.zeros(0, dtype=np.int32)))
        release_memory()
        return pa.table({**{c: column(f"keep_{c}") for c in ("pos", *keep)}, **{c: column(c) for c in ("characters", "utf8_bytes")}, "token_ids": ids})

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in ("pos", *keep))
    held = blocks.drop("words")
    return held.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(put_together, f"{fields}characters long, utf8_bytes long, token_ids array<int>")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """pos, decoded: the text of each document's token_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        for batch in portions(batches, "token_ids"):
            texts = tokenizer.decode_batch([x or [] for x in batch.column("token_ids").to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("pos"), pa.array(texts, pa.string())], names=["pos", "decoded"])

    return encoded.select("pos", "token_ids").mapInArrow(run, f"pos {encoded.schema['pos'].dataType.simpleString()}, decoded string")
