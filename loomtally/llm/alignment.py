"""Alignment of two tokenizers over the same bytes.

Each byte of a text has an owner in A and one in B (token numbers repeated over their
bytes). Where the pair of owners changes, a new overlap of two tokens begins; where both
change at once, both tokens end: a cut. The tokens between two cuts are a group, and all
A-B pairs of occurrences in a group are links.

Counting links over a corpus: documents are taken in blocks of about `block_bytes` of
text, and a block tells each of its distinct id pairs once, with the number of its
documents that hold it. Those are summed over the corpus, the highest count of each A id
is found (one row an A id, which its vocabulary bounds), and each block gets the counts of
its pairs back. So what is shuffled grows with the distinct pairs of blocks, not with
links, and no document, pair or id is a group of rows in one task.

A is a byte-level file of the tokenizers library, B a merge-type sentencepiece model. B
puts a space in front of a text, A gets one, so that both stand for the same bytes.

Defined results: a text that is null or empty, or whose tokens of A or of B do not join to
its bytes (one with U+2581, which B takes for a space), has no tokens: zeros, no groups
and ''. Special tokens' strings are plain text. Rows that repeat are documents each, ids
may be null, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.llm import encoders, pieces
from loomtally.session import durable
from loomtally.sources.tables import spread

#: Bytes of text whose bytes' owners are held at a time.
SLICE_BYTES = 1 << 20
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Links of a group from which on its distinct ids are paired, not its occurrences.
CROWD = 4096


def owners(lengths: np.ndarray) -> np.ndarray:
    """The number of the token that each byte belongs to."""
    return np.repeat(np.arange(len(lengths)), lengths)


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token and B token of each overlap, group of each A token, group of each B token), by
    the tokens' byte lengths, all above 0 and of equal sums."""
    of_a, of_b = owners(a), owners(b)
    new_a, new_b = np.diff(of_a, prepend=-1) != 0, np.diff(of_b, prepend=-1) != 0
    group = np.cumsum(new_a & new_b) - 1
    seen = np.flatnonzero(new_a | new_b)
    return of_a[seen], of_b[seen], group[np.flatnonzero(new_a)], group[np.flatnonzero(new_b)]


class Vocabulary:
    """The bytes that each id stands for, as one array with their places."""

    def __init__(self, entries: list[bytes]):
        self.size = len(entries)
        self.lengths = np.array([len(e) for e in entries], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        first = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(self.starts[ids] - first, lengths) + np.arange(lengths.sum())]


@dataclass
class Aligned:
    """Documents aligned together. ids and groups of both sides' tokens, document of each group;
    sizes of the groups on both sides; overlaps of each document."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    doc_of: np.ndarray
    size_a: np.ndarray
    size_b: np.ndarray
    overlaps: np.ndarray
    docs: int

    @property
    def first_a(self) -> np.ndarray:
        return np.cumsum(self.size_a) - self.size_a

    @property
    def first_b(self) -> np.ndarray:
        return np.cumsum(self.size_b) - self.size_b

    def per_doc(self, weights: np.ndarray | None = None) -> np.ndarray:
        """Groups of each document, or the sum of weights over them."""
        return np.bincount(self.doc_of, weights, self.docs).astype(np.int64)


class Aligner:
    """The two tokenizers of a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoders.encoder(path_a, True), pieces.model(path_b)
        byte_of = {letter: value for value, letter in encoders.byte_letters().items()}
        tokens = [self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.tokenizer.get_vocab_size())]
        self.words_a = Vocabulary([bytes(byte_of.get(c, 63) for c in t) for t in tokens])
        self.words_b = Vocabulary(self.b.surface)
        self.pairs = self.words_a.size * self.words_b.size
        #: ids with the mark behind them: within a side's group, and at its end
        self.written = [f"{i}{mark}" for size, marks in ((self.words_a.size, ",|"), (self.words_b.size, ",;")) for mark in marks for i in range(size)]

    def align(self, texts: list[str | None]) -> Aligned:
        raw = [(" " + t).encode() if t else b"" for t in texts]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        coded_a = [x if r else b"" for x, r in zip(self.a.encode(texts, lead=True), raw, strict=True)]
        coded_b = [self.b.encode(t) for t in texts]
        good = size > 0
        for coded, words in ((coded_a, self.words_a), (coded_b, self.words_b)):
            ids = np.frombuffer(b"".join(coded), "<i4")
            doc = np.repeat(np.arange(len(texts)), [len(c) // 4 for c in coded])
            good &= np.bincount(doc, words.lengths[ids], len(texts)).astype(np.int64) == size
        for coded, words in ((coded_a, self.words_a), (coded_b, self.words_b)):
            ids = np.frombuffer(b"".join([c for c, g in zip(coded, good, strict=True) if g]), "<i4")
            other = np.flatnonzero(words.joined(ids) != np.frombuffer(b"".join([r for r, g in zip(raw, good, strict=True) if g]), np.uint8))
            at = np.flatnonzero(good)
            good[at[np.unique(np.searchsorted(np.cumsum(size[at]), other, side="right"))]] = False
        kept = np.flatnonzero(good)
        ids_a, ids_b = (np.frombuffer(b"".join([c[i] for i in kept]), "<i4") for c in (coded_a, coded_b))
        from_a, _, group_a, group_b = align(self.words_a.lengths[ids_a], self.words_b.lengths[ids_b])
        doc_a = np.repeat(kept, [len(coded_a[i]) // 4 for i in kept])
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        doc_of = doc_a[np.cumsum(size_a) - size_a]
        return Aligned(ids_a, ids_b, group_a, group_b, doc_of, size_a, size_b, np.bincount(doc_a[from_a], minlength=len(texts)), len(texts))

    def linked(self, x: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """(document * pairs + id pair, number of links), one for each distinct id pair of a
        document, in ascending order. An id pair is A id * size of B's vocabulary + B id."""
        crowd = x.size_a * x.size_b > CROWD
        some = np.where(crowd, 0, x.size_b)[x.group_a]  # B tokens of an A token's group
        a = np.repeat(np.arange(len(x.ids_a)), some)
        b = np.arange(len(a)) + np.repeat(x.first_b[x.group_a] - (np.cumsum(some) - some), some)
        keys = x.doc_of[x.group_a[a]] * self.pairs + x.ids_a[a].astype(np.int64) * self.words_b.size + x.ids_b[b]
        if not crowd.any():
            return np.unique(keys, return_counts=True)
        all_keys, all_links = [keys], [np.ones(len(keys), dtype=np.int64)]
        for g in np.flatnonzero(crowd):
            ids_a, n_a = np.unique(x.ids_a[x.first_a[g] : x.first_a[g] + x.size_a[g]], return_counts=True)
            ids_b, n_b = np.unique(x.ids_b[x.first_b[g] : x.first_b[g] + x.size_b[g]], return_counts=True)
            all_keys.append((x.doc_of[g] * self.pairs + ids_a.astype(np.int64)[:, None] * self.words_b.size + ids_b).ravel())
            all_links.append(np.outer(n_a, n_b).ravel())
        distinct, place = np.unique(np.concatenate(all_keys), return_inverse=True)
        return distinct, np.bincount(place, np.concatenate(all_links)).astype(np.int64)

    def groups(self, x: Aligned) -> list[str]:
        """Each document's groups as `a1,a2|b1;a3|b2,b3`: decimal ids in order."""
        last_a = np.arange(len(x.ids_a)) == (x.first_a + x.size_a - 1)[x.group_a]
        last_b = np.arange(len(x.ids_b)) == (x.first_b + x.size_b - 1)[x.group_b]
        order = np.empty(len(x.ids_a) + len(x.ids_b), dtype=np.int64)
        order[np.arange(len(x.ids_a)) + x.first_b[x.group_a]] = x.ids_a + last_a * self.words_a.size
        order[np.arange(len(x.ids_b)) + (x.first_a + x.size_a)[x.group_b]] = x.ids_b + 2 * self.words_a.size + last_b * self.words_b.size
        ends = np.cumsum(x.per_doc(x.size_a + x.size_b))
        return ["".join(map(self.written.__getitem__, order[s:e].tolist()))[:-1] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for two files; kept between tasks that reuse the worker."""
    return encoders.held((path_a, path_b), lambda: Aligner(path_a, path_b))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(ids of documents, texts) of about SLICE_BYTES each."""
    for batch in batches:
        texts = batch.column("text")
        for first, end in pieces.slices([x or 0 for x in pc.binary_length(texts).to_pylist()], SLICE_BYTES):
            yield batch.column("doc_id").slice(first, end - first), texts.slice(first, end - first).to_pylist()


def align_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, group_no, start, length (bytes of the space and the text), ids_a, ids_b: a row a group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for ids, texts in _slices(batches):
            x = both.align(texts)
            length = np.bincount(x.group_a, both.words_a.lengths[x.ids_a], len(x.doc_of)).astype(np.int64)
            number = np.arange(len(x.doc_of)) - (np.cumsum(x.per_doc()) - x.per_doc())[x.doc_of]
            ahead = np.cumsum(length) - length
            start = ahead - (ahead[np.flatnonzero(number == 0)])[np.cumsum(number == 0) - 1] if len(ahead) else ahead
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(i)) for n, i in ((x.size_a, x.ids_a), (x.size_b, x.ids_b))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x.doc_of)), pa.array(number), pa.array(start), pa.array(length), *lists], names=["doc_id", "group_no", "start", "length", "ids_a", "ids_b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, group_no long, start long, length long, ids_a array<int>, ids_b array<int>")


_PER_DOC = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


def _blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int, digest: bool) -> DataFrame:
    """A row a block: its documents' columns as lists, its distinct pairs with the number of
    their documents, and for each document the places of its pairs and their links."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        serial, held, ids, per_doc, written, entries, pairs, links = TaskContext.get().partitionId() << 32, 0, [], [], [], [], [], []

        def flush() -> pa.RecordBatch:
            distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
            one = lambda values: pa.array([values])
            stats = np.concatenate(per_doc, axis=1)
            columns = {"block": one(serial), "doc_ids": pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids))}
            columns |= {name: one(stats[i]) for i, name in enumerate(_PER_DOC)}
            columns |= {"groups": one(written), "entries": one(np.concatenate(entries)), "pairs": one(distinct), "docs": one(np.bincount(place, minlength=len(distinct)))}
            # a document's places ascend: their steps are small numbers
            packed = np.concatenate([np.diff(place, prepend=0), np.concatenate(links)]).astype("<i4").tobytes()
            columns |= {"size": one(len(packed)), "packed": pa.array([pa.compress(packed, codec="zstd", asbytes=True)], pa.binary())}
            return pa.RecordBatch.from_pydict(columns)

        for doc_ids, texts in _slices(batches):
            x = both.align(texts)
            keys, n = both.linked(x)
            ids.append(doc_ids)
            per_doc.append(np.stack([x.per_doc(x.size_a), x.per_doc(x.size_b), x.per_doc(), x.per_doc(x.size_a * x.size_b), x.overlaps]))
            whole = both.groups(x)
            written += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in whole] if digest else whole
            entries.append(np.bincount(keys // both.pairs, minlength=len(texts)))
            pairs.append(keys % both.pairs)
            links.append(n)
            held += sum(len(t) for t in texts if t)
            if held >= block_bytes:
                yield flush()
                serial, held, ids, per_doc, written, entries, pairs, links = serial + 1, 0, [], [], [], [], [], []
        if ids:
            yield flush()

    lists = ", ".join(f"{name} array<long>" for name in _PER_DOC)
    return docs.mapInArrow(make, f"block long, doc_ids array<{kind}>, {lists}, groups array<string>, entries array<long>, pairs array<long>, docs array<long>, size long, packed binary")


def pair_counts(blocks: DataFrame, ids_b: int) -> DataFrame:
    """pair, count (documents that hold it linked), best (no pair of its A id has more)."""
    told = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.docs").alias("n"))
    counts = durable(told.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    a = F.expr(f"pair div {ids_b}")
    highest = counts.groupBy(a.alias("_a")).agg(F.max("count").alias("_most"))  # one row an id of A's vocabulary
    return counts.join(F.broadcast(highest), a == F.col("_a")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def link_documents(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups, n_best, count_sum of every row of
    docs (doc_id, text). groups: as text `a1,a2|b1;a3|b2,b3`, or with digest as its SHA-256 in
    hexadecimal ('' where there is none). n_best: links whose id pair's count of documents is the
    highest of its A id; count_sum: the counts of its links together."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = durable(_blocks(spread(docs.select("doc_id", "text")), path_a, path_b, block_bytes, digest), "link-blocks")
    counts = pair_counts(blocks, pieces.model(path_b).library.get_piece_size())
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(counts, "pair").select("of", "place", "count", "best")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()[0]
        count = np.zeros(right.num_rows, dtype=np.int64)
        best = np.zeros(right.num_rows, dtype=bool)
        place = right.column("place").to_numpy()
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
        steps, links = np.frombuffer(pa.decompress(block["packed"], decompressed_size=block["size"], codec="zstd", asbytes=True), "<i4").reshape(2, -1).astype(np.int64)
        at = np.cumsum(steps)
        doc = np.repeat(np.arange(len(block["doc_ids"])), block["entries"])
        total = lambda weights: np.bincount(doc, weights, len(block["doc_ids"])).astype(np.int64)
        out = {"doc_id": left.column("doc_ids").combine_chunks().flatten()} | {name: block[name] for name in (*_PER_DOC, "groups")}
        return pa.table(out | {"n_best": total(links * best[at]), "count_sum": total(links * count[at])})

    columns = ", ".join(f"{name} long" for name in _PER_DOC)
    kept = blocks.select("block", "doc_ids", *_PER_DOC, "groups", "entries", "size", "packed")
    return kept.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(add_up, f"doc_id {kind}, {columns}, groups string, n_best long, count_sum long")
