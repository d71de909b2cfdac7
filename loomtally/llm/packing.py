"""Packing by Karmarkar-Karp multiway differencing.

A document's ids and an end id are cut into pieces: whole windows first, then the
rest in pieces of at most `piece` ids. Whole windows are sequences of their own.
The other pieces are dealt into batches by a hash (a batch holds about
`batch_windows` windows, however large the corpus), and each batch is packed alone:
every piece starts as a partial partition of k windows, one of them filled. The
two partitions with the greatest differences between their windows are merged,
the fullest window of the one with the emptiest of the other, until one is left.
Its windows are near equal. k starts at the least that could hold the batch and
rises whenever a window exceeds the capacity.

Defined results: a null or empty text is the end id alone; rows that repeat are
packed each; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.llm.encoders import encoder
from loomtally.session import durable

#: Sequence numbers: batch * 2**20 + window within it; the batches of whole windows come after them.
WINDOWS_PER_BATCH = 1 << 20
#: Documents whose texts and ids are held at a time.
SLICE = 1024


def cut_pieces(n: np.ndarray, window: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of n ids: whole windows, then the rest
    by `piece`."""
    whole, rest = np.divmod(n, window)
    count = whole + -(-rest // piece)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    loose = k - whole[doc]
    start = np.where(loose < 0, window * k, window * whole[doc] + piece * loose)
    return doc, start, np.minimum(np.where(loose < 0, window, piece), n[doc] - start)


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each piece, sum of each window) of the k windows that differencing gives.

    A partition is kept as its filled windows only, sorted by falling sum, each with a
    node of a binary forest whose leaves are pieces; its spread is the fullest
    window less the emptiest (0 while a window is empty).
    """
    n = len(sizes)
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    free = n
    heap = [(-int(s), i, np.array([s], dtype=np.int64), np.array([i])) for i, s in enumerate(sizes)]
    if k == 1:
        return np.zeros(n, dtype=np.int64), np.array([int(sizes.sum())])
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - k)  # windows filled by both: the emptiest of a against the fullest of b, turned round
        if over:
            pa, pb = slice(len(a) - over, len(a)), slice(len(b) - over, len(b))
            # all k windows of a in falling order meet those of b in rising order
            ids = np.arange(free, free + over)
            left[ids], right[ids] = an[pa], bn[pb][::-1]
            free += over
            sums = np.concatenate([a[: len(a) - over], a[pa] + b[pb][::-1], b[: len(b) - over]])
            nodes = np.concatenate([an[: len(a) - over], ids, bn[: len(b) - over]])
        else:
            sums, nodes = np.concatenate([a, b]), np.concatenate([an, bn])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        heapq.heappush(heap, (-spread, serial, sums, nodes))
        serial += 1
    _, _, sums, nodes = heap[0]
    window = np.full(2 * n, -1)
    window[nodes] = np.arange(len(nodes))
    for node in range(free - 1, n - 1, -1):  # parents come after their children
        window[left[node]] = window[right[node]] = window[node]
    return window[:n], sums


def pack_batch(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each piece, number of windows), none above the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = difference(sizes, k)
        if len(sums) == 0 or int(sums.max()) <= capacity:
            return window, len(sums)
        k += max(1, k // 1000)


def document_pieces(docs: DataFrame, path: str, window: int = 1024, piece: int = 256, end_id: int = 0, spaced: bool = True, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) for every piece."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, spaced), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            coded = [ids + end for ids in enc.encode(batch.column("text").to_pylist())]
            n = np.array([len(ids) // 4 for ids in coded], dtype=np.int64)
            doc, start, length = cut_pieces(n, window, piece)
            data, first = memoryview(b"".join(coded)), 4 * (np.cumsum(n) - n)[doc] + 4 * start
            spans = list(zip(first.tolist(), (first + 4 * length).tolist(), strict=True))
            columns = [batch.column("doc_id").take(pa.array(doc)), batch.column("_tie").take(pa.array(doc)), *map(pa.array, (start, length))]
            columns += [pa.array([zlib.crc32(data[a:b]) for a, b in spans], pa.int64()), pa.array(n[doc])]
            if with_ids:
                columns.append(pa.array([np.frombuffer(data[a:b], "<u4").astype(np.int64) for a, b in spans], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "_tie", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _tie long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<bigint>" * with_ids
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).mapInArrow(encode, schema)


def pack(docs: DataFrame, path: str, window: int = 1024, piece: int = 256, end_id: int = 0, spaced: bool = True, batch_windows: int = 384, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    pieces = durable(document_pieces(docs, path, window, piece, end_id, spaced, with_ids), "pack-pieces", batch_rows=SLICE)
    loose = pieces.where(F.col("length") < window)
    total = loose.agg(F.sum("length").alias("n")).first()["n"] or 0
    batches = max(1, round(total / (window * batch_windows)))
    salt = F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(batches)).cast("int")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "_tie", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        at, _ = pack_batch(pdf["length"].to_numpy(), window)
        pdf = pdf.assign(sequence_id=pdf["_batch"].to_numpy().astype(np.int64) * WINDOWS_PER_BATCH + at)
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns=["_batch"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    packed = loose.withColumn("_batch", salt).groupBy("_batch").applyInPandas(fill, f"{fields}, sequence_id long, offset long")
    # whole windows: numbered after the batches, by part of the table and place in it
    whole = pieces.where(F.col("length") >= window).withColumn("sequence_id", F.lit(batches * WINDOWS_PER_BATCH) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole).drop("_tie")
