"""Token ids as compressed binary files with a shared zstandard dictionary.

Layout of a store (a folder): `dictionary/` holds the dictionary, its SHA-256 and
the width of an id in bytes; `blocks/` holds Parquet rows (shard, block,
dictionary_sha256, doc_ids, offsets, n_tokens, data). data is one frame for each
document, one after another, each compressed alone with the dictionary; offsets has
one place more than documents. The index columns can be read without data, and a
document is read by decompressing its frame only. Shards are ranges of doc_id in
ascending order, blocks follow each other within a shard.

The dictionary is trained on serialized id arrays of a bounded sample
(`sample_docs` documents by the least hash of id and text, `sample_bytes` at most), of
which only rows below a hash bound leave their tasks; it alters sizes only, never
contents. Ranges hold about 16 MB of text, however large the corpus.

Defined results: a null or empty text is the end id alone; rows of equal doc_id
are kept each, ordered by a hash of their texts; null ids come first; an empty
table gives an empty store that reads back empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtally.llm.encoders import encoder
from loomtally.operators.ordered import range_bounds, range_of, ranges_of_bytes

BLOCK_BYTES = 1 << 20
_EMPTY = "shard int, block long, dictionary_sha256 string, doc_ids array<bigint>, offsets array<int>, n_tokens array<int>, data binary"


def train_dictionary(docs: DataFrame, path: str, spaced: bool, end_id: int, width: int, sample_docs: int, sample_bytes: int, size: int) -> bytes:
    """The shared dictionary, trained in one task on the bounded sample."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        samples, total = [], 0
        for batch in batches:
            for ids in encoder(path, spaced).encode(batch["text"].tolist()):
                data = np.append(np.frombuffer(ids, "<u4"), end_id).astype(f"<u{width}").tobytes()
                if total + len(data) <= sample_bytes:
                    samples.append(data)
                    total += len(data)
        try:
            made = zstandard.train_dictionary(size, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few or too small samples for its statistics: their contents serve
            made = b"".join(samples)[:size]
        yield pd.DataFrame({"dictionary": [made]})

    n, rank = docs.count(), F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    bound = min((1 << 63) - 1, 4 * sample_docs * ((1 << 63) // max(1, n)))  # about four samples pass
    sample = docs.where(rank <= bound).orderBy(rank).limit(sample_docs).select("text")
    rows = sample.coalesce(1).mapInPandas(train, "dictionary binary").collect()
    return b"".join(bytes(r["dictionary"]) for r in rows)


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(
    docs: DataFrame, out: str, path: str, spaced: bool = False, end_id: int = 2, sample_docs: int = 1024, sample_bytes: int = 16 << 20, dictionary_bytes: int = 64 << 10, level: int = 3
) -> None:
    """Encode every text, append end_id and write the store `out`."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    width = 2 if max(encoder(path, spaced).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    trained = train_dictionary(rows, path, spaced, end_id, width, sample_docs, sample_bytes, dictionary_bytes)
    digest = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(bytearray(trained), digest, width)], "dictionary binary, sha256 string, width int").coalesce(1).write.parquet(f"{out}/dictionary")
    shared = spark.sparkContext.broadcast(trained)  # of at most dictionary_bytes

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        enc, end = encoder(path, spaced), np.array([end_id], dtype="<u4").tobytes()
        made = _dictionary(shared.value)
        zstd = zstandard.ZstdCompressor(level=level, dict_data=made) if made else zstandard.ZstdCompressor(level=level)
        for batch in batches:
            ids = [i + end for i in enc.encode(batch["text"].tolist())]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "_tie": batch["_tie"],
                    "n": np.array([len(i) // 4 for i in ids], dtype=np.int32),
                    "frame": [zstd.compress(np.frombuffer(i, "<u4").astype(f"<u{width}").tobytes()) for i in ids],
                }
            )

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, block, ids, offsets, counts, data = None, 0, [], [0], [], []

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"shard": [shard], "block": [block], "dictionary_sha256": [digest], "doc_ids": [ids], "offsets": [offsets], "n_tokens": [counts], "data": [b"".join(data)]})

        for batch in batches:
            for s, doc, n, frame in zip(batch["shard"].tolist(), batch["doc_id"].tolist(), batch["n"].tolist(), batch["frame"].tolist(), strict=True):
                if ids and (s != shard or offsets[-1] >= BLOCK_BYTES):
                    yield flush()
                    block, ids, offsets, counts, data = (block + 1 if s == shard else 0), [], [0], [], []
                elif s != shard:
                    block = 0
                shard = s
                ids.append(None if doc is None or doc != doc else int(doc))
                counts.append(n)
                data.append(frame)
                offsets.append(offsets[-1] + len(frame))
        if ids:
            yield flush()

    bounds = range_bounds(rows, "doc_id", ranges_of_bytes(rows, "text"))
    frames = rows.withColumn("_tie", F.xxhash64("text")).mapInPandas(compress, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _tie long, n int, frame binary")
    dealt = frames.withColumn("shard", range_of(F.col("doc_id"), bounds)).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "_tie")
    dealt.select("shard", "doc_id", "n", "frame").mapInPandas(assemble, _EMPTY).write.parquet(f"{out}/blocks")


def block_starts(blocks: DataFrame) -> DataFrame:
    """shard, block and the ids of all documents before the block, from the index alone."""
    sums = blocks.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("_n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = sums.groupBy("shard").agg(F.sum("_n").alias("_s")).select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.withColumn("_inside", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return inside.join(per_shard, F.col("shard") == F.col("_shard")).select("shard", "block", (F.col("_base") + F.col("_inside")).alias("first"))


def read_tokens(spark: SparkSession, store: str, with_ids: bool = False, only: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids), from the files. only: read these
    documents' frames alone (short-document access through the offset index)."""
    meta = spark.read.parquet(f"{store}/dictionary").first()
    trained, digest, width = bytes(meta["dictionary"]), meta["sha256"], meta["width"]
    if hashlib.sha256(trained).hexdigest() != digest:
        raise ValueError("the dictionary does not match its hash")
    shared = spark.sparkContext.broadcast(trained)
    blocks = spark.read.schema(_EMPTY).parquet(f"{store}/blocks")
    starts = block_starts(blocks)
    wanted = None if only is None else set(only)
    if wanted is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(x)).cast("long") for x in wanted])))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        made = _dictionary(shared.value)
        zstd = zstandard.ZstdDecompressor(dict_data=made) if made else zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.dictionary_sha256 != digest:
                    raise ValueError(f"shard {row.shard} block {row.block} was written with another dictionary")
                at, rows = 0, []
                for k, (doc, n) in enumerate(zip(row.doc_ids, row.n_tokens, strict=True)):
                    if wanted is None or doc in wanted:
                        ids = np.frombuffer(zstd.decompress(row.data[row.offsets[k] : row.offsets[k + 1]]), f"<u{width}").astype("<u4")
                        if len(ids) != n:
                            raise ValueError(f"document {doc}: {len(ids)} ids instead of {n}")
                        rows.append((doc, row.shard, row.block, at, int(n), zlib.crc32(ids.tobytes())) + ((ids.astype(np.int64),) if with_ids else ()))
                    at += int(n)
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "shard", "block", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids).astype({"doc_id": "Int64"})

    schema = "doc_id long, shard int, block long, at long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    documents = blocks.mapInPandas(expand, schema)
    return documents.join(starts, ["shard", "block"]).select("doc_id", (F.col("at") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
