"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last 7 bytes ends a chunk wherever it leaves remainder
b-1 by the block size b. b is 3 times a power of two, the least with 64 b >= bytes,
halved while fewer than 32 chunks result. A chunk's signature is 12 bits of a
polynomial hash of its bytes (two characters); a fingerprint is
`b:signature at b:signature at 2b`. Two fingerprints are compared where their
block sizes are equal or one is twice the other: likeness = 1 - d / (n + m), d the
edit distance (insert and delete 1, replace 2) between n and m chunks.

The rolling hash and the chunk hashes are windowed and running sums over the whole
text at once. Defined results: null is the empty text; equal texts have equal
fingerprints (likeness 1, also of two empty texts); an empty text is 0 like any
other text; block sizes that don't fit: 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.operators.ordered import range_bounds, range_of, ranges_of_bytes

WINDOW, CHUNKS, LEAST = 7, 64, 3
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0], _powers[1]


def rolling(data: np.ndarray) -> np.ndarray:
    """Rolling hash after each byte: sum, weighted sum and shifted exclusive-or of the last 7 bytes."""
    n = len(data)
    padded = np.zeros(n + WINDOW - 1, dtype=np.uint32)
    padded[WINDOW - 1 :] = data
    plain, weighted, shifted = (np.zeros(n, dtype=np.uint32) for _ in range(3))
    for back in range(WINDOW):
        x = padded[WINDOW - 1 - back : WINDOW - 1 - back + n]
        plain += x
        weighted += x * np.uint32(WINDOW - back)
        shifted ^= x << np.uint32(5 * back)
    return plain + weighted + shifted


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = len(data)
    if n == 0:
        return f"{LEAST}::"
    ahead = rolling(data).astype(np.uint64) + np.uint64(1)
    ends = np.nonzero(ahead % np.uint64(LEAST) == 0)[0]  # remainder b-1 at every b: ahead is a multiple of 3 and of the power of two
    twos = ahead[ends] // np.uint64(LEAST)
    power, inverse = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])

    def signature(level: int) -> str:
        last = ends[(twos & np.uint64((1 << level) - 1)) == 0] + 1
        last = last[: CHUNKS - 1]
        if not len(last) or last[-1] < n:
            last = np.append(last, n)  # the rest is one chunk
        first = np.concatenate([[0], last[:-1]])
        upto = np.concatenate([np.zeros(1, dtype=np.uint64), sums])
        with np.errstate(over="ignore"):
            h = (upto[last] - upto[first]) * inverse[first]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return "".join([SYMBOLS[x >> 6] + SYMBOLS[x & 63] for x in (h >> np.uint64(52)).tolist()])

    level = 0
    while (LEAST << level) * CHUNKS < n:
        level += 1
    at = signature(level)
    while level and len(at) < CHUNKS:  # two characters a chunk: under 32 chunks
        level -= 1
        at = signature(level)
    return f"{LEAST << level}:{at}:{signature(level + 1)}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each place of a."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _score(a: str, b: str) -> float:
    x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    return 2 * _common(x, y) / (len(x) + len(y)) if x and y else 0.0


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    if a == b:
        return 1.0
    (p, a1, a2), (q, b1, b2) = a.split(":"), b.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_score(a1, b1), _score(a2, b2))
    if p == 2 * q:
        return _score(a1, b2)
    return _score(a2, b1) if q == 2 * p else 0.0


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of `following`."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text dealt to ranges of doc_id and sorted there, each range followed by
    the first row of the next one (the last by the first of all) with _ahead = 1, so
    that every document meets its successor in one task and texts move once.
    Rows of equal id are ordered by a hash of their texts. A range holds about 16 MB of text."""
    n = ranges or ranges_of_bytes(docs, "text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    bounds = range_bounds(rows, "doc_id", n)
    dealt = rows.withColumn("_range", range_of(F.col("doc_id"), bounds))
    firsts = dealt.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "_tie")).alias("f")).orderBy("_range").collect()  # a row for each range
    before = [(int(r["f"]["doc_id"]) if r["f"]["doc_id"] is not None else None, r["f"]["_tie"], firsts[i - 1]["_range"]) for i, r in enumerate(firsts)]
    ahead = docs.sparkSession.createDataFrame(before, "_fd long, _ft long, _before int")
    return (
        dealt.join(F.broadcast(ahead), F.col("doc_id").eqNullSafe(F.col("_fd")) & (F.col("_tie") == F.col("_ft")), "left")
        .withColumn("_p", F.explode(F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("ahead")))).otherwise(F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("ahead")), F.struct(F.col("_before").alias("range"), F.lit(1).alias("ahead"))))))
        .select(F.col("_p.range").alias("_range"), F.col("_p.ahead").alias("_ahead"), "doc_id", "_tie", "text")
        .repartitionById(len(bounds) + 1, "_range")
        .sortWithinPartitions("_range", "_ahead", F.col("doc_id").asc_nulls_first(), "_tie")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the document that waits for its successor: range, id, text, fingerprint
        for batch in batches:
            out = []
            for at, ahead, doc, text in zip(batch["_range"].tolist(), batch["_ahead"].tolist(), batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                if ahead and (held is None or held[0] != at):
                    continue  # a second copy of the row after the range
                own = fingerprint(text)
                if held is not None:
                    _, before, old, was = held
                    new = edited(old, text)
                    changed = fingerprint(new)
                    out.append((before, len(old), hashlib.sha256(new.encode()).hexdigest(), was, changed, likeness(was, changed), likeness(was, own)))
                held = None if ahead else (at, doc, text, own)
            if out:  # a frame without rows has no string type
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInPandas(compare, schema)
