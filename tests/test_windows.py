"""Windows cut where a stream's rows lie, against slices of the whole stream."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from loomtally.operators import blocks
from loomtally.operators.score import byte_documents

EOS = 70_000


def batch(rows):
    """A batch of (at, tokens, whether eos follows) as rows of a packed stream."""
    made = {"at": [], "n": [], "width": [], "ids": []}
    for at, tokens, closed in rows:
        width = next(w for w, k in blocks.KINDS.items() if all(np.iinfo(k).min <= t <= np.iinfo(k).max for t in tokens))
        for name, x in zip(made, (at, len(tokens) + closed, width, np.array(tokens, blocks.KINDS[width]).tobytes())):
            made[name].append(x)
    return pa.RecordBatch.from_arrays([pa.array(made["at"], pa.int64()), pa.array(made["n"], pa.int64()), pa.array(made["width"], pa.int32()), pa.array(made["ids"], pa.binary())], names=list(made))


def cut(parts, length, whole):
    """Rows of all tasks; a part is the batches of a task."""
    return [r for part in parts for b in blocks.cut_stream(iter(part), length, EOS, np.int32, whole) for r in b.to_pylist()]


@pytest.mark.parametrize("seed", range(30))
def test_windows_of_any_order_of_rows(seed):
    rng = random.Random(seed)
    length, rows, stream = rng.choice([1, 2, 5, 8]), [], []
    for _ in range(rng.randrange(1, 30)):
        tokens, closed = [rng.choice([0, 255, 300, 65_536, -1]) for _ in range(rng.choice([0, 1, 2, 9, 40]))], rng.random() < 0.7
        if tokens or closed:
            rows.append((len(stream), tokens, closed))
            stream += [*tokens, *([EOS] if closed else [])]
    if seed % 3 == 0:
        rng.shuffle(rows)
    parts, each = [], rng.choice([1, 3, 50])
    for i in range(0, len(rows), each):
        parts.append([batch(rows[i : i + each][j : j + 2]) for j in range(0, len(rows[i : i + each]), 2)])
    got = {r["win"]: (r["inputs"], r["labels"]) for r in cut(parts, length, True)}
    pieces = {}
    for r in cut(parts, length, False):
        pieces.setdefault(r["win"], []).append((r["at"], r["ids"]))
    for win, found in pieces.items():
        ids = [t for _, p in sorted(found) for t in p]
        if len(ids) == length + 1:
            assert win not in got
            got[win] = ids[:-1], ids[1:]
    assert got == {w: (stream[w * length : (w + 1) * length], stream[w * length + 1 : (w + 1) * length + 1]) for w in range((len(stream) - 1) // length)}


def test_rows_that_follow_each_other_leave_two_pieces():
    rows = [(1000 * i + 3, [i % 256] * 999, True) for i in range(50)]
    part = [batch(rows[:7]), batch(rows[7:])]
    assert len(cut([part], 128, False)) == 2
    assert len(cut([part], 128, True)) == (50_002 // 128) - 1


def test_few_tokens_are_shuffled_by_window(spark):
    texts = [f"document {i} " * 200 for i in range(200)]
    docs = byte_documents(spark.createDataFrame(list(enumerate(texts)), "pos long, text string"))
    total = sum(len(t) + 1 for t in texts) + 1
    stream = blocks.packed_stream(docs, 256, 258)
    pieces = stream.mapInArrow(lambda b: blocks.cut_stream(b, 16, 258, np.int32, False), "win long, at long, ids array<int>")
    assert sum(len(r["ids"]) for r in pieces.collect()) < total / 100
    wins = [r["win"] for r in blocks.packed_windows(docs, 16, 256, 258).collect()]
    assert sorted(wins) == list(range((total - 1) // 16))
