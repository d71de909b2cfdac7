"""Stages hold what they make of a portion, not of an Arrow batch."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from loomtally.operators import encode, exposure, score
from loomtally.operators.portions import portions
from loomtally.plans.experiments import _halves


class Measured:
    """A frame whose Arrow stage runs here, over one batch of all rows; peak: the MB it held at most."""

    def __init__(self, frame):
        self.frame, self.schema, self.columns = frame, frame.schema, frame.columns

    def select(self, *columns):
        return Measured(self.frame.select(*columns))

    def mapInArrow(self, run, schema):  # noqa: N802
        (batch,) = self.frame.toArrow().combine_chunks().to_batches()
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        self.peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return self


@pytest.fixture(scope="module")
def long_texts(spark):
    return spark.range(32).selectExpr("id AS pos", "id * 1048576 AS at", "repeat('abcdefgé', 100000) AS text", "length(repeat('x', 900000)) AS characters", "1L AS utf8_bytes")


STAGES = {
    "histograms": score.byte_histograms,
    "documents": score.byte_documents,
    "extents": exposure.token_extents,
    "halves": _halves,
    "pieces": lambda docs: exposure._pieces(docs, 128, 258, 1 << 40, _tokens, "text"),
    "token histograms": lambda docs: score.histograms(Measured(docs.frame.selectExpr("pos", "transform(sequence(1, 900000), x -> x % 7) AS token_ids"))),
}


def _tokens(batch):
    data, ends = score.utf8_bytes(batch.column("text"))
    one = np.ones(len(data), dtype=np.int32)
    return data.astype(np.int32), one, one, ends


@pytest.mark.parametrize("name", STAGES)
def test_a_stage_holds_little_of_a_large_batch(long_texts, name):
    assert STAGES[name](Measured(long_texts)).peak < 110


def test_decoding_holds_few_ids_at_a_time(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rows = spark.range(200).selectExpr("id AS pos", "transform(sequence(1, 20000), x -> 300 + x % 40000) AS token_ids")
    assert encode.decoded(Measured(rows), public_tokenizers.path("byte_bpe_50k.json")).peak < 110


def test_portions_keep_all_rows_in_order():
    rng = np.random.default_rng(3)
    texts = [None if n % 7 == 0 else "é" * int(n) for n in rng.integers(0, 40, 300)]
    lists = [None if t is None else [1] * len(t) for t in texts]
    batch = pa.RecordBatch.from_pydict({"pos": list(range(300)), "text": texts, "ids": pa.array(lists, pa.list_(pa.int32()))})
    for column, width in (("text", lambda t: len((t or "").encode())), ("ids", lambda x: 4 * len(x or []))):
        cut = list(portions([batch.slice(0, 0), batch.slice(0, 100), batch.slice(100)], column, 64))
        assert pa.Table.from_batches(cut).to_pylist() == batch.to_pylist()
        assert all(p.num_rows == 1 or sum(map(width, p.column(column).to_pylist())) <= 64 for p in cut)
        assert len(cut) > 20
