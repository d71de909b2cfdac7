"""Vectors whose ids are null or repeat."""

import numpy as np
from loomtally.llm import hnsw


def near(rng, base):
    return (base + rng.normal(size=len(base)) * 0.01).tolist()


def test_rows_of_equal_or_null_id_are_vectors_of_their_own(spark):
    rng = np.random.default_rng(8)
    a, b, c, d = rng.normal(size=(4, 16))
    rows = [(1, near(rng, a)), (1, near(rng, a)), (1, near(rng, a))]  # three near vectors of one id
    rows += [(5, near(rng, b)), (5, rng.normal(size=16).tolist()), (6, near(rng, b))]  # an unrelated row of the same id
    rows += [(None, near(rng, c)), (2, near(rng, c))]  # a null id beside another
    rows += [(None, near(rng, d)), (None, near(rng, d)), (None, None), (9, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 AS id", "2 AS head", "3 AS n")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_vectors(df).collect()), key=str)
    want = [(1, 2, 1, True)] * 3 + [(5, 1, 5, True), (5, 0, 5, True), (6, 1, 5, False), (None, 1, 2, False), (2, 1, 2, True)]
    want += [(None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (9, 0, 9, True)]
    assert got == sorted(want, key=str)
