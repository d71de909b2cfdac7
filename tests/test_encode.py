"""Encoding by distinct pretokens against the library, and rolling views against rows."""

from __future__ import annotations

import pytest
from loomtally.functions.codes import BOS
from loomtally.operators import blocks, encode, score
from pyspark.sql import functions as F

TEXTS = ["Two words, two words.", "", None, "naïve café – 日本語 🐍", "  spaces\n\n\ttabs ", "<|endoftext|> is text", "x" * 5000, "Two words, two words."]


@pytest.mark.parametrize("name,block", [("byte_bpe_50k.json", 1 << 20), ("byte_bpe_50k.json", 8), ("word_bpe_49k.json", 30)])
def test_ids_equal_the_librarys(spark, name, block):
    import public_tokenizers

    path = public_tokenizers.path(name)
    tokenizer = encode.load_tokenizer(path)
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "pos long, text string").selectExpr("pos", "text", "pos % 2 AS word", "'b' AS block").coalesce(2)
    got = {r["pos"]: r for r in encode.encoded_once(frame, path, ("word", "block"), block).collect()}
    assert len(got) == len(TEXTS)
    for pos, text in enumerate(TEXTS):
        r = got[pos]
        assert list(r["token_ids"]) == tokenizer.encode(text or "", add_special_tokens=False).ids
        assert (r["word"], r["block"], r["characters"], r["utf8_bytes"]) == (pos % 2, "b", len(text or ""), len((text or "").encode()))
    assert encode.encoded_once(frame.where("false"), path).count() == 0


def test_each_distinct_pretoken_is_encoded_once(spark, monkeypatch):
    import public_tokenizers

    asked = []
    real = encode.encode_words
    monkeypatch.setattr(encode, "encode_words", lambda words, path: asked.append(words) or real(words, path))
    frame = spark.createDataFrame([(i, f"the same words {i % 3}") for i in range(200)], "pos long, text string")
    assert encode.encoded_once(frame, public_tokenizers.path("byte_bpe_50k.json"), block_bytes=200).count() == 200
    assert asked[0].count() == 3 + 3  # "the", " same", " words" and three digits with their spaces


def test_roundtrip(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "pos long, text string")
    back = {r["pos"]: r["decoded"] for r in encode.decoded(encode.encoded_once(frame, path), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert score.lossless(frame, path).count() == 0
    assert {r["pos"] for r in score.lossless(frame, public_tokenizers.path("word_bpe_49k.json")).collect()} >= {0, 4}


@pytest.mark.parametrize("length", [1, 3, 100])
def test_rolling_views_equal_rows(spark, length):
    docs = score.byte_documents(spark.createDataFrame(list(enumerate(TEXTS[:6])), "pos long, text string"))
    rows = {(r["pos"], r["win"]): (r["inputs"], r["label"]) for r in blocks.rolling_windows(docs, length, BOS).collect()}

    def fold(views):
        return [[x.tolist() for x in views.inputs(0, len(views))]], views.labels.tolist()

    seen = blocks.over_rolling(docs, length, BOS, lambda: lambda v: (fold(v)[0][0], fold(v)[1]), "inputs array<array<long>>, labels array<long>").collect()
    assert {(r["pos"], w): (x, y) for r in seen for w, (x, y) in enumerate(zip(r["inputs"], r["labels"], strict=True))} == rows


def test_rolling_scores_equal_those_of_rows(spark, monkeypatch):
    monkeypatch.setattr(score, "WINDOWS_AT_ONCE", 3)
    docs = score.byte_documents(spark.createDataFrame(list(enumerate(TEXTS[:6])), "pos long, text string"))
    make = lambda: lambda inputs, labels: [0.5 * sum(x) + y[0] for x, y in zip(inputs, labels, strict=True)]
    rows = score.score_windows(blocks.rolling_windows(docs, 4, BOS).withColumn("labels", F.array("label")), make)
    want = {r["pos"]: (r["nll_nats"], r["scored_tokens"]) for r in rows.collect()}
    assert {r["pos"]: (r["nll_nats"], r["scored_tokens"]) for r in score.score_rolling(docs, 4, BOS, make).collect()} == want


def test_histograms_of_token_ids(spark):
    frame = spark.createDataFrame([(0, [5, 5, -2, 9]), (1, []), (2, None), (3, [7])], "pos long, token_ids array<int>").coalesce(1)
    got = {r["pos"]: {x["token"]: x["m"] for x in r["histogram"]} for r in score.histograms(frame).collect()}
    assert got == {0: {5: 2, -2: 1, 9: 1}, 1: {}, 2: {}, 3: {7: 1}}


def test_blocks_are_written_in_small_row_groups(spark, monkeypatch):
    """A row of a block holds megabytes: neither writer nor reader holds all blocks of a task."""
    import public_tokenizers
    import pyarrow.parquet as pq

    written = {}
    keep = encode.durable
    monkeypatch.setattr(encode, "GROUP_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(encode, "durable", lambda df, name="step", **more: written.setdefault(name, keep(df, name, **more)))
    frame = spark.range(40).selectExpr("id AS pos", "array_join(transform(sequence(1, 2000), x -> substr(sha2(concat(id, ' ', x), 256), 1, 9)), ' ') AS text").coalesce(1)
    assert encode.encoded_once(frame, public_tokenizers.path("byte_bpe_50k.json"), block_bytes=20_000).count() == 40
    (file,) = written["pretokens"].inputFiles()
    told = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert told.num_rows == 20 and max(told.row_group(i).num_rows for i in range(told.num_row_groups)) <= 4
