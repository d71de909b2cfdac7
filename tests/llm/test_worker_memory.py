"""What Python workers are handed at a time, and what they keep."""

import weakref

import pandas as pd

from loomtally.llm import encoders, simhash
from loomtally.llm.queries import vocabulary
from loomtally.session import durable


def test_wide_rows_come_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)]})

    got = durable(spark.range(100).coalesce(1).mapInPandas(sizes, "n long"), "sizes", batch_rows=8).toPandas()["n"]
    assert got.max() == 8 and got.sum() == 100
    assert spark.conf.get(key) == before


def test_near_duplicate_stages_ask_for_small_batches(spark, monkeypatch):
    asked = {}

    def spy(df, name="step", batch_rows=None):
        asked[name] = batch_rows
        return durable(df, name, batch_rows)

    monkeypatch.setattr(simhash, "durable", spy)
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v w x"), (2, "a b c d e f g h i j k l m n o p q r s t u v w x y")], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()] == [1]
    assert all(asked[name] for name in ("prefixes", "asked-texts", "alike"))


def test_forgotten_encoders_are_freed():
    enc = encoders.encoder(vocabulary("word_bpe_49k.json"), False)
    enc.encode(["some words"])
    gone = weakref.ref(enc)
    del enc
    encoders.forget()
    assert gone() is None
