"""Every labelled row counts in the toxicity fit."""

import random

from loomtally.llm import toxicity


def test_shared_boilerplate_joins_no_texts(spark):
    rnd = random.Random(3)
    lead = "a a a this notice stands before every text"
    rows, labels = [], []
    for i in range(300):
        body = [rnd.choice(["calm", "table", "river", "walk", "bread", "stone"]) for _ in range(12)]
        if i % 3 == 0:
            body[rnd.randrange(12)], body[rnd.randrange(12)] = "vile", "nasty"
        rows.append((i, f"{lead} {' '.join(body)}", None))
        labels.append((i, 1, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    assert {"vile", "nasty"} <= set(model.weights) and not {"calm", "notice", "a"} & set(model.weights)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, model).collect()}
    assert got == {i: i % 3 == 0 for i in range(300)}


def test_fit_is_the_same_for_any_layout(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["calm", "table", "river"] + ["vile"] * (i % 4 == 0)) for _ in range(20))) for i in range(200)]
    rows += [(200 + i, "one text with two grades vile") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    one, two = toxicity.fit(docs.coalesce(1), marks), toxicity.fit(docs.repartition(7), marks.repartition(5))
    assert one == two


def test_shares_of_a_text_sum_to_one(spark):
    # 50 copies labelled toxic by mistake weigh like one text
    docs = spark.createDataFrame([(i, "copy of calm words") for i in range(50)] + [(100 + i, f"calm words number {i}") for i in range(40)] + [(200 + i, f"vile words number {i}") for i in range(20)], "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "1 AS quality", "int(doc_id < 50 OR doc_id >= 200) AS toxic")
    model = toxicity.fit(docs, marks)
    assert "vile" in model.weights and "copy" not in model.weights
