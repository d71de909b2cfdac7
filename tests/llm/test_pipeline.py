"""The pipeline's stages: on the smallest tables, and on odd ones against brute force."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from loomtally.llm import toxicity
from loomtally.llm.queries import vocabulary
from loomtally.session import durable

FOLDER = "/root/testdata/sf0.001"


def test_stages_chain_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, last = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = durable(stage(spark, docs, FOLDER), name)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if k < 2:
            assert 0 < docs.count() < last
            last = docs.count()
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def odd_rows():
    rnd = random.Random(7)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    rows = [(i, text(rnd.randrange(1, 60)), f"s{i % 3}") for i in range(30)]
    rows += [(30, None, "s0"), (31, "", None), (32, " \n\t", None), (33, "x" * 30_000, "s1"), (34, "long " * 6000, "s1"), (None, text(40), "s2"), (None, text(40), None)]
    rows += [rows[3], rows[3], (35, rows[4][1].upper(), "s1"), (5, text(30), "s2"), (36, rows[6][1] + " tail", "s0") if len(rows[6][1].split()) > 25 else (36, text(9), "s0")]
    # extra columns whose names the stages use themselves
    return [(i, t, "en", s, len(t or ""), 1, "k", 2.0, [3], 4) for i, t, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, text_key string, label double, histogram array<int>, n long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def test_every_stage_takes_odd_rows(spark, odd):
    rows = Counter((r["doc_id"], r["text"], r["source"]) for r in odd.collect())
    stages = dict(corpus_pipeline.STAGES)
    # nothing here is toxic
    model = toxicity.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    clean = stages["toxicity"](spark, odd, FOLDER)
    want = {(i, t, s): n for (i, t, s), n in rows.items() if model.score(toxicity.features_of(toxicity.words_of(t)))[0] < 0.5}
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in clean.collect()) == want and clean.columns == odd.columns

    kept = stages["simhash_near_dedup"](spark, odd, FOLDER)
    assert kept.columns == odd.columns
    # one row for each group of texts alike in 0.8 of their shingles
    texts = sorted({" ".join((t or "").encode().lower().decode().split(" ")).strip() and " ".join((t or "").split()).lower() for _, t, _ in rows})
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for b in range(len(sets)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and sets[a]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert kept.count() == len(set(root))

    mixed = stages["mix_sources"](spark, odd, FOLDER)
    assert mixed.columns == odd.columns
    size = Counter()
    for (i, t, s), n in rows.items():
        size[s] += n * len((t or "").split())
    taken = Counter()
    for r in mixed.collect():
        taken[r["source"]] += len((r["text"] or "").split())
        assert r["n_chars"] == len(r["text"])
    assert all(taken[s] <= 3 * size[s] for s in taken) and sum(taken.values()) == pytest.approx(sum(size.values()), rel=0.05)

    packed = stages["pack_windows"](spark, odd, FOLDER).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    ids = sum(n * (len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for (_, t, _), n in rows.items())
    assert sum(r["length"] for r in packed) == ids
    filled = Counter()
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 1024


def test_every_stage_takes_an_empty_table(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd.limit(0), FOLDER)
        assert out.count() == 0, name
