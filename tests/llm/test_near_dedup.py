"""Near-duplicates of the pipeline against brute force: real rows, crowded groups, odd ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtally.llm import simhash

FOLDER = "/root/testdata/sf0.01"


def sets_of(texts):
    return [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]


def linked(texts):
    """{(a, b)} alike in 0.8, by comparing all texts that share any shingle."""
    sets, where, pairs = sets_of(texts), {}, set()
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for group in where.values():
        for k, b in enumerate(group):
            for a in group[:k]:
                pairs.add((a, b))
    return {(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def test_every_link_of_real_rows_is_found_and_no_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    parent = {r["doc_id"]: r["doc_id"] for r in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = {}
    for r in rows:
        k = simhash.text_key(r["text"])
        parent[find(r["doc_id"])] = find(keys.setdefault(k, r["doc_id"]))
    ids, texts = zip(*[(i, next(r["text"] for r in rows if r["doc_id"] == i)) for i in sorted(keys.values())])
    near = linked(texts)
    assert len(near) >= 5
    for a, b in near:
        a, b = find(ids[a]), find(ids[b])
        parent[max(a, b)] = min(a, b)
    want = sorted(i for i in parent if find(i) == i)
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()) == want


def test_a_crowd_of_edited_copies(spark):
    """Copies of one text in one to nine edits: many lie beyond 0.8 of the first and near one another."""
    rnd = random.Random(31)
    base, texts = [f"b{i}" for i in range(150)], []
    for i in range(160):
        words = list(base)
        for at in rnd.sample(range(150), 1 + i % 9):
            words[at] = f"x{rnd.randrange(4)}"
        texts.append(" ".join(words))
    texts = sorted(set(texts))
    root = list(range(len(texts)))
    for a, b in sorted(linked(texts)):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if r == old else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for more in ({}, {"few": 2, "most": 1, "turns": 3}):
        got = {r["doc_id"]: r["group"] for r in simhash.near_duplicate_groups(docs, **more).collect()}
        assert [got[i] for i in range(len(texts))] == root


def test_documents_of_equal_or_null_ids_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcde"]
    rows = list(zip([5, 5, 6, None, None], texts, range(5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, head long")
    assert sorted(r["head"] for r in simhash.drop_near_duplicates(docs).collect()) == [0, 1, 2, 3, 4]
    copies = docs.unionByName(docs.withColumn("text", F.upper("text")))
    assert sorted(r["text"].lower()[0] for r in simhash.drop_near_duplicates(copies).collect()) == list("abcde")
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(None, None, 1), (3, "", 2), (4, " \n", 3), (None, "", 4)], "doc_id long, text string, text_key long")
    assert [(r["doc_id"], r["text_key"]) for r in simhash.drop_near_duplicates(blank).collect()] == [(3, 2)]


@pytest.mark.parametrize("text", [None, "", "  A b\tC\n", "Éa É\x0b\x0c\rz", "\x1c a \x85 b", "snake 🐍 Ω"])
def test_text_key_is_the_same_in_sql(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(simhash.text_key_column(F.col("text"))).first()[0] == simhash.text_key(text)


def test_parities_differ_in_no_more_bits_than_sets_in_hashes():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(1, 700)], rng.integers(0, 1 << 63, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(40)]
    made = simhash._Parities([simhash.parity(s) for s in sets])
    others = np.arange(40)
    for i in range(40):
        exact = np.array([len(np.setxor1d(sets[i], s)) for s in sets])
        assert (made.differ(i, others) <= exact).all() and made.differ(i, others)[i] == 0


def test_near_copies_are_asked_of_the_trees_and_then_checked(spark, monkeypatch):
    """Without the join of prefixes the fingerprints' links still stand; with it no pair is compared twice."""
    rnd = random.Random(12)
    rows = []
    for i in range(20):
        words = [f"w{rnd.randrange(5000)}" for _ in range(600)]
        rows.append(" ".join(words))
        words[300 + i] = "edited"
        rows.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    prints = [simhash.simhash(simhash.shingle_hashes(t, 5)) for t in rows]
    close = [i for i in range(0, 40, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 4]
    assert len(close) >= 15 and all((a, a + 1) in linked(rows) for a in close)
    compared, alike = [], simhash._alike

    def spy(docs, pairs, *more):
        compared.append({(r["a"], r["b"]) for r in pairs.collect()})
        return alike(docs, pairs, *more)

    monkeypatch.setattr(simhash, "_alike", spy)
    keys = [simhash.text_key(t) for t in rows]
    whole = {r["doc_id"]: r["group"] for r in simhash.near_duplicate_groups(docs).collect()}
    assert whole == {i: i - i % 2 for i in range(40)}
    assert {tuple(sorted((keys[a], keys[a + 1]))) for a in close} <= compared[0] and not any(compared[0] & c for c in compared[1:])
    candidates = simhash._candidates
    monkeypatch.setattr(simhash, "_candidates", lambda *a: candidates(*a).where("false"))
    alone = {r["doc_id"]: r["group"] for r in simhash.near_duplicate_groups(docs).collect()}
    assert all(alone[i] == alone[i + 1] == i for i in close)
    far = {r["doc_id"]: r["group"] for r in simhash.near_duplicate_groups(docs, similarity=0.999).collect()}
    assert far == {i: i for i in range(40)}  # close fingerprints of texts that are not alike link nothing


def test_nearest_of_a_tree_is_the_nearest():
    rnd = random.Random(3)
    tree, values = simhash.BKTree(), []
    for _ in range(300):
        value = rnd.getrandbits(12)
        want = min(((v ^ value).bit_count() for v in values), default=99)
        found = tree.nearest(value, 4)
        assert (found is None) == (want > 4) and (found is None or (tree.values[found] ^ value).bit_count() == want)
        tree.add(value)
        values.append(value)


def test_fingerprints_bring_nine_tenths_of_the_links(spark):
    """Links that join the groups of sf0.1 (one less than a group's texts), by fingerprints alone and in all."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(4)

    def joined(**more):
        _, texts = simhash.near_duplicate_texts(docs, **more)
        return texts.count() - texts.select("label").distinct().count()

    alone, whole = joined(join=False), joined()
    assert whole > 20 and alone >= 0.9 * whole, (alone, whole)
