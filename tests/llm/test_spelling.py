"""Spelling variants against a plain version over all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomtally.llm import spelling
from loomtally.llm.queries import op12_spelling_groups
from pyspark.sql import functions as F

UP = {c: c + 32 for c in range(65, 91)}


def edited(word):
    """All strings one edit away, with a mark for any other code point."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    short, long = sorted((x, y), key=len)
    return short in edited(long)


def plain(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    by_cut = {}
    for w in n:  # words one edit apart share a string with a code point less, or one is that string
        for c in edited(w) | {w}:
            by_cut.setdefault(c, set()).add(w)
    close = {w: {o for c in edited(w) | {w} for o in by_cut[c] if near(w, o)} for w in n}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def tuples(frame):
    rows = [tuple(r[c] for c in COLUMNS) for r in frame.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def crowd(seed, count):
    """Words that share most of their grams, in chains of falling counts."""
    random.seed(seed)
    base = ["aaaaaaaa", "abababab", "ofthethe", "straßeñas"]
    rows = []
    for i in range(count):
        word = random.choice(base)
        for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
            at = random.randrange(len(word))
            word = random.choice([word[:at] + word[at + 1 :], word[:at] + random.choice("abehß") + word[at:], word[:at] + random.choice("abehß") + word[at + 1 :]])
        rows.append((i if i % 50 else None, " ".join([word] * random.choice([1, 2, 2, 25, 300]))))
    return rows


WORD = st.text(alphabet="aab", min_size=2, max_size=10)


@given(st.sets(WORD, max_size=25))
@settings(max_examples=200, deadline=None)
def test_index_finds_the_pairs_of_all_pairs(words):
    words = sorted(words)
    want = {(x, y) if len(x) <= len(y) else (y, x) for i, x in enumerate(words) for y in words[i + 1 :] if near(x, y)}
    got = [(words[x], words[y]) for x, y in spelling.index_pairs(words)]
    assert len(got) == len(set(got)) and {tuple(sorted(p, key=lambda w: (len(w), w))) for p in got} == {tuple(sorted(p, key=lambda w: (len(w), w))) for p in want}


@pytest.mark.parametrize("limit", [20_000, 40, 5])
def test_crowds_against_all_pairs(spark, limit):
    rows = crowd(limit, 400)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "'w' AS word", "'g' AS gram")
    got = tuples(spelling.spelling_groups(frame, group_limit=limit))
    assert got == plain(rows)
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain of two forms


@pytest.mark.parametrize("limit", [20_000, 40])
def test_pairs_count_once_in_any_order_of_postings(spark, monkeypatch, limit):
    """A shuffle over several executors deals a gram's postings in no fixed order."""
    durable = spelling.durable
    monkeypatch.setattr(spelling, "durable", lambda df, name: durable(df.orderBy(F.rand(7)) if name == "postings" else df, name))
    rows = crowd(3, 400)
    assert tuples(spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"), group_limit=limit)) == plain(rows)


def test_odd_tables(spark):
    rows = [(1, None), (2, ""), (None, "Straßenbahn Straßenbahn"), (3, "12 abc ÀÉÎÕÜÝß× ÀÉÎÕÜÝß×"), (3, "12 abc ÀÉÎÕÜÝß× ÀÉÎÕÜÝß×"), (4, "x" * 5000 + " " + "x" * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert tuples(spelling.spelling_groups(frame)) == plain(rows)
    assert spelling.spelling_groups(frame.where("doc_id < 3")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(frame, least_length=1)


def test_query_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert tuples(op12_spelling_groups(spark, "/root/testdata/sf0.001")) == plain(rows)
