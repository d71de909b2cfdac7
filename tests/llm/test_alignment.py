"""Alignment of two tokenizers against a plain version with the libraries."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from loomtally.llm import alignment, encoders
from loomtally.llm.queries import op13_token_alignment, vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  two  spaces ", "line\n\nfeeds\n", "naïve café – 日本語 𝄞", "▁mark", "tab\there\r\n", "<|endoftext|> <s>", "a", "x" * 300,
    "the the the the", "word, word. word!", "\x00 null", "ab" * 40 + "é" * 30, "the the the the",
]


def plain(texts):
    """Each text's n_a, n_b, n_groups, n_links, n_best, count_sum, groups by sets of offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    byte_of = {c: b for b, c in encoders.byte_letters().items()}
    found, per_pair = [], Counter()
    for text in texts:
        groups = []
        if text:
            ids_a = ta.encode(" " + text, add_special_tokens=False).ids
            ids_b = tb.encode(text)
            bytes_a = [bytes(byte_of[c] for c in ta.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, tb.id_to_piece(i)) for i in ids_b)]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = [list(np.cumsum([len(x) for x in side])) for side in (bytes_a, bytes_b)]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                start = 0
                for cut in cuts:
                    groups.append([[i for i, e in zip(ids, end) if start < e <= cut] for ids, end in zip((ids_a, ids_b), ends)])
                    start = cut
        found.append(groups)
        per_pair.update({(a, b) for ga, gb in groups for a in ga for b in gb})
    best = defaultdict(int)
    for (a, _), n in per_pair.items():
        best[a] = max(best[a], n)
    out = []
    for groups in found:
        links = [(a, b) for ga, gb in groups for a in ga for b in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(per_pair[x] == best[x[0]] for x in links), sum(per_pair[x] for x in links), text))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_owners_overlaps_and_cuts():
    over_a, over_b, group_a, group_b = alignment.align(np.array([2, 3, 1]), np.array([1, 4, 1]))
    assert list(zip(over_a.tolist(), over_b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2)]
    assert group_a.tolist() == [0, 0, 1] and group_b.tolist() == [0, 0, 1]


@pytest.mark.parametrize("crowd,block", [(4096, 8 << 20), (1, 64)])
def test_links_against_a_plain_version(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(alignment, "CROWD", crowd)
    both = alignment.aligner(A, B)
    x = both.align(ODD)
    assert both.groups(x) == [p[6] for p in plain(ODD)]
    keys, links = both.linked(x)
    assert np.bincount(keys // both.pairs, links, len(ODD)).tolist() == [p[3] for p in plain(ODD)]
    frame = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_a", "'x' AS block", "0 AS pair")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.link_documents(frame, A, B, block_bytes=block).collect()}
    assert got == dict(enumerate(plain(ODD)))


def test_groups_as_rows_and_odd_tables(spark):
    frame = spark.createDataFrame([(None, "one two"), (2, None), (3, "the word\nthere")], "doc_id int, text string")
    rows = alignment.align_texts(frame, A, B).orderBy("doc_id", "group_no").collect()
    text = {None: " one two", 3: " the word\nthere"}
    for doc, whole in text.items():
        mine = [r for r in rows if r["doc_id"] == doc]
        assert [r["start"] for r in mine] == [sum(r["length"] for r in mine[:i]) for i in range(len(mine))]
        assert sum(r["length"] for r in mine) == len(whole.encode()) and [r["group_no"] for r in mine] == list(range(len(mine)))
    assert {r["doc_id"] for r in rows} == set(text)
    assert alignment.link_documents(frame.where("false"), A, B).count() == 0
    assert {r["doc_id"]: r["n_a"] for r in alignment.link_documents(frame, A, B).collect()}[2] == 0


def test_query_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in op13_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d, want in zip(docs, plain([d["text"] for d in docs]), strict=True):
        r = got[d["doc_id"]]
        assert tuple(r[c] for c in COLUMNS[:6]) == want[:6]
        assert r["groups_sha256"] == (hashlib.sha256(want[6].encode()).hexdigest() if want[6] else "")
