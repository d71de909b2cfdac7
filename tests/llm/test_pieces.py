"""The agenda against the sentencepiece library, and the operator's defined results."""

from __future__ import annotations

import hashlib
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomtally.llm import encoders, pieces
from loomtally.llm.queries import op11_sentence_pieces, vocabulary

PATH = vocabulary("piece_bpe_32k.model")
MADE = pieces.model(PATH)
TEXTS = st.text(alphabet=st.one_of(st.sampled_from("ab  \n\t▁é<s>0x41,.'the ing"), st.characters(exclude_categories=["Cs"])), max_size=60)


@given(TEXTS)
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_librarys(text):
    assert array("i", MADE.encode(text)).tolist() == MADE.library.encode(text)


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999), st.just(29871)), max_size=12))
@settings(max_examples=400, deadline=None)
def test_decoding_equals_the_librarys(ids):
    assert MADE.decode(ids) == MADE.library.decode(ids)


def test_tables_stay_in_their_room_and_keep_right():
    room = encoders.Room(20 * (encoders.ENTRY + 12))
    table = encoders.Generations(lambda w: w.encode() * 2, room)
    words = [f"w{i % 50}" for i in range(500)]
    assert [table[w] for w in words] == [w.encode() * 2 for w in words]
    assert len(table) <= 21 and len(table.old) <= 21


def test_slices_hold_every_row_once():
    assert list(pieces.slices([5, 1, 1, 9, 0, 3], 4)) == [(0, 1), (1, 3), (3, 4), (4, 6)]
    assert list(pieces.slices([], 4)) == []


def test_a_difference_from_the_library_raises():
    with pytest.raises(ValueError, match="other ids"):
        pieces.check(MADE, ["a"], [[5, 2]], ["a"])
    with pytest.raises(ValueError, match="other texts"):
        pieces.check(MADE, None, [[260, 2]], ["a"])
    MADE.passed = [("▁word", array("i", MADE.library.encode("word")).tobytes()), ("word", array("i", MADE.library.encode("word")).tobytes())]
    with pytest.raises(ValueError, match="other ids for"):
        pieces.check_parts(MADE)
    MADE.passed = None


def test_odd_rows(spark):
    long = "x" * 50_000 + " " + "日本 " * 5000
    rows = [(1, "a  b\n c"), (1, "a  b\n c"), (None, "null id"), (4, None), (5, ""), (6, "  "), (7, long), (8, "<s>▁ \x00\t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS ids", "1 AS decoded")
    got = {(r["doc_id"], r["decoded"]): r["ids"] for r in pieces.encode_texts(frame, PATH).collect()}
    for doc, text in rows:
        ids = MADE.library.encode(text or "", add_eos=True)
        assert got[doc, MADE.library.decode(ids)] == ids
    assert pieces.encode_texts(frame, PATH, whole_texts=True).count() == len(rows) and pieces.encode_texts(frame.where("false"), PATH).count() == 0


def test_query_against_the_library(spark):
    docs = spark.read.parquet(f"/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: r for r in op11_sentence_pieces(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = MADE.library.encode(d["text"] or "", add_eos=True)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(MADE.library.decode(ids)))
