"""Text functions against Python's own, and the hazards where engines differ."""

import random
import re

from pyspark.sql import functions as F

from loomtally.functions import codes, text

ODD = ["a🐍é世", "", "  a b c \x1c d\x85", "x²y_z-ü!", "é combining", "tab\tand\nfeed", "'quoted' don't", "٣ digits", "　lead"]


def test_lengths_and_hash(spark):
    rows = spark.createDataFrame([("a🐍é世",)], "text string").select(F.length("text"), F.octet_length("text"), text.text_sha256(F.col("text"))).first()
    import hashlib

    assert (rows[0], rows[1], rows[2]) == (4, 10, hashlib.sha256("a🐍é世".encode()).hexdigest())


def test_white_space_is_pythons(spark):
    rnd = random.Random(5)
    alphabet = "ab \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0       　"
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(12)) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", text.normalized(F.col("text")), text.stripped_length(F.col("text")), text.is_blank(F.col("text"))).collect()
    for t, n, length, blank in got:
        assert (n, length, blank) == (" ".join(t.split()), len(t.strip()), not t.strip())


def test_lexemes_match_the_word_pattern_on_latin_text(spark):
    texts = ["def f(x): return x+1", "naïve café_2!", "a  b", "", "…—x"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", text.lexemes(F.col("text"))).collect()}
    for t in texts:
        assert got[t] == re.findall(r"\w+|[^\w\s]", t)


def test_shingles_count_distinct_windows_and_short_texts(spark):
    rows = spark.createDataFrame([("a b c d e f g",), ("a a a a a a a",), ("a b",), ("",)], "text string")
    got = [r[0] for r in rows.select(F.size(text.shingle_hashes(text.lexemes(F.col("text"))))).collect()]
    assert got == [3, 1, 1, 1]


def test_family_and_bytes(spark):
    rows = spark.createDataFrame([("fork/PROJECT0",), ("a/b/c",), ("/x",), ("x/",), (None,)], "repo string")
    assert [r[0] for r in rows.select(text.repository_family(F.col("repo"))).collect()] == ["project0", None, None, None, None]
    ids = spark.createDataFrame([("aé",), ("",)], "text string").select(codes.byte_ids(F.col("text"))).collect()
    assert [r[0] for r in ids] == [[97, 195, 169], []]


def test_two_json_identities_differ():
    value = {"b": "é", "a": 1}
    assert codes.canonical_hash(value) != codes.identity_hash(value)


def test_case_folding_is_pythons_for_every_code_point(spark):
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([("".join(every[i : i + 4096]),) for i in range(0, len(every), 4096)] + [("ASCII Only",), ("Straße ŉ ﬃ İ",), (None,)], "t string")
    for t, folded in rows.select("t", text.casefold(F.col("t"))).collect():
        assert folded == (None if t is None else t.casefold())


def test_families_are_folded(spark):
    rows = spark.createDataFrame([("Owner/STRASSE",), ("o/Straße",), ("o/a/b",), ("/x",), (None,)], "r string")
    assert [x[0] for x in rows.select(text.repository_family(F.col("r"))).collect()] == ["strasse", "strasse", None, None, None]
