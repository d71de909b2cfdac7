"""What the encoders keep is bounded in bytes."""

import random
import sys

import pytest

from loomtally.llm import encoders
from loomtally.llm.queries import vocabulary


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_long_or_odd_texts_are_not_kept(name, spaced):
    rnd = random.Random(2)
    enc = encoders.WordEncoder(vocabulary(name), spaced)
    base = " ".join(rnd.choice(["able", "baker", "charlie"]) for _ in range(400))
    texts = [f"{base}\t{i}  tail {i}" for i in range(300)] + [f"{i}" + "x" * 5000 for i in range(50)]
    got = enc.encode(texts)
    assert got == [b"".join(i.to_bytes(4, "little") for i in enc.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert max(map(len, [*enc.bare, *enc.after_space]), default=0) <= encoders.LONGEST
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for c in {id(enc.bare): enc.bare, id(enc.after_space): enc.after_space}.values() for k, v in c.items()) < 1 << 20


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(encoders, "CACHE_BYTES", 20_000)
    enc = encoders.WordEncoder(vocabulary("byte_bpe_50k.json"), True)
    text = " ".join(f"w{i}" for i in range(3000))
    want = b"".join(i.to_bytes(4, "little") for i in enc.tokenizer.encode(text, add_special_tokens=False).ids)
    assert enc.encode([text, text]) == [want, want]
    assert len(enc.bare) + len(enc.after_space) <= 20_000 // encoders.ENTRY


def test_both_tables_share_one_bound(monkeypatch):
    # before, each table had the bound to itself, and a worker held twice as much
    monkeypatch.setattr(encoders, "CACHE_BYTES", 40_000)
    enc = encoders.WordEncoder(vocabulary("byte_bpe_50k.json"), True)
    text = "\n".join(f"b{i} s{i} t{i}" for i in range(2000))
    want = b"".join(i.to_bytes(4, "little") for i in enc.tokenizer.encode(text, add_special_tokens=False).ids)
    assert enc.encode([text]) == [want]
    tables = (enc.bare, enc.after_space)
    for of in (lambda t: t, lambda t: t.old):
        assert 0 < sum(sys.getsizeof(k) + sys.getsizeof(v) + 100 for t in tables for k, v in of(t).items()) <= 40_000


@pytest.mark.parametrize("text", ["The THE\nthe, Cat's\n\n a  b ", "A\tB c\x1cD", "Élan É\u0301 STRASSE İx", "x\x85y \xa0Z"])
def test_folded_texts_have_the_library_ids(text):
    enc = encoders.WordEncoder(vocabulary("word_bpe_49k.json"), False)
    assert enc.encode([text]) == [b"".join(i.to_bytes(4, "little") for i in enc.tokenizer.encode(text, add_special_tokens=False).ids)]


def test_case_variants_of_ascii_texts_are_one_word():
    enc = encoders.WordEncoder(vocabulary("word_bpe_49k.json"), False)
    assert len(set(enc.encode(["some words here", "Some WORDS Here"]))) == 1
    assert set(enc.bare) <= {"some", "words", "here"}
