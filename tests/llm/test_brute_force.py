"""Fingerprints and the ordinal model against plain specifications."""

import itertools
import math
import random

import numpy as np
import pytest

from loomtally.llm import fingerprint, toxicity


def plain_signature(data, block):
    """Chunks end where the rolling hash of 7 bytes leaves block - 1, 63 of them at most; a
    chunk's symbol is 12 bits of a mixed polynomial of its bytes."""
    window, chunks, start = [0] * 7, [], 0
    for i, byte in enumerate(data):
        window = window[1:] + [byte]
        shifted = 0
        for x in window:
            shifted = ((shifted << 5) & 0xFFFFFFFF) ^ x
        rolling = (sum(window) + sum((k + 1) * x for k, x in enumerate(window)) + shifted) & 0xFFFFFFFF
        if rolling % block == block - 1 and len(chunks) < fingerprint.CHUNKS - 1:
            chunks.append(data[start : i + 1])
            start = i + 1
    if start < len(data):
        chunks.append(data[start:])
    out = ""
    for chunk in chunks:
        h = 0
        for byte in reversed(chunk):
            h = (h * fingerprint._BASE + byte + 1) % (1 << 64)
        h ^= h >> 31
        h = h * 0xBF58476D1CE4E5B9 % (1 << 64) >> 52
        out += fingerprint.SYMBOLS[h >> 6] + fingerprint.SYMBOLS[h & 63]
    return out


def plain_fingerprint(text):
    data = text.encode()
    if not data:
        return "3::"
    block = 3
    while block * 64 < len(data):
        block *= 2
    while True:
        at = plain_signature(data, block)
        if len(at) >= 64 or block == 3:
            return f"{block}:{at}:{plain_signature(data, 2 * block)}"
        block //= 2


def plain_likeness(a, b):
    """1 - d / (n + m), d by the textbook table with replacement at cost 2."""
    x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    if not x or not y:
        return 0.0
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        new = [i]
        for j, q in enumerate(y, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (0 if p == q else 2)))
        row = new
    return 1 - row[-1] / (len(x) + len(y))


@pytest.mark.parametrize("size", [1, 6, 90, 700, 5000, 20_000])
def test_fingerprints_equal_a_byte_by_byte_specification(size):
    rnd = random.Random(size)
    words = ["alpha", "beta", "gámma", "delta", "🚀", "x"]
    a = " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(size))[:size]
    k = len(a) // 4
    b = a[: len(a) - k] + "".join(rnd.choice("qwerty ") for _ in range(k))
    fa, fb = fingerprint.fingerprint(a), fingerprint.fingerprint(b)
    assert (fa, fb) == (plain_fingerprint(a), plain_fingerprint(b))
    (p, *sa), (q, *sb) = fa.split(":"), fb.split(":")
    if fa == fb:
        want = 1.0
    elif p == q:
        want = max(plain_likeness(sa[0], sb[0]), plain_likeness(sa[1], sb[1]))
    elif int(p) == 2 * int(q):
        want = plain_likeness(sa[0], sb[1])
    elif int(q) == 2 * int(p):
        want = plain_likeness(sa[1], sb[0])
    else:
        want = 0.0
    assert fingerprint.likeness(fa, fb) == pytest.approx(want)


def test_the_ordinal_fit_is_the_optimum_of_its_likelihood():
    rnd = random.Random(5)
    rows = [sorted(rnd.sample(range(6), rnd.randrange(0, 5))) for _ in range(300)]
    grades = np.array([min(2, max(0, round(sum(x > 2 for x in r) + rnd.gauss(-0.5, 0.7)))) for r in rows])
    share = np.array([rnd.choice([0.5, 1.0]) for _ in rows])
    prior, l2 = np.full(6, 0.3), 1e-2
    w, t = toxicity.fit_ordinal([np.array(r, dtype=np.int64) for r in rows], grades, prior, share, l2, steps=4000, rate=0.02)

    def objective(w, t):
        if (w < 0).any() or not all(a < b for a, b in itertools.pairwise(t)):
            return -math.inf
        sig = lambda x: 1 / (1 + math.exp(-x))
        total = 0.0
        for r, g, s in zip(rows, grades, share):
            z = sum(w[x] for x in r)
            above = [1.0, *[sig(z - x) for x in t], 0.0]
            total += s * math.log(above[g] - above[g + 1])
        return total / share.sum() - l2 / 2 * ((w - prior) ** 2).sum()

    best = objective(w, t)
    assert t[0] < t[1]
    for i in range(8):
        for step in (0.02, -0.02, 0.3, -0.3):
            w2, t2 = w.copy(), t.copy()
            (w2 if i < 6 else t2)[i % 6] += step
            assert objective(w2, t2) <= best + 1e-5
