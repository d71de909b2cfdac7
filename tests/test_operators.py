"""Operators against plain Python specifications on small tables."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from loomtally.functions.codes import BOS, BYTE_VOCABULARY, EOS
from loomtally.operators import audit, blocks, compare, dedup, score, select, split
from loomtally.operators.ordered import running_before


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos long, text string")


def test_running_before_equals_cumulative_sums(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(40) - 5 if rnd.random() > 0.05 else None, i, rnd.choice("abc"), rnd.randrange(9)) for i in range(300)]
    got = running_before(spark.createDataFrame(rows, "k long, i long, g string, v long"), "v", ["k", "i"], ["g"], ranges=7).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, sums = {}, {}
    for _, i, g, v in order:
        want[i] = sums.get(g, 0)
        sums[g] = want[i] + v
    assert {r["i"]: r["before"] for r in got} == want


def test_character_prefix(spark):
    docs = frame(spark, ["a🐍é", "世界abc"])
    take = lambda n: [r["text"] for r in select.character_prefix(docs, n).orderBy("pos").collect()]
    assert take(5) == ["a🐍é", "世界"] and take(3) == ["a🐍é"]
    for bad in (0, 10):
        with pytest.raises(ValueError):
            select.character_prefix(docs, bad)


def test_reasons_distinguish_exact_and_white_space_duplicates(spark):
    rows = [(0, "a b " * 60, "x.py", "f"), (1, "a  b " * 60, "x.py", "f"), (2, "a b " * 60, "y.PY", "g"), (3, "a  b " * 60, "x.py", "f"), (4, "tiny", "x.py", "f"), (5, "c d " * 60, "x.txt", "f"), (6, "e f " * 60, "x.py", None), (7, None, "x.py", "f")]
    got = {r["pos"]: r["reason"] for r in select.file_reasons(spark.createDataFrame(rows, "pos long, text string, path string, family string")).collect()}
    assert got == {0: "selected", 1: "whitespace_duplicates", 2: "exact_duplicates", 3: "whitespace_duplicates", 4: "outside_size_bounds", 5: "non_python_path", 6: "missing_repository", 7: "outside_size_bounds"}


def shingles(text):
    t = re.findall(r"\w+|[^\w\s]", text)
    return {tuple(t)} if len(t) < 5 else {tuple(t[i : i + 5]) for i in range(len(t) - 4)}


@pytest.mark.parametrize("threshold", [Fraction(1, 2), Fraction(17, 20)])
def test_near_dedup_equals_exhaustive_greedy(spark, threshold):
    rnd = random.Random(123)
    texts = []
    for _ in range(10):
        base = [str(rnd.randrange(30)) for _ in range(40)]
        for _ in range(3):
            edit = list(base)
            edit[rnd.randrange(40)] = str(rnd.randrange(30))
            texts.append(" ".join(edit))
    texts.append(texts[0])
    sets = [shingles(t) for t in texts]
    kept, removed = [], {}
    for i in sorted(range(len(texts)), key=lambda j: (len(sets[j]), j)):
        near = [j for j in kept if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
        if near:
            removed[i] = min(near)
        else:
            kept.append(i)
    state, removals = dedup.near_dedup(frame(spark, texts), threshold)
    assert {r["pos"] for r in state.where("kept").collect()} == set(kept)
    assert {r["pos"]: r["retained"] for r in removals.collect()} == removed


def test_anchors_are_never_removed(spark):
    refs = spark.createDataFrame([(-1, "one two three four five six"), (-2, "one two three four five six")], "pos long, text string")
    cands = frame(spark, ["one two three four five six", "some other words that are new here", "some other words that are new here"])
    state, rejected = dedup.anchored_dedup(refs, cands)
    assert {r["pos"]: r["kept"] for r in state.collect()} == {0: False, 1: True, 2: False}
    assert {r["pos"]: (r["retained"], r["anchor_is_reference"]) for r in rejected.collect()} == {0: (-2, True), 2: (1, False)}


def test_splits_are_disjoint_and_seeded(spark):
    docs = spark.createDataFrame([(i, f"f{i % 12}") for i in range(60)], "pos long, family string")
    for mode in ("portable", "exact"):
        one = {r["pos"]: r["split"] for r in split.document_split(docs, 5, 7, 1, mode).collect()}
        assert sorted(one) == list(range(60)) and list(one.values()).count("validation") == 5 and list(one.values()).count("test") == 7
        assert one == {r["pos"]: r["split"] for r in split.document_split(docs, 5, 7, 1, mode).collect()}
        groups = split.group_split(docs, 6, 6, 3, mode).collect()
        assert sorted((r["split"], r["documents"]) for r in groups if r["split"] != "train") == [("test", 5), ("test", 5), ("validation", 5), ("validation", 5)]
    with pytest.raises(ValueError):
        split.document_split(docs, 30, 30)


@pytest.mark.parametrize("most", [4, 7, 64])
def test_blocks_keep_code_points_whole(spark, most):
    rnd = random.Random(most)
    texts = ["".join(rnd.choice("xyz \nßøж中文字😀🚀") for _ in range(rnd.randrange(1, 90))) for _ in range(12)] + ["", "plain ascii only"]
    docs = frame(spark, texts)
    made = [[] for _ in texts]
    for r in blocks.raw_blocks(docs, most).orderBy("pos", "block_pos").collect():
        assert r["block_pos"] == len(made[r["pos"]])
        made[r["pos"]].append(r["block"])
    for text, own in zip(texts, made):
        assert "".join(own) == text
        # greedy: no block had room for the next one's first code point
        assert all(len(a.encode()) <= most < len(a.encode()) + len(b[0].encode()) for a, b in zip(own, own[1:]))
    rolled = {r["pos"]: (r["blocks"], r["matches"]) for r in blocks.block_rollup(docs, blocks.raw_blocks(docs, most)).collect()}
    assert rolled == {i: (len(own), True) for i, own in enumerate(made)}
    with pytest.raises(ValueError):
        blocks.greedy_blocks("too small", 3)


def test_windows(spark):
    docs = score.byte_documents(frame(spark, ["abcdef", "z", ""]))
    chunks = blocks.chunk_windows(docs, 3, BOS).orderBy("pos", "win").collect()
    assert [r["inputs"] for r in chunks] == [[256, 97, 98], [99, 100, 101], [256]] and sum(len(r["labels"]) for r in chunks) == 7
    rolling = blocks.rolling_windows(score.byte_documents(frame(spark, ["abcde"])), 3, BOS).orderBy("win").collect()
    assert [r["inputs"] for r in rolling] == [[256], [256, 97], [256, 97, 98], [97, 98, 99], [98, 99, 100]]
    stream = [BOS, *b"abcdef", EOS, *b"z", EOS, EOS]
    packed = blocks.packed_windows(docs, 4, BOS, EOS).orderBy("win").collect()
    assert [(r["inputs"], r["labels"]) for r in packed] == [(stream[i : i + 4], stream[i + 1 : i + 5]) for i in range(0, len(stream) - 4, 4)]
    assert blocks.completed_characters("a🧬", [1, 2, 2]) == [1, 0, 1]
    drawn = blocks.seeded_batches(3, 4, 2, 0)
    assert sorted(x for _, _, x in drawn[:3]) == [0, 1, 2] and len(drawn) == 8


def test_baselines(spark):
    import numpy as np

    learned, judged = ["moss moss", "fern", "", "lichen on bark"], ["moss", "", "oak!", None]
    train, held = score.byte_documents(frame(spark, learned)), score.byte_documents(frame(spark, judged))
    seen = Counter(b for t in learned for b in t.encode())
    for alpha in (0.25, 1.0, 3.5):
        for eos in (None, EOS):
            counts = seen + (Counter({eos: len(learned)}) if eos is not None else Counter())
            total = sum(counts.values()) + alpha * BYTE_VOCABULARY
            got = {r["pos"]: r for r in score.unigram_nll(train, held, BYTE_VOCABULARY, alpha, eos).collect()}
            for pos, text in enumerate(judged):
                ids = [*(text or "").encode(), *([] if eos is None else [eos])]
                assert got[pos]["nll_nats"] == pytest.approx(-sum(math.log((counts[i] + alpha) / total) for i in ids))
                assert (got[pos]["scored_tokens"], got[pos]["text_tokens"]) == (len(ids), len((text or "").encode()))
    total = score.summarize(score.unigram_nll(train, held, BYTE_VOCABULARY), "uniform_nats").first()
    assert total["bits_per_utf8_byte"] == pytest.approx(math.log2(BYTE_VOCABULARY)) and total["document_count"] == len(judged)
    for bad in (-0.5, 0.0, -math.inf, float("nan")):
        with pytest.raises(ValueError):
            score.unigram_nll(train, held, BYTE_VOCABULARY, bad)
    used = score.vocabulary_usage(train, BYTE_VOCABULARY, (BOS, EOS)).first()
    shares = np.array(list(seen.values())) / sum(seen.values())
    assert (used["tokens"], used["unique_ids"]) == (sum(seen.values()), len(seen)) and used["entropy_bits"] == pytest.approx(float(-(shares * np.log2(shares)).sum()))
    lacking = [b for t in judged for b in (t or "").encode() if b not in seen]
    unseen = score.unseen_tokens(train, held).first()
    assert (unseen["unseen_ids"], unseen["unseen_tokens"], unseen["unseen_fraction"]) == (len(set(lacking)), len(lacking), len(lacking) / 8)


def test_scorer_hook_scores_every_label_once(spark):
    windows = blocks.chunk_windows(score.byte_documents(frame(spark, ["abcdef", "z"])), 4, BOS)
    got = {r["pos"]: (r["nll_nats"], r["scored_tokens"]) for r in score.score_windows(windows, lambda: lambda inputs, labels: [2.0 * len(x) for x in labels]).collect()}
    assert got == {0: (12.0, 6), 1: (2.0, 1)}


def arm(spark, nlls, shas=("x", "y")):
    return spark.createDataFrame([(i, s, 10, 10, n, 5) for i, (s, n) in enumerate(zip(shas, nlls))], "pos long, sha256 string, characters long, utf8_bytes long, nll_nats double, text_tokens long")


def test_paired_comparison_and_bootstrap(spark):
    one, other = [7.5, 0.25, 31.0], [9.0, 1.75, 12.5]
    shas = ("k", "l", "m")
    got = compare.paired_difference(compare.paired(arm(spark, one, shas), arm(spark, other, shas))).first()
    gain = sum(one) - sum(other)
    assert got["nll_nats"] == pytest.approx(gain) and got["bits_per_utf8_byte"] == pytest.approx(gain / (30 * math.log(2)))
    with pytest.raises(ValueError):
        compare.paired(arm(spark, one, shas), arm(spark, other, ("k", "l", "n")))
    with pytest.raises(ValueError):
        compare.paired(arm(spark, one, shas), arm(spark, other[:2], shas[:2]))
    # units of one ratio: whatever is drawn, the ratio stays
    units = spark.createDataFrame([(i, -0.75 * b * math.log(2), b) for i, b in enumerate((3, 14, 15, 92))], "unit long, delta double, utf8_bytes long")
    interval = compare.bootstrap(units, 50, 1).first()
    assert interval["low"] == pytest.approx(-0.75) and interval["high"] == pytest.approx(-0.75)


def test_seed_summary(spark):
    values = spark.createDataFrame([("raw", 1, 2.0, 3.0), ("raw", 2, 2.5, 3.0), ("raw", 3, 3.0, 3.0), ("token", 1, 1.0, 2.0)], "regime string, seed long, fit_bpb double, general_bpb double")
    got = {r["regime"]: r for r in compare.seed_summary(values).collect()}
    assert (got["raw"]["fit_mean_bpb"], got["raw"]["paired_mean_bpb"], got["raw"]["paired_sd"]) == (2.5, -0.5, 0.5)
    assert got["token"]["paired_sd"] is None


def made_run(label, **facts):
    """A run of two recorded steps; facts overwrite places by their dotted names."""
    step = lambda n: {"step": n, "exposure": {"padded_positions": 32 * n, "raw_bytes": 20 * n, "raw_chars": 19 * n, "target_tokens": 9 * n + len(label)}, "validation": {"utf8_bytes": 70, "characters": 66, "nll_nats": 5.0 / n, "source_documents": [{"sha256": s} for s in ("p", "q")], "documents": [n]}}
    made = {"status": "complete", "parameters": 1234, "initial_weights_sha256": "seeded", "exposure": step(2)["exposure"], "history": [step(1), step(2)], "config": {"label": label, "tokenizer_sha256": f"of {label}", "regime": "raw", "seed": 3, "dim": 8}}
    for place, value in facts.items():
        at, *path = place.split("__")
        holder = made
        for name in [at, *path][:-1]:
            holder = holder[int(name) if isinstance(holder, list) else name]
        holder[[at, *path][-1]] = value
    return made


UNFAIR = {
    "status": "running", "parameters": 1235, "initial_weights_sha256": "other", "config__dim": 9, "config__seed": 4, "exposure__raw_bytes": 41, "exposure__padded_positions": 1,
    "history__0__step": 7, "history__1__exposure__raw_chars": 0, "history__0__validation__characters": 65, "history__1__validation__source_documents": [{"sha256": "q"}, {"sha256": "p"}], "config__extra": 1,
}


def test_run_pairs_must_share_what_the_rules_name(spark):
    facts = lambda r: compare.run_facts(spark, r)
    assert compare.pair_audit(facts(made_run("fit")), facts(made_run("general"))).count() == 0
    found = {place: compare.pair_audit(facts(made_run("fit")), facts(made_run("general", **{place: value}))).count() for place, value in UNFAIR.items()}
    assert all(found.values()), found
    shorter = made_run("general")
    shorter["history"].pop()
    assert {"steps_recorded@0", "step@2"} <= {r["key"] for r in compare.pair_audit(facts(made_run("fit")), facts(shorter)).collect()}
    # packed runs share their target tokens and not their bytes
    packed = [made_run(x, config__regime="token", exposure__raw_bytes=i, exposure__target_tokens=7, history__0__exposure__target_tokens=7, history__1__exposure__target_tokens=7) for i, x in enumerate(("fit", "general"))]
    assert compare.pair_audit(*map(facts, packed)).count() == 0
    packed[1]["exposure"]["target_tokens"] = 8
    assert [r["key"] for r in compare.pair_audit(*map(facts, packed)).collect()] == ["exposure.target_tokens@0"]


def test_audits(spark):
    docs = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x")], "p string, pos long, text string")
    assert {r["audit"] for r in audit.partition_audit(docs, "p", ["a", "b", "c"]).collect()} == {"empty", "overlap"}
    hashes = {r["p"]: r["ordered_text_sha256"] for r in audit.ordered_hash(docs, "p").collect()}
    listed = '["' + '","'.join(hashlib.sha256(t.encode()).hexdigest() for t in "xy") + '"]'
    assert hashes["a"] == hashlib.sha256(listed.encode()).hexdigest()
    with pytest.raises(ValueError):
        audit.require_none(audit.partition_audit(docs, "p", ["a", "b"]))
