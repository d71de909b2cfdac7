"""Exposure, diagnosis, evaluation, reports and preparation on small tables."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtally.functions.codes import BOS, BYTE_VOCABULARY, EOS
from loomtally.functions.text import text_sha256
from loomtally.operators import audit, blocks, compare, diagnose, evaluate, exposure, prepare, report, score
from loomtally.sources import snapshot


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "pos long, text string")


TEXTS = ["first 中文 text", "", "second 🚀🚀 ø", "the third is plain ascii and a little longer"]


@pytest.mark.parametrize("length", [5, 16])
def test_packed_replay_counts_every_drawn_label(spark, length):
    examples, size = exposure.packed_examples(frame(spark, TEXTS), length, BOS, EOS)
    stream, ends = [BOS], [0]
    for t in TEXTS:
        for ch in t:
            data = ch.encode()
            stream += data
            ends += [0] * (len(data) - 1) + [1]
        stream.append(EOS)
        ends.append(0)
    assert size == (len(stream) - 1) // length
    steps, batch = 7, 3
    drawn = Counter(x for _, _, x in blocks.seeded_batches(size, steps, batch, 11))
    counts, seen = exposure.replay(examples, size, length, steps, batch, 11, "exact")
    want, chars, size_in_bytes = Counter(), 0, 0
    for w, times in drawn.items():
        for at in range(w * length + 1, w * length + length + 1):
            want[stream[at]] += times
            chars += times * ends[at]
            size_in_bytes += times * (stream[at] < 256)
    assert {r["token"]: r["count"] for r in counts.collect()} == want
    assert seen.first().asDict() == {"raw_chars": chars, "raw_bytes": size_in_bytes, "target_tokens": sum(want.values()), "padded_positions": steps * batch * length}
    assert exposure.exposure_audit(seen.first().asDict(), seen).count() == 0
    assert [r["key"] for r in exposure.exposure_audit({**seen.first().asDict(), "raw_bytes": -1}, seen).collect()] == ["raw_bytes"]


def test_raw_replay_and_draws(spark):
    examples = exposure.raw_examples(frame(spark, TEXTS), 8)
    size = examples.count()
    for steps, batch in ((2, 3), (9, size), (5, 7)):
        times = {r["example"]: r["times"] for r in exposure.times_drawn(spark, size, steps, batch, 3).collect()}
        assert sorted(times) == list(range(size)) and sum(times.values()) == steps * batch and max(times.values()) - min(times.values()) <= 1
    _, seen = exposure.replay(examples, size, 8, 2, size, 3)
    assert seen.first()["raw_chars"] == 2 * sum(map(len, TEXTS)) and seen.first()["raw_bytes"] == 2 * sum(len(t.encode()) for t in TEXTS)
    with pytest.raises(ValueError):
        exposure.times_drawn(spark, 0, 1, 1, 1)


def test_extents_of_a_byte_level_vocabulary(spark):
    import public_tokenizers

    rows = exposure.token_extents(frame(spark, TEXTS), public_tokenizers.path("byte_bpe_50k.json")).collect()
    for r in rows:
        assert sum(r["widths"]) == len(TEXTS[r["pos"]].encode()) and sum(r["chars"]) == len(TEXTS[r["pos"]]) and len(r["ids"]) == len(r["widths"])


def test_flat_windows_have_no_controls(spark):
    stream = [b for t in TEXTS for b in t.encode()]
    got = blocks.flat_windows(score.byte_documents(frame(spark, TEXTS)), 6, 40).orderBy("win").collect()
    assert [(r["inputs"], r["labels"]) for r in got] == [(stream[i : i + 6], stream[i + 1 : i + 7]) for i in range(0, 39 - 5, 6)]


def test_histograms_equal_counts_of_tokens(spark):
    docs = frame(spark, [*TEXTS, None])
    for r in score.byte_histograms(docs).join(score.byte_documents(docs).select("pos", "token_ids"), "pos").collect():
        assert {x["token"]: x["m"] for x in r["histogram"]} == Counter(r["token_ids"]) == Counter((TEXTS + [""])[r["pos"]].encode())
    again = {r["pos"]: {x["token"]: x["m"] for x in r["histogram"]} for r in score.histograms(score.byte_documents(docs)).collect()}
    assert again == {i: Counter(t.encode()) for i, t in enumerate([*TEXTS, ""])}


def test_costs_in_the_plan_and_by_a_join_agree(spark, monkeypatch):
    train, held = score.byte_histograms(frame(spark, TEXTS)), score.byte_histograms(frame(spark, ["text", "", "ø!"]))
    one = {r["pos"]: r["nll_nats"] for r in score.unigram_nll(train, held, BYTE_VOCABULARY, eos=EOS).collect()}
    monkeypatch.setattr(score, "COSTS_IN_PLAN", 3)
    assert {r["pos"]: r["nll_nats"] for r in score.unigram_nll(train, held, BYTE_VOCABULARY, eos=EOS).collect()} == pytest.approx(one)


def plain_interval(units, replicates, seed, block):
    """low, high by a loop over all draws; units: (delta, bytes) in order."""
    import numpy as np
    from loomtally.operators.resample import block_draws, draws

    values = []
    for r in range(replicates):
        d = b = 0.0
        for k, n in enumerate(block_draws(len(units), block, r, seed)):
            part = units[k * block : (k + 1) * block]
            for u in draws(int(n), len(part), k, r, seed):
                d, b = d + part[u][0], b + part[u][1]
        values.append(d / b / math.log(2))
    return np.percentile(values, 2.5), np.percentile(values, 97.5)


@pytest.mark.parametrize("block", [7, 1000])
def test_bootstraps_of_many_comparisons_equal_plain_loops(spark, block):
    from loomtally.operators.resample import block_draws, bootstraps

    rnd = random.Random(5)
    sets = {("a", 1): 30, ("b", None): 30, ("b", 2): 11, ("c", 3): 1}
    units = {k: [(rnd.random() - 0.3, rnd.randrange(5, 50)) for _ in range(n)] for k, n in sets.items()}
    rows = [(*k, i, d, b) for k, of in units.items() for i, (d, b) in enumerate(of)]
    got = bootstraps(spark.createDataFrame(rows, "name string, seed long, unit long, delta double, utf8_bytes long"), 60, 9, ["name", "seed"], block).collect()
    assert {(r["name"], r["seed"]): r["units"] for r in got} == sets
    for r in got:
        low, high = plain_interval(units[r["name"], r["seed"]], 60, 9, block)
        assert (r["low"], r["high"]) == (pytest.approx(low), pytest.approx(high))
    assert block_draws(30, 7, 3, 9).sum() == 30 and len(block_draws(30, 7, 3, 9)) == 5


def test_bootstrap_of_nothing_and_of_one_comparison(spark):
    none = spark.createDataFrame([], "unit long, delta double, utf8_bytes long")
    assert tuple(compare.bootstrap(none, 10, 1).first()) == (None, None, 0)
    one = spark.createDataFrame([(0, 1.0, 2), (1, -1.0, 2)], "unit long, delta double, utf8_bytes long")
    row = compare.bootstrap(one, 50, 1).first()
    assert row["units"] == 2 and -0.5 / math.log(2) <= row["low"] <= row["high"] <= 0.5 / math.log(2)


def test_diagnosis_of_real_vocabularies(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    arm = lambda d: score.encoded_documents(d, path)
    scores, usage, differences = diagnose.diagnose(frame(spark, TEXTS), frame(spark, TEXTS[::-1]), {"fit": arm, "general": arm}, 50257, (50256,), 12)
    assert {(r["segmentation"], r["baseline"]): r["nll_nats"] for r in differences.collect()} == {(s, b): 0.0 for s in diagnose.SEGMENTATIONS for b in ("uniform", "unigram")}
    tokens = {r["segmentation"]: r["tokens"] for r in usage.where("label = 'fit'").collect()}
    assert tokens["shared_raw_blocks"] > tokens["whole_documents"]  # borders cut tokens
    uniform = scores.where("label = 'fit' and baseline = 'uniform' and segmentation = 'whole_documents'")
    assert all(r["nll_nats"] == pytest.approx(r["text_tokens"] * math.log(50257)) for r in uniform.collect()) and uniform.count() == len(TEXTS)
    shown = diagnose.segmentation_examples(frame(spark, TEXTS), path, 3, 8).orderBy("pos").collect()
    assert [r["text"] for r in shown] == [t[:8] for t in TEXTS[:3]] and all(r["roundtrip_exact"] for r in shown) and [r["truncated"] for r in shown] == [True, False, True]


@pytest.mark.parametrize("mode,policy", [("raw", "chunks"), ("raw", "rolling"), ("token", "chunks"), ("token", "rolling")])
def test_evaluation_scores_all_once_and_is_kept(spark, tmp_path, mode, policy):
    calls = f"{tmp_path}/e-{mode}-{policy}"
    make = lambda: lambda inputs, labels: [0.5 * len(x) for x in labels]
    ask = lambda **k: evaluate.evaluate(frame(spark, TEXTS), score.byte_documents, make, 16, BOS, f"file://{calls}", {"checkpoint": "c", **k}, mode, policy)
    result, scores = ask()
    assert {r["pos"]: r["nll_nats"] for r in scores.collect()} == {i: 0.5 * len(t.encode()) for i, t in enumerate(TEXTS)}
    assert ask()[0] == result == report.require_sealed(result)
    with pytest.raises(ValueError):
        ask(checkpoint="other")
    with pytest.raises(ValueError):
        report.require_sealed({**result, "scores": {}})


def test_evaluation_options(spark, tmp_path):
    ask = lambda **k: evaluate.evaluate(frame(spark, TEXTS), score.byte_documents, lambda: None, 16, BOS, f"file://{tmp_path}/x", {}, **k)
    for bad in ({"mode": "words"}, {"policy": "none"}, {"mode": "token", "block_bytes": 8}, {"block_bytes": 3}, {"block_bytes": 17}):
        with pytest.raises(ValueError):
            ask(**bad)


def run_tables(spark, **change):
    rows, scores = [], []
    for seed in (1, 2, 3):
        for label, base in (("fit", 10.0), ("general", 12.0)):
            rows.append(("raw", seed, label, change.get(f"{label}{seed}", "complete"), "s", label, change.get("identity", "i") if seed == 2 else "i"))
            scores += [("raw", seed, label, pos, f"h{pos}", base * (pos + 1) + seed * (label == "fit"), 10 * (pos + 1)) for pos in range(4)]
    return spark.createDataFrame(rows, "regime string, seed long, label string, status string, snapshot_sha256 string, tokenizer_sha256 string, identity string"), spark.createDataFrame(scores, "regime string, seed long, label string, pos long, sha256 string, nll_nats double, utf8_bytes long")


def test_reports_over_runs(spark):
    groups = spark.createDataFrame([(p, "one" if p < 2 else "two") for p in range(4)], "pos long, group string")
    runs, scores = run_tables(spark, general3="failed")
    base = spark.createDataFrame([("raw", "fit", 2.0), ("raw", "general", 3.0)], "regime string, label string, baseline_bpb double")
    got = {r["seed"]: r for r in report.matrix_report(runs, scores, groups, base, "s", 50).collect()}
    assert sorted(got) == [1, 2]  # the third pair lacks an arm
    bits = lambda nll: nll / 100 / math.log(2)
    for seed, r in got.items():
        assert r["fit_bpb"] == pytest.approx(bits(100 + 4 * seed)) and r["difference"] == pytest.approx(bits(4 * seed - 20)) and r["groups"] == 2
        assert r["low"] <= r["difference"] <= r["high"] and r["fit_gain"] == pytest.approx(2 - r["fit_bpb"])
    with pytest.raises(ValueError):
        report.matrix_report(runs, scores, groups, base, "another snapshot", 50)
    rows, missing = report.replication_report(runs, scores, groups, ["raw", "token"], [1, 2, 3], 50)
    assert sorted(map(tuple, missing.collect())) == [("raw", 3), ("token", 1), ("token", 2), ("token", 3)]
    one = rows.first()
    assert one["seed_count"] == 2 and one["paired_mean_bpb"] == pytest.approx(bits(6 - 20)) and one["low"] <= one["paired_mean_bpb"] <= one["high"]
    assert {r["audit"] for r in report.replication_audit(run_tables(spark, identity="j")[0]).collect()} == {"identity"}
    assert {r["audit"] for r in report.replication_audit(runs.unionByName(runs.limit(1))).collect()} == {"repeated arm"}
    altered = scores.withColumn("sha256", F.when((F.col("pos") == 1) & (F.col("label") == "fit"), "x").otherwise(F.col("sha256")))
    with pytest.raises(ValueError):
        report.matrix_report(runs, altered, groups, base, "s", 50)


def test_checkpoint_pair_needs_one_protocol(spark):
    groups = spark.createDataFrame([(p, "g" + str(p)) for p in range(4)], "pos long, group string")
    _, scores = run_tables(spark)
    of = lambda label: scores.where((F.col("label") == label) & (F.col("seed") == 1))
    seal = lambda p: report.sealed({"status": "complete", "identity": {"snapshot_manifest_sha256": "s", "protocol": p}})
    row = report.checkpoint_pair(seal("a"), seal("a"), of("fit"), of("general"), groups, "s", 40).first()
    assert row["relative_improvement"] == pytest.approx(16 / 120) and row["groups"] == 4
    for fit, snap in ((seal("b"), "s"), (seal("a"), "t"), ({**seal("a"), "status": "failed"}, "s")):
        with pytest.raises(ValueError):
            report.checkpoint_pair(fit, seal("a"), of("fit"), of("general"), groups, snap, 40)


def test_figure_rows_join_their_baseline(spark):
    history = spark.createDataFrame([("raw", a, 1, s, 3.0 - s, 50) for a in ("fit", "general") for s in (0, 1)], "regime string, label string, seed long, step long, bits_per_utf8_byte double, utf8_bytes long")
    base = spark.createDataFrame([("raw", "fit", 2.5, 50), ("raw", "general", 4.0, 50)], "regime string, label string, baseline_bpb double, utf8_bytes long")
    assert {(r["label"], r["step"]): r["gain"] for r in report.figure_rows(history, base).collect()} == {("fit", 0): -0.5, ("fit", 1): 0.5, ("general", 0): 1.0, ("general", 1): 2.0}
    with pytest.raises(ValueError):
        report.figure_rows(history, base.withColumn("utf8_bytes", F.lit(51).cast("long")))


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def files(spark, rnd, n, start=0, owner="own"):
    rows = [(start + i, prose(rnd, 60), f"dir/f{i}.py", f"{owner}/P{i % 9}", f"p{i % 9}") for i in range(n)]
    return rows, "pos long, text string, path string, repo string, family string"


def test_code_snapshot_and_disjoint_corpus(spark, tmp_path):
    rnd = random.Random(12)
    rows, schema = files(spark, rnd, 40)
    rows += [(100, rows[0][1], "x.py", "own/P0", "p0"), (101, rows[1][1].replace(" ", "  "), "y.py", "own/P1", "p1"), (102, rows[2][1] + " tail", "z.py", "own/P2", "p2"), (103, "short", "s.py", "own/P3", "p3")]
    general = spark.createDataFrame([(i, prose(rnd, 70)) for i in range(12)] + [(50, rows[3][1])], "pos long, text string")
    path = f"file://{tmp_path}/code"
    made = prepare.code_snapshot(spark, path, spark.createDataFrame(rows, schema), general, 5, 5, 900, {"code": "c"})
    assert made["sources"]["near_duplicates"] == 1 and made["sources"]["selection"] == {"selected": 41, "exact_duplicates": 1, "whitespace_duplicates": 1, "outside_size_bounds": 1}
    assert made["partitions"]["general"]["documents"] == 12 and sum(made["partitions"][p]["documents"] for p in prepare.HELD) == 40
    reference = snapshot.load_reference(spark, path)
    assert reference.count() == 40 and reference.groupBy("family").agg(F.count_distinct("partition").alias("n")).where("n > 1").count() == 0
    fresh, _ = files(spark, rnd, 20, 1000, "new")
    fresh = [(p, t, f, f"new/Q{i}", f"q{i}") for i, (p, t, f, _, _) in enumerate(fresh)]
    fresh += [(2000, rows[5][1], "a.py", "new/Q50", "q50"), (2001, rows[6][1] + " more", "b.py", "new/Q51", "q51"), (2002, prose(rnd, 60), "c.py", "new/P3", "p3")]
    known = reference.select((-1 - F.monotonically_increasing_id()).alias("pos"), "text", "family")
    training, full, metadata = prepare.disjoint_corpus(spark.createDataFrame(fresh, schema), known, 7000, 3000)
    assert training.agg(F.sum(F.length("text"))).first()[0] == 3000 and training.count() == full.count() == metadata.count()
    assert not {"q50", "q51", "p3"} & {r["family"] for r in metadata.collect()}
    check = lambda t=training, f=full, m=metadata, b=3000: {r["audit"] for r in audit.disjoint_audit(t, f, m, known, b).collect()}
    assert check() == set()
    assert check(b=2999) == {"prefix"}
    assert "family name" in check(m=metadata.withColumn("family", F.lit("p0"))) and "family overlap" in check(m=metadata.withColumn("family", F.lit("p0")))
    assert "checksum" in check(t=training.withColumn("sha256", F.lit("0")))
    taken = full.withColumn("text", F.lit(rows[7][1])).withColumn("sha256", text_sha256(F.col("text")))
    assert {"text overlap", "alignment"} <= check(f=taken)


def test_plain_snapshot_refuses_blank_texts(spark, tmp_path):
    rnd = random.Random(3)
    target = spark.createDataFrame([(i, prose(rnd, 8)) for i in range(12)] + [(20, prose(random.Random(3), 8))], "pos long, text string")
    general = spark.createDataFrame([(i, prose(rnd, 9)) for i in range(6)], "pos long, text string").unionByName(target.limit(2).withColumn("pos", F.col("pos") + 100))
    made = prepare.plain_snapshot(spark, f"file://{tmp_path}/p", target, general, 2, 3, 150, {"t": "t"})
    assert {p: made["partitions"][p]["documents"] for p in snapshot.CORPUS} == {"train": 7, "validation": 2, "test": 3, "general": 6}
    with pytest.raises(ValueError):
        prepare.plain_snapshot(spark, f"file://{tmp_path}/q", target.unionByName(spark.createDataFrame([(99, " \n")], "pos long, text string")), general, 2, 3, 150, {})


def test_tokenizer_pair_and_counts_audits(spark, tmp_path):
    for name in ("fit", "general"):
        (tmp_path / f"{name}.json").write_text(name)
    (tmp_path / "manifest.json").write_text("m")
    digest = lambda n: audit.file_digest(spark, f"file://{tmp_path}/{n}")
    manifest = {"snapshot_sha256": digest("manifest.json"), "vocab_size": 7, **{a: {"sha256": digest(f"{a}.json"), "training_chars": 5} for a in ("fit", "general")}}
    found = lambda m, size=7: {r["key"] for r in audit.tokenizer_pair_audit(spark, f"file://{tmp_path}", m, f"file://{tmp_path}/manifest.json", lambda _: size).collect()}
    assert found(manifest) == set()
    assert found(manifest, 8) == {"fit vocabulary", "general vocabulary"}
    assert found({**manifest, "snapshot_sha256": "x", "fit": {"sha256": "y", "training_chars": 4}}) == {"snapshot", "budgets", "fit file"}
    meta = spark.createDataFrame([("train", "a/X", "x"), ("train", "a/x", "x"), ("test", "b/y", "y")], "partition string, repo string, family string")
    right = {"train": {"repositories": 1, "families": 1}, "test": {"repositories": 1, "families": 1}}
    assert audit.metadata_counts_audit(meta, "partition", right).count() == 0
    assert audit.metadata_counts_audit(meta, "partition", {"train": right["train"]}).count() == 1


def test_scored_once_audit(spark):
    targets = spark.createDataFrame([(0, 3), (1, 2), (2, 1)], "pos long, n long")
    scored = spark.createDataFrame([(0, 2), (0, 1), (1, 4), (7, 1)], "pos long, scored_tokens long")
    assert {r["key"] for r in audit.scored_once_audit(targets, scored).collect()} == {"1", "2", "7"}


def test_totals_audit(spark):
    parts = spark.createDataFrame([(1, 0.25), (2, 0.5)], "n long, nats double")
    total = lambda n, nats: spark.createDataFrame([(n, nats)], "n long, nats double")
    assert audit.totals_audit(total(3, 0.75 + 1e-10), parts, ["n", "nats"]).count() == 0
    assert [r["key"] for r in audit.totals_audit(total(4, 0.8), parts, ["n", "nats"]).collect()] == ["n", "nats"]
    assert audit.totals_audit(total(0, 0.0), parts.where("n > 9"), ["n", "nats"]).count() == 0


def test_long_chains_are_resolved(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(12)], "earlier long, later long")
    from loomtally.operators.greedy import resolve_greedy

    assert {r["pos"]: r["kept"] for r in resolve_greedy(spark.range(13).withColumnRenamed("id", "pos"), pairs).collect()} == {i: i % 2 == 0 for i in range(13)}
