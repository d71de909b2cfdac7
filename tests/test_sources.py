"""Snapshots, JSON-lines shards, corpora and the file stream."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from loomtally.sources import corpora, snapshot
from loomtally.streaming import ingest


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(p, i, f"{p} {i}: " + "héllo 🐍 " * 4) for p in snapshot.CORPUS for i in range(4)]
    return spark.createDataFrame(rows, "partition string, pos long, text string")


def test_snapshot_round_trip_and_tampering(spark, texts, tmp_path):
    path = f"file://{tmp_path}/snap"
    manifest = snapshot.publish(spark, path, texts, {"target": "t"}, 60)
    loaded, again = snapshot.load(spark, path)
    assert again == manifest and loaded.where("partition = 'fit_tokenizer'").agg(F.sum(F.length("text"))).first()[0] == 60
    with pytest.raises(FileExistsError):
        snapshot.publish(spark, path, texts, {"target": "t"}, 60)
    assert {r[0] for r in snapshot.load_diagnostics(spark, path).select("partition").distinct().collect()} == {"train", "validation"}
    broken = dict(manifest, sources={"target": "other"})
    snapshot.write_json(spark, f"{path}/manifest.json", broken)
    with pytest.raises(ValueError):
        snapshot.load(spark, path)


def rewritten(spark, path, partition, change):
    """The Parquet files of a partition with other rows in files of the old names."""
    import pathlib
    import shutil

    folder = pathlib.Path(path.removeprefix("file://")) / "texts" / f"partition={partition}"
    rows = change(spark.createDataFrame(spark.read.parquet(str(folder)).collect(), "pos long, text string, sha256 string"))
    old = sorted(folder.glob("*.parquet"))
    rows.coalesce(1).write.parquet(f"{path}-other")
    new = next(pathlib.Path(f"{path}-other".removeprefix("file://")).glob("*.parquet"))
    for file in old[1:]:
        file.unlink()
    shutil.copy(new, old[0])
    for crc in folder.glob(".*.crc"):
        crc.unlink()


@pytest.mark.parametrize("change", [lambda d: d.where("pos <> 2"), lambda d: d.withColumn("pos", -F.col("pos")), lambda d: d.withColumn("text", F.concat("text", F.lit("!"))).withColumn("sha256", F.sha2("text", 256))])
def test_a_changed_partition_is_refused_and_only_where_it_is_read(spark, texts, tmp_path, change):
    path = f"file://{tmp_path}/snap"
    snapshot.publish(spark, path, texts, {"target": "t"}, 60)
    rewritten(spark, path, "train", change)
    with pytest.raises(ValueError, match="file: texts/train/"):
        snapshot.load_diagnostics(spark, path)
    other = f"file://{tmp_path}/whole"
    snapshot.publish(spark, other, texts, {"target": "t"}, 60)
    rewritten(spark, other, "test", change)
    assert snapshot.load_diagnostics(spark, other).count() == 8  # the sealed test texts are not opened
    with pytest.raises(ValueError, match="file: texts/test/"):
        snapshot.load(spark, other)


def test_rows_are_authenticated_beside_files(spark, texts, tmp_path):
    path = f"file://{tmp_path}/snap"
    manifest = snapshot.publish(spark, path, texts, {"target": "t"}, 60)
    rewritten(spark, path, "train", lambda d: d.where("pos <> 2"))
    digests = spark.createDataFrame(snapshot.file_digests(spark, path, "texts", snapshot.PARTITIONS).collect(), snapshot.DIGESTS)
    digests.write.mode("overwrite").parquet(f"{path}/digests")
    with pytest.raises(ValueError, match="digests: texts/train"):
        snapshot.load_diagnostics(spark, path)
    forged = {k: v for k, v in manifest.items() if k != "snapshot_sha256"} | {"files": snapshot.digest_totals(digests)}
    snapshot.write_json(spark, f"{path}/manifest.json", forged | {"snapshot_sha256": snapshot.canonical_hash(forged)})
    with pytest.raises(ValueError, match="statistics"):
        snapshot.load_diagnostics(spark, path)


def test_recorded_names_are_checked(spark, texts, tmp_path, monkeypatch):
    own = texts.where("partition <> 'general'")
    meta = own.select("partition", "pos", F.sha2("text", 256).alias("sha256"), F.concat("partition", F.lit("/"), "partition", "pos").alias("repo"), F.concat("partition", "pos").alias("family"))
    path = f"file://{tmp_path}/snap"
    manifest = snapshot.publish(spark, path, texts, {"target": "t"}, 60, meta)
    assert manifest["names"]["train"] == {"repositories": 4, "families": 4} and snapshot.load(spark, path)[1] == manifest
    wrong = {k: v for k, v in manifest.items() if k != "snapshot_sha256"} | {"names": manifest["names"] | {"test": {"repositories": 3, "families": 4}}}
    snapshot.write_json(spark, f"{path}/manifest.json", wrong | {"snapshot_sha256": snapshot.canonical_hash(wrong)})
    with pytest.raises(ValueError, match="counts: test"):
        snapshot.load(spark, path)


def test_a_tree_of_hashes_tells_every_change(spark):
    from loomtally.operators.audit import tree_hash

    rows = [("a", i, f"t{i}") for i in range(50)] + [("b", 5_000_000_000, "x")]
    root = lambda some: {r[0]: r[1] for r in tree_hash(spark.createDataFrame(some, "p string, pos long, text string"), "p", leaf=4).collect()}
    whole = root(rows)
    assert root(rows[::-1]) == whole
    for other in (rows[:7] + rows[8:], [("a", 50, "t0"), *rows[1:]], [("a", 0, "t1"), ("a", 1, "t0"), *rows[2:]]):
        assert root(other)["a"] != whole["a"] and root(other)["b"] == whole["b"]


def test_publish_refuses_overlap_and_short_budgets(spark, texts, tmp_path):
    shared = texts.unionByName(texts.where("partition = 'train' and pos = 0").withColumn("partition", F.lit("test")).withColumn("pos", F.lit(9).cast("long")))
    with pytest.raises(ValueError):
        snapshot.publish(spark, f"file://{tmp_path}/a", shared, {}, 60)
    with pytest.raises(ValueError):
        snapshot.publish(spark, f"file://{tmp_path}/b", texts, {}, 10_000)
    assert not snapshot.exists(spark, f"file://{tmp_path}/a")


def test_gzip_lines_keep_their_numbers(spark, tmp_path):
    for name, n in (("f1", 3), ("f2", 2)):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            f.writelines(json.dumps({"content": f"{name} {i}", "path": "a.py"}, ensure_ascii=False) + "\n" for i in range(n))
    rows = corpora.jsonl_shards(spark, [f"file://{tmp_path}/*.json.gz"], "content string, path string, license string").collect()
    assert sorted((r["source_shard"], r["source_line"], r["content"]) for r in rows) == [(f"{s}.json.gz", i + 1, f"{s} {i}") for s, n in (("f1", 3), ("f2", 2)) for i in range(n)]


def test_named_corpus_and_stream(spark, tmp_path):
    path = f"file://{tmp_path}/c.parquet"
    spark.createDataFrame([(i, "x" * (40 + i)) for i in range(30)], "n long, text string").write.parquet(path)
    corpora.register("c", corpora.Corpus(path, order="n"))
    assert [r["pos"] for r in corpora.load_corpus(spark, "c", 5).orderBy("pos").collect()] == [10, 11, 12, 13, 14]
    with pytest.raises(KeyError):
        corpora.load_corpus(spark, "none")
    stream = ingest.append_stream(ingest.arriving_texts(spark, path, "n long, text string"), f"{tmp_path}/out", f"{tmp_path}/ck")
    stream.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20


RUN = "struct<status:string,metrics_sha256:string,history:array<struct<step:bigint,validation:struct<utf8_bytes:bigint,nll_nats:double,documents:array<bigint>,source_documents:array<struct<utf8_bytes:bigint,nll_nats:double>>>>>>"


def test_evidence_leaves_blocks_out_and_checks_totals(spark):
    step = lambda n, cost: {"step": n, "validation": {"utf8_bytes": 30, "nll_nats": cost, "documents": [1, 2], "source_documents": [{"utf8_bytes": 10, "nll_nats": 4.5}, {"utf8_bytes": 20, "nll_nats": 5.0}]}}
    table = lambda *steps: spark.createDataFrame([(json.dumps({"status": "complete", "metrics_sha256": "m", "history": steps}),)], "j string").select(F.from_json("j", RUN).alias("r")).select("r.*")
    row = snapshot.evidence(table(step(0, 9.5), step(8, 9.5))).first()
    assert row["evidence_export"]["original_metrics_sha256"] == "m" and [h["step"] for h in row["history"]] == [0, 8]
    assert all("documents" not in h["validation"].asDict() for h in row["history"])
    with pytest.raises(ValueError, match="nll_nats total: m@8"):
        snapshot.evidence(table(step(0, 9.5), step(8, 9.6)))


def test_metrics_come_before_evidence_and_attempts_are_logged(spark, tmp_path):
    (tmp_path / "r").mkdir()
    at = f"file://{tmp_path}"
    snapshot.write_json(spark, f"{at}/r/evidence.json", {"status": "complete", "from": "evidence"})
    assert [r["from"] for r in snapshot.newest_runs(spark, at)] == ["evidence"]
    snapshot.write_json(spark, f"{at}/r/metrics.json", {"status": "failed"})
    assert snapshot.newest_runs(spark, at) == []
    snapshot.write_json(spark, f"{at}/r/metrics.json", {"status": "complete", "from": "metrics"})  # renamed over
    assert [r["from"] for r in snapshot.newest_runs(spark, at)] == ["metrics"]
    with pytest.raises(ValueError):
        snapshot.write_json(spark, f"{at}/x.json", {"n": float("nan")})
    snapshot.append_attempt(spark, f"{at}/log", "failed", error="e")
    assert json.loads(spark.read.text(f"{at}/log").first()[0])["status"] == "failed"


def test_a_column_of_parquet_without_short_texts(spark, tmp_path):
    spark.createDataFrame([("  short  ", 1), ("x" * 60, 2), (None, 3), (" " * 80, 4)], "body string, n long").write.parquet(f"{tmp_path}/column")
    assert [r["text"] for r in corpora.text_column(spark, f"file://{tmp_path}/column", "body").collect()] == ["x" * 60]
    assert sorted(len(r["text"]) for r in corpora.text_column(spark, f"file://{tmp_path}/column", "body", 3).collect()) == [9, 60]


def test_a_corpus_opens_no_more_files_than_it_needs(spark, tmp_path):
    import pathlib
    import re

    for part in range(8):
        spark.createDataFrame([(part * 10 + i, f"text {part * 10 + i} " + "word " * 20) for i in range(10)], "n long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/c")
    corpora.register("files", corpora.Corpus(f"file://{tmp_path}/c", order="n"))
    from loomtally.operators import early

    files = early.OrderedFiles.of(spark, f"file://{tmp_path}/c", "n")
    real = early.OrderedFiles.of
    early.OrderedFiles.of = classmethod(lambda cls, *a: files)  # the catalog as it was
    try:
        for _, file in files.files[4:]:
            local = pathlib.Path(re.sub("^file:/+", "/", file))
            local.write_bytes(b"spoiled")
            (local.parent / f".{local.name}.crc").unlink(missing_ok=True)
        assert [r["pos"] for r in corpora.load_corpus(spark, "files", 25).orderBy("pos").collect()] == list(range(25))
    finally:
        early.OrderedFiles.of = real
