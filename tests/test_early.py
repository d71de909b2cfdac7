"""Early-stopping scans open no more files than they need, and give what a whole scan gives."""

from __future__ import annotations

import pathlib
import re

import pytest
from loomtally.operators import early, select
from pyspark.sql import functions as F


@pytest.fixture()
def table_of_files(spark, tmp_path):
    path = tmp_path / "rows"
    for part in range(16):  # 20 rows a file; two files lie within each other
        low = 20 * part - (5 if part == 3 else 0)
        rows = [(i, f"row {i} " + "word " * 60, "s") for i in range(low, low + 20 + (5 if part == 3 else 0)) if part == 3 or not 55 <= i < 60]
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(str(path))
    return path


def shape(rows):
    return rows.select(F.col("doc_id").alias("pos"), "text", F.lit("a.py").alias("path"), F.col("source").alias("family"))


def spoil_all_but(spark, path, order, count):
    """Files behind the first `count` in order are no Parquet any more."""
    files = early.OrderedFiles.of(spark, str(path), order)
    for _, file in files.files[count:]:
        local = pathlib.Path(re.sub("^file:/+", "/", file))
        local.write_bytes(b"spoiled")
        crc = local.parent / f".{local.name}.crc"
        crc.unlink(missing_ok=True)
    return files


@pytest.mark.parametrize("docs,opened", [(15, 2), (40, 4), (70, 8)])
def test_scans_open_twice_the_needed_files_at_most(spark, table_of_files, docs, opened):
    whole = spark.read.parquet(str(table_of_files))
    want = sorted(tuple(r) for r in select.scan_until(select.file_reasons(shape(whole)), docs, 1000).collect())
    files = spoil_all_but(spark, table_of_files, "doc_id", opened)
    assert sorted(tuple(r) for r in early.scan_files(files, shape, docs, 1000).collect()) == want


def test_scans_judge_each_row_once(spark, table_of_files, monkeypatch):
    judged = []
    judge = early.judge
    monkeypatch.setattr(early, "judge", lambda rows, checks: judged.append([r[0] for r in rows.select("pos").collect()]) or judge(rows, checks))
    files = early.OrderedFiles.of(spark, str(table_of_files), "doc_id")
    got = {r["pos"] for r in early.scan_files(files, shape, 70, 1000).collect()}
    seen = [pos for part in judged for pos in part]
    assert len(judged) > 2 and len(seen) == len(set(seen)) and got <= set(seen)


@pytest.mark.parametrize("whole", [True, False])
def test_characters_stop_early(spark, table_of_files, whole):
    rows = shape(spark.read.parquet(str(table_of_files)))
    budget = 310 * 25
    want = sorted(tuple(r) for r in (select.until_characters if whole else select.character_prefix)(rows.select("pos", "text"), budget).collect())
    files = spoil_all_but(spark, table_of_files, "doc_id", 4)
    got = early.first_characters(files, lambda r: shape(r).select("pos", "text"), budget, whole)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_too_little_raises_and_scans_stop_at_their_limit(spark, table_of_files):
    files = early.OrderedFiles.of(spark, str(table_of_files), "doc_id")
    with pytest.raises(select.TooFew):
        early.scan_files(files, shape, 10_000)
    spoil_all_but(spark, table_of_files, "doc_id", 2)
    with pytest.raises(ValueError, match="acceptable"):
        early.scan_files(files, shape, 10_000, 10)


def test_a_catalog_is_kept(spark, table_of_files, tmp_path):
    first = early.OrderedFiles.of(spark, str(table_of_files), "doc_id", f"file://{tmp_path}/catalog")
    assert early.OrderedFiles.of(spark, str(table_of_files), "doc_id", f"file://{tmp_path}/catalog") == first and len(first.files) == 16
    empty = tmp_path / "empty"
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(empty))
    none = early.OrderedFiles.of(spark, str(empty), "doc_id")
    assert [(rows.count(), last) for rows, last in none.prefixes()] == [(0, True)]
