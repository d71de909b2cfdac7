"""Integrity audits: each gives rows (audit, key, detail) and holds where there are none."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.functions.codes import file_digest
from loomtally.functions.text import casefold, is_blank, normalized, repository_family, text_sha256
from loomtally.operators.select import character_prefix

AUDIT = "audit string, key string, detail string"


def finding(df: DataFrame, audit: str, key, detail) -> DataFrame:
    return df.select(F.lit(audit).alias("audit"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def require_none(found: DataFrame) -> None:
    if rows := found.limit(5).collect():
        raise ValueError("; ".join(f"{r['audit']}: {r['key']} ({r['detail']})" for r in rows))


def partition_stats(docs: DataFrame, by: str) -> DataFrame:
    """documents, characters, utf8_bytes of each partition."""
    return docs.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("characters"), F.sum(F.octet_length("text")).alias("utf8_bytes"))


def ordered_hash(docs: DataFrame, by: str) -> DataFrame:
    """by, ordered_text_sha256: SHA-256 of the JSON list of the texts' hashes in order of pos.
    The hashes of a partition stream through one sorted task in constant memory (a hash of a
    sequence can't be folded in parts)."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state, some = None, None, False
        for batch in batches:
            for part, sha in zip(batch["_by"].tolist(), batch["_sha"].tolist(), strict=True):
                if state is None or part != name:
                    if state is not None:
                        yield close(name, state)
                    name, state, some = part, hashlib.sha256(b"["), False
                state.update((b"," if some else b"") + b'"' + sha.encode() + b'"')
                some = True
        if state is not None:
            yield close(name, state)

    def close(name: str, state) -> pd.DataFrame:
        state.update(b"]")
        return pd.DataFrame({by: [name], "ordered_text_sha256": [state.hexdigest()]})

    slim = docs.select(F.col(by).alias("_by"), "pos", text_sha256(F.col("text")).alias("_sha"))
    return slim.repartition("_by").sortWithinPartitions("_by", "pos").select("_by", "_sha").mapInPandas(fold, f"{by} string, ordered_text_sha256 string")


def tree_hash(docs: DataFrame, by: str, leaf: int = 1024, levels: int = 4) -> DataFrame:
    """by, tree_sha256: the root of a tree of SHA-256 over the texts in order of pos, which many
    tasks fold. A leaf takes the positions pos div leaf and hashes `pos:hash of the text` of its
    rows, joined by commas; a node takes `leaf` children and hashes their `number:hash`; the
    root takes what is left after `levels`, one child for each leaf ** levels positions."""
    number = lambda c: F.expr(f"floor({c} / {leaf})")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_h"))), lambda x: F.concat(x["_at"].cast("string"), F.lit(":"), x["_h"])), ",")
    nodes = docs.select(by, F.col("pos").cast("long").alias("_at"), text_sha256(F.col("text")).alias("_h"))
    for _ in range(levels - 1):
        nodes = nodes.groupBy(by, number("_at").alias("_up")).agg(F.sha2(joined, 256).alias("_h")).select(by, F.col("_up").alias("_at"), "_h")
    return nodes.groupBy(by).agg(F.sha2(joined, 256).alias("tree_sha256"))


def overlaps(docs: DataFrame, by: str) -> DataFrame:
    """Texts that stand in more than one partition: (first, second, texts) for each pair of
    partitions; a text is one row a partition, however often it is repeated."""
    seen = docs.select(F.col(by).alias("p"), text_sha256(F.col("text")).alias("sha")).distinct()
    sets = seen.groupBy("sha").agg(F.array_sort(F.collect_set("p")).alias("ps")).where(F.size("ps") > 1)  # as long as there are partitions
    pairs = F.flatten(F.transform("ps", lambda a: F.transform(F.filter("ps", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return sets.select(F.explode(pairs).alias("x")).groupBy("x.first", "x.second").agg(F.count(F.lit(1)).alias("texts"))


def checksum_audit(docs: DataFrame) -> DataFrame:
    """Documents (pos, text, sha256) whose hash is not their text's."""
    return finding(docs.where(~text_sha256(F.col("text")).eqNullSafe(F.col("sha256"))), "checksum", F.col("pos"), F.col("sha256"))


def partition_audit(docs: DataFrame, by: str, names: list[str]) -> DataFrame:
    """Empty partitions, texts repeated within one, texts in two."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "p string")
    have = docs.select(F.col(by).alias("p")).distinct()
    empty = finding(wanted.join(have, "p", "left_anti"), "empty", F.col("p"), F.lit("no documents"))
    twice = docs.groupBy(F.col(by).alias("p"), text_sha256(F.col("text")).alias("sha")).count().where("count > 1")
    cross = overlaps(docs.where(F.col(by).isin(*names)), by)
    return empty.unionByName(finding(twice, "repeated", F.col("p"), F.col("sha"))).unionByName(finding(cross, "overlap", F.concat_ws("/", "first", "second"), F.col("texts")))


def family_audit(metadata: DataFrame, by: str) -> DataFrame:
    """Families or repositories (case folded) in two partitions, and missing identities."""
    out = finding(metadata.where("family is null or family = '' or repo is null or repo = ''"), "missing identity", F.col(by), F.col("pos"))
    for column in ("family", "repo"):
        shared = metadata.groupBy(casefold(F.col(column)).alias("k")).agg(F.count_distinct(by).alias("n")).where("n > 1 and k is not null")
        out = out.unionByName(finding(shared, f"{column} overlap", F.col("k"), F.col("n")))
    return out


def totals_audit(total: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of a one-row total that are not the sum over parts (relative 1e-12, absolute 1e-8)."""
    got, want = parts.agg(*[F.sum(k).alias(k) for k in keys]).first(), total.first()
    bad = [("totals", k, f"{want[k]} is not {got[k]}") for k in keys if abs(want[k] - (got[k] or 0)) > max(1e-12 * max(abs(want[k]), abs(got[k] or 0)), 1e-8)]
    return total.sparkSession.createDataFrame(bad, AUDIT)


def blank_audit(docs: DataFrame) -> DataFrame:
    """Documents (pos, text) whose text is missing or holds white space only."""
    return finding(docs.where(is_blank(F.col("text"))), "blank", F.col("pos"), F.coalesce(F.length("text").cast("string"), F.lit("null")))


def distinct_counts(metadata: DataFrame, by: str) -> DataFrame:
    """by, repositories, families: distinct names, repositories without regard to case; exact."""
    return metadata.groupBy(by).agg(F.count_distinct(casefold(F.col("repo"))).alias("repositories"), F.count_distinct("family").alias("families"))


def metadata_counts_audit(metadata: DataFrame, by: str, recorded: dict[str, dict[str, int]]) -> DataFrame:
    """Recorded counts (partition: repositories, families) that the metadata does not give."""
    got = {r[by]: {k: r[k] for k in ("repositories", "families")} for r in distinct_counts(metadata, by).collect()}  # a row for each partition
    bad = [("counts", p, f"recorded {recorded.get(p)}, found {got.get(p)}") for p in sorted(recorded.keys() | got.keys()) if recorded.get(p) != got.get(p)]
    return metadata.sparkSession.createDataFrame(bad, AUDIT)


def scored_once_audit(targets: DataFrame, scored: DataFrame) -> DataFrame:
    """Documents whose targets (pos, n) are not scored just once each (scored: pos, scored_tokens;
    rows of a document are summed)."""
    sums = scored.groupBy(F.col("pos").alias("_p")).agg(F.sum("scored_tokens").alias("_s"))
    both = targets.join(sums, F.col("pos") == F.col("_p"), "full_outer")
    wrong = both.where(F.coalesce("n", F.lit(0)) != F.coalesce("_s", F.lit(0)))
    return finding(wrong, "scored once", F.coalesce("pos", "_p"), F.concat(F.coalesce("_s", F.lit(0)).cast("string"), F.lit(" of "), F.coalesce("n", F.lit(0)).cast("string")))


def disjoint_audit(training: DataFrame, full: DataFrame, metadata: DataFrame, references: DataFrame, budget: int) -> DataFrame:
    """What a tokenizer corpus shares with the language model's, or gets wrong.

    training, full (pos, text, sha256): the corpus as cut to `budget` characters and its whole
    sources; metadata (pos, repo, family, sha256, full_sha256); references (text, family)."""
    out = checksum_audit(training).unionByName(checksum_audit(full))
    wrong = metadata.where(~repository_family(F.col("repo")).eqNullSafe(F.col("family")))
    out = out.unionByName(finding(wrong, "family name", F.col("pos"), F.col("family")))
    taken = references.select(F.col("family").alias("_f")).distinct()
    out = out.unionByName(finding(metadata.join(taken, F.col("family") == F.col("_f")), "family overlap", F.col("pos"), F.col("family")))
    # by normalized text: equal texts are among them
    old = references.select(text_sha256(normalized(F.col("text"))).alias("_n")).distinct()
    same = full.withColumn("_own", text_sha256(normalized(F.col("text")))).join(old, F.col("_own") == F.col("_n"))
    out = out.unionByName(finding(same, "text overlap", F.col("pos"), F.col("sha256")))
    named = lambda d, name, has: d.select(F.col("pos").alias(f"_{name}"), F.col("sha256").alias(has))
    sides = metadata.join(named(training, "t", "_ts"), F.col("pos") == F.col("_t"), "full_outer").join(named(full, "u", "_us"), F.coalesce("pos", "_t") == F.col("_u"), "full_outer")
    apart = sides.where(~F.col("sha256").eqNullSafe(F.col("_ts")) | ~F.col("full_sha256").eqNullSafe(F.col("_us")))
    out = out.unionByName(finding(apart, "alignment", F.coalesce("pos", "_t", "_u"), F.lit("texts and metadata")))
    want = character_prefix(full.select("pos", "text"), budget, strict=False).select(F.col("pos").alias("_w"), text_sha256(F.col("text")).alias("_ws"))
    cut = training.select("pos", "sha256").join(want, F.col("pos") == F.col("_w"), "full_outer").where(~F.col("sha256").eqNullSafe(F.col("_ws")))
    return out.unionByName(finding(cut, "prefix", F.coalesce("pos", "_w"), F.lit(f"not the first {budget} characters")))


def tokenizer_pair_audit(spark: SparkSession, folder: str, manifest: dict[str, Any], snapshot_manifest: str, vocabulary_size: Callable[[str], int]) -> DataFrame:
    """What a pair of tokenizer files (fit.json, general.json of a folder) does not share with its
    manifest or with each other. vocabulary_size: of a tokenizer file."""
    facts = [("snapshot", manifest.get("snapshot_sha256"), file_digest(spark, snapshot_manifest)), ("budgets", *[manifest[a].get("training_chars") for a in ("fit", "general")])]
    for arm in ("fit", "general"):
        file = f"{folder}/{arm}.json"
        facts += [(f"{arm} file", manifest[arm].get("sha256"), file_digest(spark, file)), (f"{arm} vocabulary", manifest.get("vocab_size"), vocabulary_size(file))]
    return spark.createDataFrame([("tokenizer", what, f"{a} is not {b}") for what, a, b in facts if a != b or a is None], AUDIT)
