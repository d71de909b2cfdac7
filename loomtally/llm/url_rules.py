"""URL filters by a sort-merge range join.

A rule (host, path) fits its host and all subdomains where the URL's path starts
with the rule's path. With the key `reversed host labels | path` every rule is
an interval of keys: all that start with its own key. A URL asks with one key for
each suffix of its host (no more suffixes than the longest rule host has
labels). Keys are compared as hexadecimal text, so that `key + "G"` closes an
interval exactly, whatever the characters.

Rules' starts and ends and the URLs' keys are sorted together and swept once.
The running sum of starts and ends is the depth of the stack of active rules,
and the top of the stack is the latest start at that depth. The sweep is dealt
by a hash of the page, each part with its own copy of the rules' events, so no
host or path can make one task large. All of it is DataFrame functions.

Defined results: a null URL or one without `://` has empty host and path and no
rule; of equal rules block wins; rows that repeat are judged each; where no rule
fits the verdict is `default`; columns of other names in the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hex_key(labels: Column, path: Column) -> Column:
    return F.hex(F.encode(F.concat(F.array_join(F.reverse(labels), "."), F.lit("|"), path), "UTF-8"))


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rules as a DataFrame."""
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", parts: int | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: key, host, path, rule (`host + path` or null), verdict."""
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean = (
        rules.where("rule_host is not null and rule_host <> '' and rule_path is not null")
        .withColumn("rule_host", F.translate("rule_host", UPPER, LOWER))
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))  # block > allow
    )
    deepest = clean.select(F.max(F.size(F.split("rule_host", r"\."))).alias("n")).first()["n"] or 1

    seen = pages.select(
        F.col(key).alias("_key"), url_host(F.col(url)).alias("_host"), url_path(F.col(url)).alias("_path")
    )
    labels = F.split("_host", r"\.")
    levels = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest)))
    asks = (
        seen.withColumn("_labels", labels)
        .withColumn("_level", F.explode(levels))
        .select(
            F.pmod(F.xxhash64("_key", "_host", "_path"), F.lit(parts)).cast("int").alias("_part"),
            _hex_key(F.slice("_labels", F.size("_labels") - F.col("_level") + 1, F.col("_level")), F.col("_path")).alias("_at"),
            F.lit(1).alias("_kind"),
            F.lit(0).alias("_step"),
            F.lit(None).cast("struct<length:int,hosts:int,rule:string,verdict:string>").alias("_rule"),
            "_key", "_host", "_path", "_level",
        )
    )
    start = _hex_key(F.split("rule_host", r"\."), F.col("rule_path"))
    rule = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("length"),
        F.length("rule_host").alias("hosts"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    ends = (
        clean.select(start.alias("_start"), rule.alias("_rule"))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        .withColumn("_e", F.explode(F.array(F.lit(1), F.lit(-1))))
        .select(
            "_part",
            F.when(F.col("_e") == 1, F.col("_start")).otherwise(F.concat("_start", F.lit("G"))).alias("_at"),
            F.when(F.col("_e") == 1, F.lit(0)).otherwise(F.lit(2)).alias("_kind"),
            F.col("_e").alias("_step"),
            F.when(F.col("_e") == 1, F.col("_rule")).alias("_rule"),
            F.lit(None).cast(asks.schema["_key"].dataType).alias("_key"),
            F.lit(None).cast("string").alias("_host"),
            F.lit(None).cast("string").alias("_path"),
            F.lit(0).alias("_level"),
        )
    )
    sweep = Window.partitionBy("_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("_part", "_depth").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        asks.unionByName(ends)
        .withColumn("_depth", F.sum("_step").over(sweep))
        .withColumn("_top", F.when(F.col("_depth") > 0, F.last(F.when(F.col("_kind") == 0, F.col("_rule")), ignorenulls=True).over(level)))
        .where("_kind = 1")
    )
    best = (
        swept.groupBy("_part", "_key", "_host", "_path")  # a page's suffixes share its part
        .agg(F.max("_top").alias("_best"), F.sum(F.when(F.col("_level") == 1, 1).otherwise(0)).alias("_rows"))
        .withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    )
    return best.select(
        F.col("_key").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"),
    )
