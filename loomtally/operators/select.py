"""Selection with a reason for each rejected row, and ordered budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.functions.text import normalized, text_sha256
from loomtally.operators.ordered import running_before
from loomtally.session import durable


def size_within(text: Column, least: int, most: int) -> Column:
    return F.coalesce(F.length(text).between(least, most), F.lit(False))


def python_path(path: Column) -> Column:
    return F.coalesce(F.lower(path).endswith(".py"), F.lit(False))


def judge(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """pos, _r, _sha, _norm: a row's first check that rejects it, or null, and its identities. It
    takes a row alone, so tables may be judged part by part."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        reason = F.when(bad, name).otherwise(reason)
    return rows.select("pos", reason.alias("_r"), text_sha256(F.col("text")).alias("_sha"), text_sha256(normalized(F.col("text"))).alias("_norm"))


def classify(rows: DataFrame, checks: list[tuple[str, Column]], exact: str, whitespace: str, taken: DataFrame | None = None) -> DataFrame:
    """pos, reason: the first of `checks` (name, rejected where true) that applies, else a
    duplicate of an earlier selected row, else `selected`.

    Of rows equal but for white space the first by pos is selected; a later one is an
    exact duplicate if it equals the selected row, else a white-space duplicate.
    taken (text): rows that count as selected before all others."""
    return reasons_of(durable(judge(rows, checks), "judged"), exact, whitespace, taken)


def reasons_of(judged: DataFrame, exact: str, whitespace: str, taken: DataFrame | None = None) -> DataFrame:
    """classify of rows that are judged (durable: they are read three times)."""
    fit = judged.where("_r is null")
    first = fit.groupBy("_norm").agg(F.min_by("_sha", "pos").alias("_first"), F.min("pos").alias("_at")).withColumnRenamed("_norm", "_n")
    known = fit.join(first, F.col("_norm") == F.col("_n"))
    if taken is not None:
        old = taken.select(text_sha256(F.col("text")).alias("_osha"), text_sha256(normalized(F.col("text"))).alias("_onorm")).distinct()
        known = known.join(old.select("_osha").distinct(), F.col("_sha") == F.col("_osha"), "left").join(old.select("_onorm").distinct(), F.col("_norm") == F.col("_onorm"), "left")
        is_exact, is_space = F.col("_osha").isNotNull(), F.col("_onorm").isNotNull()
        is_first = (F.col("pos") == F.col("_at")) & ~is_space & ~is_exact
        label = F.when(is_exact, exact).when(is_space, whitespace).when(is_first, "selected").when(F.col("_sha") == F.col("_first"), exact).otherwise(whitespace)
    else:
        label = F.when(F.col("pos") == F.col("_at"), "selected").when(F.col("_sha") == F.col("_first"), exact).otherwise(whitespace)
    return known.select("pos", label.alias("reason")).unionByName(judged.where("_r is not null").select("pos", F.col("_r").alias("reason")))


#: What file_reasons calls copies.
FILE_COPIES = "exact_duplicates", "whitespace_duplicates"


def file_checks(min_chars: int = 200, max_chars: int = 20_000) -> list[tuple[str, Column]]:
    return [("outside_size_bounds", ~size_within(F.col("text"), min_chars, max_chars)), ("non_python_path", ~python_path(F.col("path"))), ("missing_repository", F.col("family").isNull())]


def file_reasons(rows: DataFrame, min_chars: int = 200, max_chars: int = 20_000) -> DataFrame:
    """pos, reason for source files (pos, text, path, family): size, path, repository, duplicates."""
    return classify(rows, file_checks(min_chars, max_chars), *FILE_COPIES)


def candidate_reasons(rows: DataFrame, references: DataFrame, min_chars: int = 200, max_chars: int = 20_000) -> DataFrame:
    """pos, reason for candidates against references (text, family): repository, family,
    size, path, duplicates of references or earlier candidates."""
    families = references.select(F.col("family").alias("_f")).distinct()
    marked = rows.join(families, F.col("family") == F.col("_f"), "left")
    return classify(
        marked,
        [
            ("missing_repository", F.col("family").isNull()),
            ("excluded_reference_family", F.col("_f").isNotNull()),
            ("outside_size_bounds", ~size_within(F.col("text"), min_chars, max_chars)),
            ("non_python_path", ~python_path(F.col("path"))),
        ],
        "exact_duplicate",
        "whitespace_duplicate",
        references,
    )


class TooFew(ValueError):
    """The rows hold less than is asked for."""


def scan_until(reasons: DataFrame, max_docs: int | None = None, max_scanned: int | None = None) -> DataFrame:
    """The rows of pos, reason that a scan reads that stops once max_docs are selected or
    max_scanned are read. Raises if max_docs are not reached."""
    rows = durable(reasons.withColumn("_sel", (F.col("reason") == "selected").cast("long")).withColumn("_one", F.lit(1)), "reasons")
    seen = running_before(running_before(rows, "_one", ["pos"], out="_read"), "_sel", ["pos"], out="_got")
    if max_docs is not None:
        seen = seen.where(F.col("_got") < max_docs)
    if max_scanned is not None:
        seen = seen.where(F.col("_read") < max_scanned)
    out = seen.select("pos", "reason")
    if max_docs is not None and (got := out.where("reason = 'selected'").count()) < max_docs:
        raise TooFew(f"only {got} acceptable rows, {max_docs} asked for")
    return out


def until_characters(rows: DataFrame, budget: int) -> DataFrame:
    """Rows (pos, text) in order until their characters reach the budget, the last one whole."""
    sized = rows.withColumn("_chars", F.length("text").cast("long"))
    out = running_before(sized, "_chars", ["pos"], out="_before").where(F.col("_before") < budget).drop("_before")
    if (out.agg(F.sum("_chars")).first()[0] or 0) < budget:
        raise TooFew(f"fewer than {budget} characters")
    return out.drop("_chars")


def character_prefix(rows: DataFrame, budget: int, strict: bool = True) -> DataFrame:
    """Exactly `budget` code points of rows (pos, text) in order: whole texts, the last one
    cut, empty ones left out. Raises if the rows hold fewer."""
    if budget <= 0:
        raise ValueError("the budget must be positive")
    sized = rows.withColumn("_chars", F.length("text").cast("long"))
    if strict and (sized.agg(F.sum("_chars")).first()[0] or 0) < budget:
        raise TooFew(f"fewer than {budget} characters")
    return (
        running_before(sized, "_chars", ["pos"], out="_before")
        .where((F.col("_before") < budget) & (F.col("_chars") > 0))
        .withColumn("text", F.substring(F.col("text"), F.lit(1), F.least(F.col("_chars"), F.lit(budget) - F.col("_before")).cast("int")))
        .drop("_chars", "_before")
    )
