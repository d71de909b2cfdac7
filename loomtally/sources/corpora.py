"""Sources of texts: named corpora, gzip JSON-lines shards, one column of Parquet."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.functions.text import stripped_length
from loomtally.operators.early import OrderedFiles
from loomtally.operators.ordered import running_before
from loomtally.session import durable


@dataclass(frozen=True)
class Corpus:
    """Where a named corpus lies. order: a column that gives its rows' order."""

    path: str
    format: str = "parquet"
    text_column: str = "text"
    order: str | None = None


REGISTRY: dict[str, Corpus] = {}


def register(name: str, corpus: Corpus) -> None:
    REGISTRY[name] = corpus


def load_corpus(spark: SparkSession, name: str, max_samples: int | None = None, min_chars: int = 50) -> DataFrame:
    """pos, text of a corpus: texts with at least min_chars code points between white space at
    their ends, the first max_samples. Without an order column pos only tells rows apart."""
    spec = REGISTRY.get(name)
    if spec is None:
        raise KeyError(f"no corpus is registered as {name!r}")
    pos = F.col(spec.order).cast("long") if spec.order else F.monotonically_increasing_id()
    shape = lambda rows: rows.select(pos.alias("pos"), F.col(spec.text_column).alias("text")).where(stripped_length(F.col("text")) >= min_chars)
    if max_samples is None:
        return shape(spark.read.format(spec.format).load(spec.path))
    texts = None
    if spec.order and spec.format == "parquet":  # files in order, no more than are needed
        for rows, last in OrderedFiles.of(spark, spec.path, spec.order).prefixes():
            texts = shape(rows)
            if last or texts.limit(max_samples).count() == max_samples:
                break
    else:
        texts = shape(spark.read.format(spec.format).load(spec.path))
    ranked = running_before(durable(texts.withColumn("_one", F.lit(1)), "corpus"), "_one", ["pos"], out="_before")
    return ranked.where(F.col("_before") < max_samples).drop("_before", "_one")


def jsonl_shards(spark: SparkSession, paths: list[str], fields: str) -> DataFrame:
    """Rows of gzip JSON-lines files with source_shard (file name) and source_line (from 1).

    A gzip file is one task, read as a stream of lines that end at a line feed alone, so other
    line separators within texts do no harm and a file may be larger than a worker's memory."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, line = None, 0
        for batch in batches:
            lines = np.empty(len(batch), dtype=np.int64)
            for i, path in enumerate(batch["_path"].tolist()):
                line = line + 1 if path == at else 1
                at, lines[i] = path, line
            yield pd.DataFrame({"value": batch["value"], "source_shard": batch["_path"], "source_line": lines})

    read = spark.read.option("lineSep", "\n").text(paths).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_path"))
    rows = read.mapInPandas(number, "value string, source_shard string, source_line long")
    return rows.select(F.from_json("value", fields).alias("_r"), "source_shard", "source_line").select("_r.*", "source_shard", "source_line")


def text_column(spark: SparkSession, path: str, column: str = "text", min_chars: int = 50) -> DataFrame:
    """One column of Parquet, short texts left out."""
    return spark.read.parquet(path).select(F.col(column).alias("text")).where(stripped_length(F.col("text")) >= min_chars)
