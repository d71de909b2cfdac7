"""Readers for Parquet tables that lie beside each other in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder; one file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan for costly stages: dealt anew where it has fewer parts than the session has cores (one
    small file is one part); larger tables are read as they lie and not shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
