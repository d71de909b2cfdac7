"""Scans in order that stop early: files are read in growing slices until a budget is met.

A catalog holds the least and the greatest key of each Parquet file (one narrow scan of the
key column, kept as a small table beside the files or made on the spot). Files are taken in
order of their least keys, 1, 2, 4, ... of them; rows below the next file's least key are then
complete, whatever the files' ranges do, and the scan is tried on them. It reads at most
twice the files that it needs, and the others are not opened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.operators.select import FILE_COPIES, TooFew, character_prefix, file_checks, judge, reasons_of, scan_until, until_characters
from loomtally.session import durable
from loomtally.sources.snapshot import exists


@dataclass(frozen=True)
class OrderedFiles:
    """files: (least key, file) in order, of files that hold any row."""

    spark: SparkSession
    schema: object
    order: str
    files: tuple[tuple[int, str], ...]

    @classmethod
    def of(cls, spark: SparkSession, path: str, order: str, catalog: str | None = None) -> OrderedFiles:
        """The Parquet files of a path. catalog: a table of their least and greatest keys, which is
        written if it is not there; it holds for files that never change."""
        rows = spark.read.parquet(path)
        if catalog is None or not exists(spark, catalog):
            made = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(order).cast("long").alias("least"), F.max(order).cast("long").alias("greatest"))
            if catalog is not None:
                made.write.parquet(catalog)
        found = made if catalog is None else spark.read.parquet(catalog)
        listed = found.where("least IS NOT NULL").orderBy("least", "file").select("least", "file").collect()  # a row a file, as the driver lists them anyway
        return cls(spark, rows.schema, order, tuple((r["least"], r["file"]) for r in listed))

    def _read(self, first: int, end: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f for _, f in self.files[first:end]]) if self.files else self.spark.createDataFrame([], self.schema)

    def slices(self, first: int = 1) -> Iterator[tuple[DataFrame, int | None]]:
        """(rows of the next files, the key below which all rows of these and earlier files are
        complete, None behind the last file): 1, 1, 2, 4, ... files. Slices of
        few parts are dealt anew, as one row group is one task's."""
        cores = self.spark.sparkContext.defaultParallelism
        done, count = 0, first
        while True:
            end = min(count, len(self.files))
            rows = self._read(done, end)
            yield rows.repartition(cores) if rows.rdd.getNumPartitions() < 2 * cores else rows, self.files[end][0] if end < len(self.files) else None
            if end == len(self.files):
                return
            done, count = end, 2 * count

    def prefixes(self, first: int = 1) -> Iterator[tuple[DataFrame, bool]]:
        """(all rows up to a key, whether these are all rows), more and more of them."""
        count = first
        while count < len(self.files):
            bound = self.files[count][0]
            if bound > self.files[0][0]:
                yield self._read(0, count).where(F.col(self.order) < bound), False
            count *= 2
        yield self._read(0, len(self.files)), True

    def until(self, attempt: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """attempt(rows) of the fewest rows for which it does not raise TooFew."""
        for rows, last in self.prefixes():
            try:
                return attempt(rows)
            except TooFew:
                if last:
                    raise
        raise AssertionError("the last prefix is the whole")


def scan_files(files: OrderedFiles, shape: Callable[[DataFrame], DataFrame], max_docs: int, max_scanned: int | None = None) -> DataFrame:
    """scan_until of the files' rows: pos, reason. shape makes rows of file_reasons of them, with the
    files' order as pos. Texts are read and judged once, whatever the slices: a slice adds
    its rows' identities to those of the slices before."""
    parts: list[DataFrame] = []
    for rows, bound in files.slices():
        parts.append(durable(judge(shape(rows), file_checks()), "judged"))
        known = reduce(DataFrame.unionByName, parts)
        if bound is not None:
            known = known.where(F.col("pos") < bound)
            found = known.count()
            if found < max_docs and (max_scanned is None or found < max_scanned):
                continue  # too few, whatever their reasons
        try:
            return scan_until(reasons_of(known, *FILE_COPIES), max_docs, max_scanned)
        except TooFew as short:
            if max_scanned is not None and known.limit(max_scanned).count() == max_scanned:
                raise ValueError(str(short)) from short  # more rows would not be read
            if bound is None:
                raise
    raise AssertionError("the last slice completes the whole")


def first_characters(files: OrderedFiles, shape: Callable[[DataFrame], DataFrame], budget: int, whole: bool = False) -> DataFrame:
    """character_prefix of the files' rows (shape gives pos, text), or with whole until_characters."""
    return files.until(lambda rows: (until_characters if whole else character_prefix)(shape(rows), budget))
