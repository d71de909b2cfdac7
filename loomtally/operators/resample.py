"""Bootstrap intervals of many comparisons by one plan.

Units (documents or groups) are numbered within their comparison and lie in blocks of
BLOCK_UNITS. A task takes a block for a range of replicates, makes the replicates' draws
into that block and adds the drawn units up for every comparison of that many units: a
row leaves it for each comparison and replicate, none for a draw. How many of a replicate's
draws fall into each block is drawn first, jointly for all blocks (multinomially by their
sizes), so blocks need not know each other's draws.

Draw s of replicate r in block b is the unit md5('seed|r|s')[:8] modulo the block's size in
the first block, and md5('seed|r|b|s')[:8] in the others; with one block SQL can do the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.session import durable

LN2 = math.log(2)
#: Units of a block. Which draws are made depends on it, as on the seed.
BLOCK_UNITS = 1 << 16


def block_draws(units: int, block_units: int, replicate: int, seed: int) -> np.ndarray:
    """How many of a replicate's draws fall into each block."""
    blocks = -(-units // block_units)
    if blocks == 1:
        return np.array([units])
    sizes = np.full(blocks, block_units, dtype=np.float64)
    sizes[-1] = units - (blocks - 1) * block_units
    return np.random.default_rng([seed, replicate]).multinomial(units, sizes / units)


def draws(count: int, size: int, block: int, replicate: int, seed: int) -> np.ndarray:
    """The drawn units of a block, by their places in it."""
    lead = f"{seed}|{replicate}|{block}|" if block else f"{seed}|{replicate}|"
    md5 = hashlib.md5
    return np.fromiter((int(md5(f"{lead}{s}".encode()).hexdigest()[:8], 16) for s in range(count)), dtype=np.int64, count=count) % size


def bootstraps(units: DataFrame, replicates: int, seed: int, by: Sequence[str] = (), block_units: int | None = None) -> DataFrame:
    """by, low, high, units: 2.5 and 97.5 percentiles of the ratio of resampled sums in bits per
    byte, for each comparison (its columns `by`). units: by, unit (0, 1, ... without gaps), delta,
    utf8_bytes. Comparisons of equal numbers of units share their draws."""
    size = block_units or BLOCK_UNITS
    units = durable(units.select(*by, "unit", F.col("delta").cast("double"), F.col("utf8_bytes").cast("double")), "resampled-units")
    sizes = durable(units.groupBy(*by).agg(F.count(F.lit(1)).alias("units")), "comparison-sizes")
    # few blocks are taken for ranges of replicates, so that the cores have work
    blocks = max(1, -(-(sizes.agg(F.max("units")).first()[0] or 0) // size))
    ranges = max(1, min(replicates, 4 * units.sparkSession.sparkContext.defaultParallelism // blocks))
    step = -(-replicates // ranges)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    named = units.join(sizes.select(*[F.col(c).alias(f"_{c}") for c in by], "units"), same)
    place = F.struct((F.col("unit") % size).alias("at"), "delta", "utf8_bytes")
    # a row for each comparison and block: at most `size` units
    gathered = named.groupBy(*by, "units", F.expr(f"unit div {size}").alias("block")).agg(F.array_sort(F.collect_list(place)).alias("_of"))
    rows = gathered.select(*by, "units", "block", F.col("_of.delta").alias("delta"), F.col("_of.utf8_bytes").alias("utf8_bytes"), F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("part"))

    def tally(table: pa.Table) -> pa.Table:
        n, block, part = (table.column(c)[0].as_py() for c in ("units", "block", "part"))
        delta, utf8_bytes = (np.array(table.column(c).to_pylist(), dtype=np.float64) for c in ("delta", "utf8_bytes"))  # comparisons x units
        mine = range(part * step, min(replicates, (part + 1) * step))
        times = np.zeros((delta.shape[1], len(mine)))
        for i, r in enumerate(mine):
            times[:, i] = np.bincount(draws(int(block_draws(n, size, r, seed)[block]), delta.shape[1], block, r, seed), minlength=delta.shape[1])
        out = table.select([*by, "units"]).take(pa.array(np.repeat(np.arange(table.num_rows), len(mine))))
        for name, column in (("r", np.tile(np.array(mine, dtype=np.int32), table.num_rows)), ("delta", (delta @ times).ravel()), ("utf8_bytes", (utf8_bytes @ times).ravel())):
            out = out.append_column(name, pa.array(column))
        return out

    kinds = "".join(f"`{c}` {units.schema[c].dataType.simpleString()}, " for c in by)
    sums = rows.groupBy("units", "block", "part").applyInArrow(tally, f"{kinds}units long, r int, delta double, utf8_bytes double")
    values = sums.groupBy(*by, "units", "r").agg((F.sum("delta") / F.sum("utf8_bytes") / LN2).alias("v"))
    found = values.groupBy(*by).agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"), F.max("units").alias("units"))
    return found.withColumn("units", F.coalesce("units", F.lit(0).cast("long")))
