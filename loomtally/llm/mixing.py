"""Mixing sources to target weights.

Each source is a stream: its documents in ascending id, their words one after
another. The stream is packed into blocks of `block_words` words (the last block
may be short). A source's target in words becomes slots: whole passes over all
its blocks, and the rest of the target rounded to blocks. Every output shard draws
its number of slots of each source multinomially, given the source's total: the
slots of a source are halved down a binary tree of shards, each half a binomial
draw (the set bits of as many hash bits; from `EXACT` slots on its normal limit,
whose error is below a slot in a thousand). Slot j of a source is pass j div blocks,
and its block is the image of j mod blocks under the pass's pseudorandom permutation
(a swap-or-not shuffle, a bijection of any range without a table). Blocks are joined
by index. All of it is column functions, so no Python worker runs and nothing but
the number of all slots comes to the driver.

Defined results: a null or empty text has size 0; rows that repeat are documents
of their own; null sources form one source, last in order; an empty table gives an
empty mix. `taken` never exceeds passes x size, passes = `max_passes`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtally.operators.ordered import running_before
from loomtally.session import durable

WORD = r"[^\x20\x09-\x0D]+"
EXACT = 1 << 22


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_passes: int = 3) -> DataFrame:
    """Per source: source_no (code point order, null last), source_size, weight and
    target: shares of the total by weight, none above max_passes x its size, the
    excess reshared by weight. Sorted by cap/weight the capped sources come first,
    so the water level is found by running sums; the table has a row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = per.withColumn("source_no", (F.row_number().over(order) - 1).cast("int")).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1)
    )
    cap = (F.col("source_size") * max_passes).cast("double")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        numbered.withColumn("cap", cap)
        .withColumn("level", level)
        .withColumn("water", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source_no"), "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))))
        .select("source", "source_no", "source_size", "weight", "target")
    )


def _uniform(*key: Column) -> Column:
    """Between 0 and 1, from a hash of the key."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def halved(n: Column, *key: Column) -> Column:
    """Binomial(n, 1/2), drawn by a hash of the key."""
    words = (n / 64).cast("long")
    each = F.when(words > 0, F.sequence(F.lit(1).cast("long"), words)).otherwise(F.array().cast("array<bigint>"))
    whole = F.aggregate(each, F.lit(0).cast("long"), lambda a, i: a + F.bit_count(F.xxhash64(*key, i)))
    last = F.xxhash64(*key, F.lit(0).cast("long"))
    rest = F.when(n % 64 > 0, F.bit_count(F.call_function("shiftrightunsigned", last, (64 - n % 64).cast("int")))).otherwise(0)
    normal = F.sqrt(-2 * F.log(_uniform(*key, F.lit(1)))) * F.cos(F.lit(2 * math.pi) * _uniform(*key, F.lit(2)))
    wide = F.least(n, F.greatest(F.lit(0).cast("long"), F.round(n / 2 + normal * F.sqrt(n.cast("double")) / 2).cast("long")))
    return F.when(n <= EXACT, whole + rest).otherwise(wide).cast("long")


def round_keys(n: Column, *key: Column, rounds: int = 32) -> Column:
    """The keys of a permutation of range(n)."""
    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.pmod(F.xxhash64(*key, r), n))


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """The image of index in range(n). A round pairs x with k - x modulo n and swaps the two
    by a bit that both share."""

    def swap(x: Column, k: Column) -> Column:
        mate = F.pmod(k - x, n)
        return F.when(F.xxhash64(k, F.greatest(x, mate)).bitwiseAND(F.lit(1)) == 1, mate).otherwise(x)

    return F.aggregate(keys, index, swap)


def source_slots(targets: DataFrame, block_words: int) -> DataFrame:
    """source_no, blocks, slots of every source."""
    size, want = F.coalesce("source_size", F.lit(0)), F.coalesce("target", F.lit(0.0))
    passes = F.floor(want / size + F.lit(1e-9))
    return (
        targets.where(size > 0)
        .select("source_no", F.expr(f"(source_size + {block_words - 1}) div {block_words}").alias("blocks"), passes.alias("_passes"), F.rint((want - passes * size) / block_words).cast("long").alias("_rest"))
        .select("source_no", "blocks", (F.col("_passes") * F.col("blocks") + F.least("blocks", "_rest")).alias("slots"))
    )


def shard_draws(slots: DataFrame, levels: int, seed: int) -> DataFrame:
    """source_no, blocks, shard, first, count: the slots first, ..., first + count - 1 of a source
    that each of 2 ** levels shards draws. All shards together draw every slot once."""
    rows = slots.select("source_no", "blocks", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("first"), F.col("slots").alias("count")).where("count > 0")
    for level in range(levels):
        drawn = rows.withColumn("_left", halved(F.col("count"), F.lit(seed), F.col("source_no"), F.lit(level), F.col("shard")))
        left = F.struct((F.col("shard") * 2).alias("shard"), "first", F.col("_left").alias("count"))
        right = F.struct((F.col("shard") * 2 + 1).alias("shard"), (F.col("first") + F.col("_left")).alias("first"), (F.col("count") - F.col("_left")).alias("count"))
        rows = drawn.select("source_no", "blocks", F.explode(F.array(left, right)).alias("_x")).select("source_no", "blocks", "_x.*").where("count > 0")
        if level % 10 == 9:  # up to 1024 rows a source so far
            rows = rows.repartition("source_no", "shard")
    return rows


def mix_slots(targets: DataFrame, block_words: int, slots_per_shard: int = 4096, seed: int = 7) -> DataFrame:
    """The plan of the mix: shard, place (a shard is read in its order), source_no, pass_no,
    block. One row a slot."""
    slots = source_slots(targets, block_words)
    total = int(slots.agg(F.sum("slots")).first()[0] or 0)
    levels = max(0, math.ceil(math.log2(max(1, total) / slots_per_shard)))
    draws = shard_draws(slots, levels, seed)
    tasks = max(1, min(1 << levels, 4 * int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    turns = (
        draws.repartition(tasks, "source_no", "shard")
        .withColumn("pass_no", F.explode(F.sequence(F.expr("first div blocks"), F.expr("(first + count - 1) div blocks"))))
        .withColumn("_lo", F.greatest(F.lit(0), F.col("first") - F.col("pass_no") * F.col("blocks")))
        .withColumn("_hi", F.least("blocks", F.col("first") + F.col("count") - F.col("pass_no") * F.col("blocks")) - 1)
        .withColumn("_keys", round_keys(F.col("blocks"), F.lit(seed), F.col("source_no"), F.col("pass_no")))
    )
    made = turns.select("shard", "source_no", "pass_no", F.explode(F.transform(F.sequence("_lo", "_hi"), lambda i: permuted(i, F.col("blocks"), F.col("_keys")))).alias("block"))
    return made.select("shard", F.xxhash64(F.lit(seed), "shard", "source_no", "pass_no", "block").alias("place"), "source_no", F.col("pass_no").cast("int").alias("pass_no"), "block")


KEY = ("doc_id", "source", "_tie", "_row")


def document_blocks(sizes: DataFrame, targets: DataFrame, block_words: int) -> DataFrame:
    """Which words of which document lie in which block of its source: one row for
    each document and block (start, words: places in the document). sizes must be durable."""
    placed = running_before(sizes.where("size > 0"), "size", ["doc_id", "_tie", "_row"], ["source"], out="at")
    named = targets.select(F.col("source").alias("_source"), "source_no")
    return (
        placed.join(named, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("block", F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}"))))
        .withColumn("start", F.greatest(F.lit(0), F.col("block") * block_words - F.col("at")))
        .withColumn("words", F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("at")) - F.col("start"))
    )


def mix(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), block_words: int = 32, max_passes: int = 3, seed: int = 7, keep: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(targets, drawn) of documents (durable: KEY, size; no two rows of one KEY): drawn has
    shard, place, pass_no and the document's piece (keep, start, words) for every slot,
    joined by source and block."""
    targets = durable(source_targets(sizes, weights, max_passes), "mix-targets")
    slots = mix_slots(targets, block_words, seed=seed)
    pieces = document_blocks(sizes, targets, block_words).select("source_no", "block", *keep, "start", "words")
    # slots come from a short table, which would pass for small: both sides are shuffled
    return targets, slots.hint("merge").join(pieces, ["source_no", "block"])


def mix_taken(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), block_words: int = 32, max_passes: int = 3, seed: int = 7) -> DataFrame:
    """Per document: size, its source's size and target, and the words that the mix takes."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    sizes = durable(rows, "mix-sizes")
    targets, drawn = mix(sizes, weights, block_words, max_passes, seed, ["_row"])
    taken = drawn.groupBy(F.col("_row").alias("_of")).agg(F.sum("words").alias("_taken"))
    return (
        sizes.join(taken, F.col("_row") == F.col("_of"), "left")
        .join(targets.select(F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), block_words: int = 32, max_passes: int = 3, seed: int = 7) -> DataFrame:
    """The mix as documents: for every document and pass of which words are taken, a
    row with those words in order (the text itself where all are taken)."""
    none = F.lit(-1).cast("long").alias("_row")
    slim = durable(docs.select("doc_id", "source", F.xxhash64("text").alias("_tie"), word_count(F.col("text")).alias("size")), "mix-sizes")
    rows = docs.select(F.struct("*").alias("_doc"), F.xxhash64("text").alias("_tie"))
    # rows that are equal in id, source and text get numbers of their own
    twice = durable(slim.groupBy(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("_tie").alias("_t")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated-rows")
    if twice.limit(1).count():
        same = lambda id_, source: id_.eqNullSafe(F.col("_i")) & source.eqNullSafe(F.col("_s")) & (F.col("_tie") == F.col("_t"))
        of = same(F.col("_doc.doc_id"), F.col("_doc.source"))
        again = durable(rows.join(twice, of, "left_semi").select("_doc", "_tie", F.monotonically_increasing_id().alias("_row")), "numbered-rows")
        rows = rows.join(twice, of, "left_anti").select("_doc", "_tie", none).unionByName(again)
        single = slim.join(twice, same(F.col("doc_id"), F.col("source")), "left_anti").select("*", none)
        sizes = durable(single.unionByName(again.select("_doc.doc_id", "_doc.source", "_tie", word_count(F.col("_doc.text")).alias("size"), "_row")), "mix-sizes")
    else:
        rows, sizes = rows.select("_doc", "_tie", none), slim.select("*", none)
    _, drawn = mix(sizes, weights, block_words, max_passes, seed)
    parts = drawn.groupBy(*[F.col(c).alias(f"_of_{c}") for c in KEY], "pass_no").agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("_parts"), F.sum("words").alias("_words"))
    of = F.col("_doc.doc_id").eqNullSafe(F.col("_of_doc_id")) & F.col("_doc.source").eqNullSafe(F.col("_of_source")) & (F.col("_tie") == F.col("_of__tie")) & (F.col("_row") == F.col("_of__row"))
    words = F.regexp_extract_all(F.col("_doc.text"), F.lit(f"({WORD})"), 1)
    cut = F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice(F.col("_split"), (p["start"] + 1).cast("int"), p["words"].cast("int")))), " ")
    return (
        rows.join(parts, of)
        .withColumn("_split", F.when(F.col("_words") < word_count(F.col("_doc.text")), words))
        .withColumn("_text", F.when(F.col("_split").isNull(), F.col("_doc.text")).otherwise(cut))
        .select(F.col("_doc").withField("text", F.col("_text")).withField("n_chars", F.length("_text").cast("long")).alias("_doc"))
        .select("_doc.*")
    )
