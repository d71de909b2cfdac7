"""Grouping of spelling variants: words one edit apart, each led to its most frequent near word.

Pairs come from a positional q-gram inverted index (q = 5, with marks before and behind a
word) with a count filter. One edit spoils five grams of a word at most, so two near words
share a gram, at fitting places, among the six rarest distinct grams of each: a word is
posted under these six, and words posted under one gram meet in one task. There a word's
grams ask for postings of the same length at the same place and of a length one more at the
same place or the next. The postings are merged by a heap (the longest ones only looked up,
as many as the bound allows), partners with fewer hits than one edit leaves are dropped, and
the others are verified code point by code point. A pair that several grams bring is told in
one order of its words, whatever order the shuffle dealt them in, and counts once.

A gram with over `group_limit` words is split by length and place, and what is then still
above it into blocks of words that meet pairwise, so that a task holds at most twice that
many and no pair is lost. What orders grams is how many words have them, counted by 2^18
values of their hash, however large the corpus.

A word's form is its near word of the largest count (ties: smallest in code-point order) if
that count is `ratio` times its own; its root is the last of the forms that follow. Counts
rise by the ratio each step, so the steps are few and found by doubling.

Defined results: a null text has no words; a null id stands for an empty one; rows that
repeat are counted each; an empty table, or one without words of the length, gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.llm.url_rules import LOWER, UPPER
from loomtally.session import durable
from loomtally.sources.tables import spread

RUN = "[A-Za-zÀ-ÿ]"
Q = 5
#: Marks before and behind a word, no letters.
FRONT, BACK = "<" * (Q - 1), ">" * (Q - 1)
#: Distinct grams of a word that one edit can't all spoil.
LEAD = Q + 1
#: Values of the hash by which grams are counted.
SLOTS = 1 << 18
#: Words posted under one gram that meet in one task.
GROUP_LIMIT = 20_000


def noisy_words(docs: DataFrame, least_length: int = 1, every: int = 31) -> DataFrame:
    """word: the runs of least_length letters or more of all texts, A-Z lowered, a row each; where
    `every` divides h, the crc32 of `<doc_id>:<run>`, the code point h % length is left out."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({RUN}{{{least_length},}})"), 1)
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h, at = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return named.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """word, n of the words of docs (doc_id, text) that are long and frequent enough."""
    words = noisy_words(docs, least_length).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def grams_of(word: str) -> list[str]:
    marked = FRONT + word + BACK
    return [marked[i : i + Q] for i in range(len(word) + Q - 1)]


def lead_of(word: str, often: np.ndarray) -> list[str]:
    """The word's rarest distinct grams."""
    return [g for _, g in sorted([(often[zlib.crc32(g.encode()) % SLOTS], g) for g in set(grams_of(word))])[:LEAD]]


def one_edit(x: str, y: str) -> bool:
    """y is x with one code point replaced, or with one more."""
    if len(x) == len(y):
        return sum(map(str.__ne__, x, y)) == 1
    i = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), len(x))
    return x[i:] == y[i + 1 :]


def above_bound(postings: list[list[int]], bound: int) -> Iterator[int]:
    """Numbers that stand in `bound` or more of the ascending lists: a heap merges the shorter
    ones, and the bound - 1 longest are looked up."""
    if len(postings) < bound:
        return
    postings.sort(key=len)
    merged, looked_up = postings[: len(postings) - bound + 1], postings[len(postings) - bound + 1 :]
    for number, hits in groupby(merge(*merged) if len(merged) > 1 else merged[0]):
        count = sum(1 for _ in hits)
        for left, posting in enumerate(looked_up):
            if count >= bound or count + len(looked_up) - left < bound:
                break
            at = bisect_left(posting, number)
            count += at < len(posting) and posting[at] == number
        if count >= bound:
            yield number


def index_pairs(words: Sequence[str]) -> Iterator[tuple[int, int]]:
    """(x, y) numbers of all near pairs of distinct words, y of x's length or one longer."""
    index: dict[int, list[dict[str, list[int]]]] = {}  # by length, place and gram
    grams = [grams_of(w) for w in words]
    for number, found in enumerate(grams):
        if len(found) not in index:
            index[len(found)] = [defaultdict(list) for _ in found]
        for table, gram in zip(index[len(found)], found, strict=True):
            table[gram].append(number)
    for x, found in enumerate(grams):
        word = words[x]
        bound = len(word) - 1  # a replaced code point spoils Q grams
        postings = [p for table, gram in zip(index[len(found)], found, strict=True) if (p := table[gram])[-1] > x]
        if len(postings) >= bound:
            postings = [p[bisect_right(p, x) :] for p in postings]
            for y in above_bound(postings, bound):
                if one_edit(word, words[y]):
                    yield x, y
        longer = index.get(len(found) + 1)
        if longer:  # one more code point spoils Q - 1
            postings = [p for table, gram in zip(longer, found, strict=False) if (p := table.get(gram))]
            postings += [p for table, gram in zip(longer[1:], found, strict=True) if (p := table.get(gram))]
            if len(postings) > bound:
                for y in above_bound(postings, bound + 1):
                    if one_edit(word, words[y]):
                        yield x, y


def near_pairs(vocabulary: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """x, n_x, y, n_y: every pair of distinct words of vocabulary (word, n; durable, words of two
    code points or more) one edit apart, once: x the shorter word, or the smaller of one length."""
    spark = vocabulary.sparkSession
    marked = F.concat(F.lit(FRONT), "word", F.lit(BACK))
    cut = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(marked, i, F.lit(Q)))
    slot = F.crc32(F.col("gram").cast("binary")) % SLOTS
    told_of = vocabulary.select(F.explode(F.array_distinct(cut(F.length("word") + Q - 1))).alias("gram")).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # SLOTS rows at most
    counts = np.zeros(SLOTS, dtype=np.int64)
    counts[told_of["slot"].to_numpy(dtype=np.int64)] = told_of["n"].to_numpy(dtype=np.int64)
    often = spark.sparkContext.broadcast(counts)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            leads = [lead_of(w, often.value) for w in words]
            at = pa.array([i for i, lead in enumerate(leads) for _ in lead], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([g for lead in leads for g in lead], pa.string()), batch.column("word").take(at), batch.column("n").take(at)], names=["gram", "word", "n"])

    posted = durable(vocabulary.select("word", "n").mapInArrow(post, "gram string, word string, n long"), "postings")
    crowded = durable(posted.groupBy("gram").count().where(F.col("count") > group_limit).select(F.col("gram").alias("_g")), "crowded-grams")
    group, dealt = ["gram"], posted
    if crowded.limit(1).count():
        group = ["gram", "length", "place", "low", "high"]
        dealt = _split(posted, crowded, group_limit)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        out: list[tuple] = []
        for _, members in groupby(all_rows(), key=lambda r: r[: len(group)]):
            members = list(members)
            if len(members) > 1:
                words = [r[-2] for r in members]
                told = [(y, x) if len(words[x]) == len(words[y]) and words[x] > words[y] else (x, y) for x, y in index_pairs(words)]
                out += [(words[x], members[x][-1], words[y], members[y][-1]) for x, y in told]
            if len(out) >= 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    rows = dealt.select(*group, "word", "n").repartition(*group).sortWithinPartitions(*group)
    return rows.mapInArrow(meet, "x string, n_x long, y string, n_y long").distinct()


def _split(posted: DataFrame, crowded: DataFrame, group_limit: int) -> DataFrame:
    """gram, length, place, low, high, word, n: postings of crowded grams by the length and place of
    the shorter word, which both words know, and where these are crowded still by blocks of
    words, of which each two meet in one group (low, high); other postings as they are."""
    mine = F.col("gram") == F.col("_g")
    cold = posted.join(crowded, mine, "left_anti").select("gram", F.lit(-1).alias("length"), F.lit(-1).alias("place"), "word", "n")
    length, marked = F.length("word"), F.concat(F.lit(FRONT), "word", F.lit(BACK))
    at = F.filter(F.sequence(F.lit(0), length + Q - 2), lambda i: F.substring(marked, i + 1, F.lit(Q)) == F.col("gram"))
    spot = lambda n, p: F.struct(n.alias("length"), p.alias("place"))
    spots = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(spot(length, i), spot(length - 1, i), spot(length - 1, i - 1)))))
    hot = posted.join(crowded, mine, "left_semi").select("gram", F.explode(spots).alias("_s"), "word", "n").select("gram", "_s.length", "_s.place", "word", "n")
    key = ["gram", "length", "place"]
    sizes = hot.groupBy(*key).count().where(F.col("count") > group_limit).select(*[F.col(k).alias(f"_{k}") for k in key], F.ceil(F.col("count") / group_limit).cast("int").alias("_blocks"))
    blocks = F.coalesce("_blocks", F.lit(1))
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high")))
    joined = cold.unionByName(hot).join(sizes, [F.col(k) == F.col(f"_{k}") for k in key], "left").select(*key, F.explode(meets).alias("_m"), "word", "n")
    return joined.select(*key, "_m.low", "_m.high", "word", "n")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], names=["x", "n_x", "y", "n_y"])


def follow(forms: DataFrame, steps: int) -> DataFrame:
    """word, root of forms (word, form), no chain of which is longer than steps."""
    roots = durable(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        on = roots.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        roots = durable(roots.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")), "roots")
    return roots


def spelling_groups(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text)."""
    if least_length < 2 or ratio < 2:
        raise ValueError("words of 2 code points at least and a ratio of 2 at least")
    vocabulary = durable(word_counts(spread(docs.select("doc_id", "text")), least_length, least_count), "words")
    pairs = durable(near_pairs(vocabulary, group_limit), "near-words")
    one_way = lambda a, b: pairs.select(F.col(a).alias("word"), F.struct((-F.col(f"n_{b}")).alias("m"), F.col(b).alias("w")).alias("near"))
    near = one_way("x", "y").unionByName(one_way("y", "x")).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("best"))
    judged = vocabulary.join(near, "word", "left").withColumn("form_n", F.when(-F.col("best.m") >= ratio * F.col("n"), -F.col("best.m")))
    judged = durable(judged.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"), "forms")
    most = judged.agg(F.max("form_n")).first()[0] or 1
    roots = follow(judged.where("form IS NOT NULL"), 1 + int(math.log(most, ratio)))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
