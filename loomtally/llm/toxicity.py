"""Toxicity by cumulative-link ordinal regression.

Severity grades are ordered: 0 not toxic, 1 toxic, 2 toxic and of low quality. With
one weight vector w for sparse word features and thresholds t_1 < t_2,
P(grade >= j) = sigmoid(w.x - t_j); the expected severity is their sum. A document is
toxic if P(grade >= 1) reaches `cutoff`.

Features are the words of a text (runs of letters, digits and `_`, lower case) and
their beginnings of 5 characters, marked `^`, where they stand in toxic texts more
often than elsewhere (`least_docs` distinct texts and `least_z` standard errors at
least; of these the `max_features` of greatest z). They all speak for toxicity, and
no weight is below 0: a clean surrounding, however long, does not excuse a toxic passage.
The model is fitted on at most `max_labelled` labelled documents, those with the least
hash of doc_id; every document is scored over its whole text. Every labelled row counts;
rows of one sequence of words weigh one together, shared by their grades, so copies of a
text do not outvote others and texts that merely share a passage stay apart.

Defined results: a null or empty text has no features, so the grade that the
thresholds alone give; labels without doc_id or toxic are not used; of several labels of
one doc_id the greatest toxic and the least quality hold; no usable labels, or labels of
one kind: nothing is toxic; repeated rows are scored each; extra columns are ignored.
The fit does not depend on the order or the parts of its tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtally.llm.encoders import forget
from loomtally.session import durable

_WORD = re.compile(r"\w+")
GRADES = 3


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, words: set[str]) -> list[float]:
        """P(grade >= j) for j = 1, 2, ..."""
        z = sum(self.weights[w] for w in sorted(self.weights.keys() & words))
        return [float(1 / (1 + np.exp(-np.clip(z - t, -60, 60)))) for t in self.thresholds]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features_of(words: list[str]) -> set[str]:
    """The distinct words and the beginnings of the longer ones."""
    distinct = set(words)
    return distinct | {"^" + w[:5] for w in distinct if len(w) > 5}


def fit_ordinal(features: list[np.ndarray], grades: np.ndarray, prior: np.ndarray, share: np.ndarray | None = None, l2: float = 1e-3, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, rising thresholds) of the penalised likelihood, by Adam over all rows,
    each weighing its share.
    Thresholds are a first one and positive steps, so their order always holds.
    Weights are drawn to `prior`: toxic texts hold several of these words each, so the
    likelihood alone would leave a text with one or two of them below the cutoff."""
    n, n_features = len(features), len(prior)
    share = np.ones(n) if share is None else share
    total = max(float(share.sum()), 1e-12)
    rows = np.repeat(np.arange(n), [len(f) for f in features])
    cols = np.concatenate(features).astype(np.int64) if n and rows.size else np.zeros(0, dtype=np.int64)
    above = [max(1e-4, min(1 - 1e-4, float(share[grades >= j].sum() / total))) for j in range(1, GRADES)]
    start = [-np.log(p / (1 - p)) for p in above]
    p = np.concatenate([prior, [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1 if n else 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        t = np.concatenate([[p[n_features]], p[n_features] + np.cumsum(gaps)])
        z = np.bincount(rows, w[cols], n)
        above = np.column_stack([np.ones(n), *[sig(z - x) for x in t], np.zeros(n)])  # P(grade >= j)
        slope = above * (1 - above)
        at = np.maximum(above[np.arange(n), grades] - above[np.arange(n), grades + 1], 1e-12)
        dz = (slope[np.arange(n), grades] - slope[np.arange(n), grades + 1]) / at
        gw = np.bincount(cols, (dz * share)[rows], n_features) / total - l2 * (w - prior)
        gt = np.array([(-slope[:, j] * ((grades == j).astype(float) - (grades == j - 1)) * share / at).sum() / total for j in range(1, GRADES)])
        g = np.concatenate([gw, [gt.sum()], [gt[j:].sum() * gaps[j - 1] for j in range(1, GRADES - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        p[:n_features] = np.maximum(p[:n_features], 0)
    return p[:n_features], np.concatenate([[p[n_features]], p[n_features] + np.cumsum(np.exp(p[n_features + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_features: int = 2048, least_docs: int = 4, least_z: float = 4.0) -> OrdinalModel:
    """The model from labels (doc_id, quality, toxic) of documents."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"), F.min("quality").alias("_quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # bounded, so it can be broadcast
    grade = F.when(F.col("_toxic") == 0, 0).when(F.col("_quality") == 0, 2).otherwise(1).cast("int")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).select("text", grade.alias("grade"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh128_hexdigest

        forget()
        for batch in batches:
            words = [words_of(t) for t in batch["text"].tolist()]
            keys = [xxh128_hexdigest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words]
            yield pd.DataFrame({"text_key": keys, "grade": batch["grade"], "words": [sorted(features_of(w)) for w in words]})

    rows = texts.mapInPandas(split, "text_key string, grade int, words array<string>")
    # equal keys have equal words, so the first is any
    rows = rows.groupBy("text_key", "grade").agg(F.count(F.lit(1)).alias("n"), F.first("words").alias("words"))
    rows = durable(rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("text_key"))), "labelled")  # a row for each grade of a text
    toxic_share = F.when(F.col("grade") > 0, F.col("share")).otherwise(0.0)
    sizes = rows.agg(F.sum("share").alias("n"), F.sum(toxic_share).alias("k")).first()
    n, k = round(sizes["n"] or 0.0, 6), round(sizes["k"] or 0.0, 6)
    if not k or k == n:
        return OrdinalModel({}, tuple(float(50 + j) for j in range(1, GRADES)))
    counts = rows.select("share", toxic_share.alias("bad"), F.explode("words").alias("word")).groupBy("word").agg(F.round(F.sum("share"), 6).alias("docs"), F.round(F.sum("bad"), 6).alias("bad"))
    rate = F.col("docs") / n
    z = (F.col("bad") / k - (F.col("docs") - F.col("bad")) / (n - k)) / F.sqrt(rate * (1 - rate) * (1 / k + 1 / (n - k)) + F.lit(1e-12))
    picked = counts.where(f"docs >= {least_docs}").withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "word").limit(max_features)
    odds = {r["word"]: 0.5 * float(np.log((r["bad"] + 0.5) / (k + 1)) - np.log((r["docs"] - r["bad"] + 0.5) / (n - k + 1))) for r in picked.select("word", "docs", "bad").collect()}
    vocabulary = sorted(odds)
    place = {w: i for i, w in enumerate(vocabulary)}
    known = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    got = rows.select("text_key", "grade", "share", F.array_intersect("words", known).alias("words")).orderBy("text_key", "grade").collect()  # at most max_labelled short rows
    w, t = fit_ordinal([np.array(sorted(place[x] for x in r["words"]), dtype=np.int64) for r in got], np.array([r["grade"] for r in got]), np.array([odds[x] for x in vocabulary]), np.array([r["share"] for r in got]))
    return OrdinalModel({x: float(w[i]) for x, i in place.items()}, tuple(float(x) for x in t))


def score(docs: DataFrame, model: OrdinalModel, cutoff: float = 0.5) -> DataFrame:
    """doc_id, expected_severity, grade (the likeliest), toxic."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in batches:
            out = [model.score(features_of(words_of(t))) for t in batch["text"].tolist()]
            above = np.array(out, dtype=np.float64).reshape(len(out), GRADES - 1)
            shares = -np.diff(np.column_stack([np.ones(len(out)), above, np.zeros(len(out))]), axis=1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "expected_severity": above.sum(axis=1), "grade": shares.argmax(axis=1).astype(np.int32), "toxic": above[:, 0] >= cutoff})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """docs without the rows that the model finds toxic, in one pass over the texts."""
    model = fit(docs, labels)

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for texts in batches:
            yield pd.Series([model.score(features_of(words_of(t)))[0] >= cutoff for t in texts], dtype=bool)

    return docs.where(~toxic("text"))
