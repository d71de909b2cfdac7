"""Queries about experiments: exposure, diagnosis, evaluation, reports and audits, with DuckDB SQL
for the same rows. Sources split documents into training, validation and test; an arm's model is an
add-alpha byte unigram of English (fit) or other (general) training documents, alpha its seed."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.functions.codes import BOS, BYTE_VOCABULARY, EOS
from loomtally.functions.text import is_blank, text_sha256
from loomtally.operators import audit, blocks, compare, diagnose, early, evaluate, exposure, report, score, select
from loomtally.operators.portions import portions
from loomtally.plans.registry import _BYTES, _FAMILIES, _NORM, _R, _WINDOWS, BLOCK_BYTES, CONTEXT, REPLICATES, _arms, _families, _key, _rounded, _scores, documents, heavy_documents
from loomtally.session import durable, scratch_path
from loomtally.sources.tables import table

STEPS, BATCH, DRAW_SEED = 1200, 16, 42
SEEDS = (1, 2, 3)


def _training(spark: SparkSession, folder: str) -> DataFrame:
    docs = heavy_documents(spark, folder)
    split = F.broadcast(_families(docs).where("split = 'train'").select(F.col("family").alias("source")))  # a row for each source
    return durable(docs.join(split, "source").select("pos", "text"), "training")


# -- exposure --------------------------------------------------------------------------


def _replays(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    train = _training(spark, folder)
    raw = durable(exposure.raw_examples(train, CONTEXT), "raw-examples")
    packed, windows = exposure.packed_examples(train, CONTEXT, BOS, EOS)
    run = lambda of, n: exposure.replay(of, n, CONTEXT, STEPS, BATCH, DRAW_SEED)
    return {"raw": run(raw, raw.count()), "token": run(packed, windows)}


def exposure_replay(spark: SparkSession, folder: str) -> DataFrame:
    """What 1,200 steps of 16 examples show of the training documents, in both regimes."""
    rows = [seen.select(F.lit(name).alias("regime"), "*") for name, (_, seen) in _replays(spark, folder).items()]
    return rows[0].unionByName(rows[1])


def exposure_unigram(spark: SparkSession, folder: str) -> DataFrame:
    """Validation documents under the unigram of the targets that a packed run has drawn."""
    counts, _ = _replays(spark, folder)["token"]
    _, valid, _ = _arms(spark, folder)
    scores = score.score_counts(durable(counts, "replayed"), valid, BYTE_VOCABULARY)
    return scores.select(F.col("pos").alias("doc_id"), "scored_tokens", F.round("nll_nats", _R).alias("nll_nats"))


def completed_characters(spark: SparkSession, folder: str) -> DataFrame:
    """Code points and bytes that each document's byte tokens complete."""
    each = exposure.token_extents(heavy_documents(spark, folder))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    firsts = F.size(F.filter("chars", lambda x: x > 0)).cast("long")
    return each.select(F.col("pos").alias("doc_id"), F.size("ids").cast("long").alias("tokens"), total("widths").alias("utf8_bytes"), total("chars").alias("characters"), firsts.alias("completing"))


def flat_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows over the flat stream of bytes of half of all tokens, without controls."""
    docs = documents(spark, folder)
    most = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    made = blocks.flat_windows(score.byte_documents(docs), CONTEXT, most)
    joined = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ","))
    return made.select("win", joined("inputs").alias("inputs_md5"), F.element_at("labels", -1).alias("last_label"))


def fertility(spark: SparkSession, folder: str) -> DataFrame:
    """Characters a token, by language."""
    docs = score.byte_histograms(documents(spark, folder), ("lang",))
    tokens = F.aggregate("histogram", F.lit(0).cast("long"), lambda a, x: a + x["m"])
    return docs.groupBy("lang").agg(F.sum(tokens).alias("tokens"), F.round(F.sum("characters") / F.sum(tokens), _R).alias("characters_per_token"))


# -- diagnosis and evaluation --------------------------------------------------------------


def _halves(docs: DataFrame) -> DataFrame:
    """Half bytes as tokens: two for each byte, in the vocabulary of bytes."""

    def run(batches):
        for batch in portions(batches, "text"):
            data, ends = score.utf8_bytes(batch.column("text"))
            ids = np.column_stack([data >> 4, data & 15]).ravel().astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("pos", "characters", "utf8_bytes")], pa.ListArray.from_arrays(pa.array((2 * ends).astype(np.int32)), pa.array(ids))], names=["pos", "characters", "utf8_bytes", "token_ids"])

    rows = docs.select("pos", "text", F.length("text").cast("long").alias("characters"), F.octet_length("text").cast("long").alias("utf8_bytes"))
    return rows.mapInArrow(run, "pos long, characters long, utf8_bytes long, token_ids array<int>")


def _diagnosis(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = heavy_documents(spark, folder)
    named = durable(docs.join(F.broadcast(_families(docs).select(F.col("family").alias("source"), "split")), "source").select("pos", "text", "split"), "named")
    arms = {"fit": score.byte_histograms, "general": _halves}
    return diagnose.diagnose(named.where("split = 'train'"), named.where("split = 'validation'"), arms, BYTE_VOCABULARY, (BOS, EOS), BLOCK_BYTES)


def tokenizer_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes (fit) against half bytes (general): both segmentations under both baselines."""
    scores, _, differences = _diagnosis(spark, folder)
    bits = scores.groupBy("segmentation", "baseline").pivot("label", ["fit", "general"]).agg(F.sum("nll_nats") / (F.sum("utf8_bytes") * score.LN2))
    rows = bits.withColumnsRenamed({"fit": "fit_bpb", "general": "general_bpb"}).join(differences.select("segmentation", "baseline", F.col("bits_per_utf8_byte").alias("difference"), "token_ratio"), ["segmentation", "baseline"])
    return _rounded(rows, "fit_bpb", "general_bpb", "difference", "token_ratio")


def diagnosis_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Vocabulary use of both arms in both segmentations."""
    _, usage, _ = _diagnosis(spark, folder)
    return _rounded(usage.select("label", "segmentation", "documents", "tokens", "unique_ids", "bytes_per_token", "entropy_bits", "unseen_ids", "unseen_tokens"), "bytes_per_token", "entropy_bits")


def _logarithms():
    return lambda inputs, labels: [float(np.log1p(np.asarray(x, dtype=np.float64)).sum()) for x in labels]


def scorer_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Validation documents scored by a hook whose cost of a byte b is ln(1 + b), in blocks."""
    _, valid, _ = _arms(spark, folder)
    docs = durable(documents(spark, folder).join(valid.select("pos"), "pos", "left_semi").select("pos", "text"), "validation")
    _, scores = evaluate.evaluate(docs, score.byte_documents, _logarithms, CONTEXT, BOS, scratch_path(spark, "evaluation"), {"scorer": "logarithms"})
    return scores.select(F.col("pos").alias("doc_id"), "scored_tokens", "utf8_bytes", F.round("nll_nats", _R).alias("nll_nats"))


# -- reports -----------------------------------------------------------------------------


def _runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, scores, groups): arms fit and general, alpha as seed, over validation documents; the
    general run of the last seed is not complete."""
    train, valid, _ = _arms(spark, folder)
    rows, scores = [], []
    for label, of in (("fit", train.where("lang = 'en'")), ("general", train.where("lang <> 'en'"))):
        counts = durable(score.token_counts(of), "counts")
        for seed in SEEDS:
            rows.append(("raw", seed, label, "failed" if (label, seed) == ("general", SEEDS[-1]) else "complete", "s", label, "i"))
            one = score.score_counts(counts, valid, BYTE_VOCABULARY, float(seed), keep=("sha256",))
            scores.append(one.select(F.lit("raw").alias("regime"), F.lit(seed).cast("long").alias("seed"), F.lit(label).alias("label"), "pos", "sha256", "nll_nats", "utf8_bytes"))
    joined = scores[0]
    for s in scores[1:]:
        joined = joined.unionByName(s)
    runs = spark.createDataFrame(rows, "regime string, seed long, label string, status string, snapshot_sha256 string, tokenizer_sha256 string, identity string")
    return runs, durable(joined, "run-scores"), valid.select("pos", F.col("source").alias("group"))


def matrix_report(spark: SparkSession, folder: str) -> DataFrame:
    """All complete pairs with their group intervals and gains over the uniform baseline."""
    runs, scores, groups = _runs(spark, folder)
    base = spark.createDataFrame([("raw", a, math.log2(BYTE_VOCABULARY)) for a in ("fit", "general")], "regime string, label string, baseline_bpb double")
    return _rounded(report.matrix_report(runs, scores, groups, base, "s", REPLICATES), "fit_bpb", "general_bpb", "difference", "low", "high", "fit_gain", "general_gain")


def replication_report(spark: SparkSession, folder: str) -> DataFrame:
    """The seeds' mean, with the pairs that are missing counted."""
    runs, scores, groups = _runs(spark, folder)
    rows, missing = report.replication_report(runs, scores, groups, ["raw"], list(SEEDS), REPLICATES)
    gone = missing.groupBy("regime").agg(F.count(F.lit(1)).alias("missing_pairs"))
    out = rows.join(gone, "regime", "left").na.fill(0, ["missing_pairs"])
    return _rounded(out, "fit_mean_bpb", "general_mean_bpb", "paired_mean_bpb", "paired_sd", "paired_min", "paired_max", "relative_mean_difference", "low", "high")


def checkpoint_pair(spark: SparkSession, folder: str) -> DataFrame:
    """Two sealed evaluations of the validation documents, compared."""
    _, scores, groups = _runs(spark, folder)
    of = lambda label: scores.where((F.col("label") == label) & (F.col("seed") == 1))
    result = report.sealed({"status": "complete", "identity": {"snapshot_manifest_sha256": "s", "protocol": {"mode": "raw"}}})
    return _rounded(report.checkpoint_pair(result, result, of("fit"), of("general"), groups, "s", REPLICATES), "fit_bpb", "general_bpb", "difference", "relative_improvement", "low", "high")


# -- audits and scans ----------------------------------------------------------------------


def blank_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and pages whose text is missing or white space only, and how many are not."""
    rows = documents(spark, folder).select(F.lit("documents").alias("table"), "text").unionByName(table(spark, folder, "pages").select(F.lit("pages").alias("table"), F.col("html").alias("text")))
    return rows.groupBy("table").agg(F.count(F.when(is_blank(F.col("text")), 1)).alias("blank"), F.count(F.when(~is_blank(F.col("text")), 1)).alias("sound"))


def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct sources and (language, source) families of each split."""
    docs = documents(spark, folder)
    named = docs.join(F.broadcast(_families(docs).select(F.col("family").alias("source"), "split")), "source")
    return audit.distinct_counts(named.select("split", F.upper("source").alias("repo"), F.concat_ws("/", "lang", "source").alias("family")), "split")


def partition_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Languages as partitions: empty ones, texts repeated within one, texts in two."""
    found = audit.partition_audit(documents(spark, folder), "lang", ["en", "fr", "de", "es", "xx"])
    return found.groupBy("audit", F.when(F.col("audit") == "repeated", F.col("key")).otherwise(F.col("key")).alias("key")).agg(F.count(F.lit(1)).alias("findings"))


def family_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Sources as families, languages as partitions: families in several."""
    docs = documents(spark, folder)
    return audit.family_audit(docs.select("lang", "pos", F.col("source").alias("family"), F.concat_ws("/", "lang", "source").alias("repo")), "lang")


def disjoint_audit(spark: SparkSession, folder: str) -> DataFrame:
    """English documents as a tokenizer corpus against the others: findings by audit."""
    docs = documents(spark, folder)
    full = docs.where("lang = 'en'").select("pos", "text", text_sha256(F.col("text")).alias("sha256"))
    half = (full.agg(F.sum(F.length("text"))).first()[0] or 0) // 2
    cut = durable(select.character_prefix(full.select("pos", "text"), max(1, half)), "training")
    training = cut.select("pos", "text", text_sha256(F.col("text")).alias("sha256"))
    kept = full.join(training.select("pos"), "pos", "left_semi")
    named = docs.select("pos", F.concat(F.lit("owner/"), F.col("source")).alias("repo"), F.col("source").alias("family"))
    metadata = training.select("pos", "sha256").join(kept.select("pos", F.col("sha256").alias("full_sha256")), "pos").join(named, "pos")
    references = docs.where("lang <> 'en'").select("text", "source").withColumn("family", F.col("source"))
    return audit.disjoint_audit(training, kept, metadata, references, max(1, half)).groupBy("audit").agg(F.count(F.lit(1)).alias("findings"))


def scan_stop(spark: SparkSession, folder: str) -> DataFrame:
    """What a scan reads until a third of all documents are selected or half are read."""
    docs = documents(spark, folder)
    n = docs.count()
    files = docs.select("pos", "text", F.lit("a.py").alias("path"), F.col("source").alias("family"))
    return select.scan_until(select.file_reasons(files), max(1, n // 3), max(1, n // 2)).groupBy("reason").agg(F.count(F.lit(1)).alias("documents"), F.max("pos").alias("last_doc"))


def early_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The same from the files of the table, in growing slices."""
    files = early.OrderedFiles.of(spark, f"{folder}/documents.parquet", "doc_id")
    n = table(spark, folder, "documents").count()
    shape = lambda rows: rows.select(F.col("doc_id").alias("pos"), "text", F.lit("a.py").alias("path"), F.col("source").alias("family"))
    found = early.scan_files(files, shape, max(1, n // 3), max(1, n // 2))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("documents"), F.max("pos").alias("last_doc"))


def characters_stop(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents in order until a third of all characters are read."""
    docs = documents(spark, folder)
    budget = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 3
    rows = select.until_characters(docs.select("pos", "text"), budget)
    return rows.select(F.col("pos").alias("doc_id"), F.length("text").cast("long").alias("characters"))


def close_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's cost of validation documents against the sum over its documents in another order,
    within the tolerance of audits."""
    train, valid, _ = _arms(spark, folder)
    scores = durable(score.unigram_nll(train, valid, BYTE_VOCABULARY, keep=("source",)), "scores")
    halves = scores.groupBy("source", F.col("pos") % 2).agg(F.sum("nll_nats").alias("h")).groupBy("source").agg(F.sum("h").alias("b"))
    both = scores.groupBy("source").agg(F.sum("nll_nats").alias("a")).join(halves, "source")
    return both.select("source", compare.close(F.col("a"), F.col("b")).alias("close"), compare.close(F.col("a"), F.col("a") + 1e-3).alias("apart"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        exposure_replay, exposure_unigram, completed_characters, flat_windows, fertility, tokenizer_diagnosis, diagnosis_usage, scorer_evaluation, matrix_report, replication_report,
        checkpoint_pair, blank_texts, distinct_counts, partition_audit, family_audit, disjoint_audit, scan_stop, early_scan, characters_stop, close_totals,
    )
}

# -- the same in DuckDB ----------------------------------------------------------------

_BLANK = r"trim(regexp_replace(coalesce({c}, ''), '[\t-\r\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) = ''"


def _times(examples: str, size: str) -> str:
    """example, times of draws from permutations in the order of an md5 key."""
    return f"""SELECT example, ({STEPS * BATCH} // {size}) + CASE WHEN row_number() OVER (ORDER BY cast('0x' || substr(md5('{DRAW_SEED}|' || ({STEPS * BATCH} // {size}) || '|' || example), 1, 15) AS bigint), example) <= {STEPS * BATCH} % {size} THEN 1 ELSE 0 END AS times FROM {examples}"""


_TRAIN = f"{_FAMILIES}, t AS (SELECT doc_id, text FROM documents JOIN families USING (source) WHERE split = 'train')"
_STREAM = f"""
st AS (SELECT doc_id, unnest(range(len(h) + 1)) AS i, unnest(list_transform(h, lambda x: cast('0x' || x AS int)) || [{EOS}]) AS token,
  unnest(list_transform(h[2:] || ['00'], lambda x: x < '80' OR x >= 'C0')::boolean[] || [false]) AS ends FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM t)),
g AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS gp, token, ends FROM st),
gw AS (SELECT gp // {CONTEXT} AS example, token, ends FROM g WHERE gp // {CONTEXT} < (SELECT count(*) // {CONTEXT} FROM g)),
gt AS ({_times('(SELECT DISTINCT example FROM gw)', f'(SELECT count(*) // {CONTEXT} FROM g)')})"""


def _alpha(name: str, train: str, alpha: int) -> str:
    return _scores(name, train, "split = $$validation$$").replace("c.c, 0) + 1.0::double", f"c.c, 0) + {alpha}.0::double").replace(f"+ {BYTE_VOCABULARY}.0::double", f"+ {BYTE_VOCABULARY * alpha}.0::double")


_PAIRS = f"WITH {_FAMILIES}, {_BYTES}, " + ", ".join(_alpha(f"{a}{s}", f"split = $$train$$ AND lang {'=' if a == 'f' else '<>'} $$en$$", s) for s in SEEDS for a in "fg") + ", pr AS (" + " UNION ALL ".join(f"SELECT {s}::bigint AS seed, doc_id, f{s}.source, f{s}.utf8_bytes, f{s}.nll AS f, g{s}.nll AS g FROM f{s} JOIN g{s} USING (doc_id)" for s in SEEDS[:-1]) + ")"


def _interval(by: str, rows: str) -> str:
    """low, high, n of each `by` of rows (by, source, delta, utf8_bytes)."""
    return f"""
ug AS (SELECT {by}, source, sum(delta) AS delta, sum(utf8_bytes) AS utf8_bytes FROM ({rows}) GROUP BY ALL),
un AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {_key(0, 'source')}, source) - 1 AS unit, count(*) OVER (PARTITION BY {by}) AS n FROM ug),
dr AS (SELECT r, cast('0x' || substr(md5('31415|' || r || '|' || s), 1, 8) AS bigint) % (SELECT max(n) FROM un) AS unit FROM range({REPLICATES}) a(r), range((SELECT max(n) FROM un)) b(s)),
vv AS (SELECT {by}, r, sum(delta) / sum(utf8_bytes) / ln(2) AS v FROM dr JOIN un USING (unit) GROUP BY ALL),
iv AS (SELECT {by}, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, (SELECT max(n) FROM un) AS groups FROM vv GROUP BY {by})"""


_SPLIT_BYTES = f"""{_FAMILIES}, bh AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents),
tk AS (SELECT doc_id, 'fit' AS label, cast('0x' || h AS int) AS token FROM bh UNION ALL SELECT doc_id, 'general', cast('0x' || substr(h, 1, 1) AS int) FROM bh UNION ALL SELECT doc_id, 'general', cast('0x' || substr(h, 2, 1) AS int) FROM bh),
tm AS (SELECT label, split, token, count(*) AS m FROM tk JOIN documents USING (doc_id) JOIN families USING (source) GROUP BY ALL),
vd AS (SELECT count(*) AS docs, sum(strlen(text)) AS b FROM documents JOIN families USING (source) WHERE split = 'validation'),
bl AS (SELECT 'whole_documents' AS segmentation UNION ALL SELECT 'shared_raw_blocks')"""

ORACLES: dict[str, str] = {
    "exposure_replay": f"""WITH RECURSIVE {_TRAIN}, {_STREAM},
cut(doc_id, n, block, rest) AS (SELECT doc_id, -1::bigint, '', text FROM t UNION ALL
  SELECT doc_id, n + 1, substr(rest, 1, k), substr(rest, k + 1) FROM (
    SELECT *, list_max(list_filter(range(1, {CONTEXT + 1}), lambda x: strlen(substr(rest, 1, x)) <= {CONTEXT})) AS k FROM cut WHERE rest <> '')),
b AS (SELECT row_number() OVER (ORDER BY doc_id, n) - 1 AS example, block FROM cut WHERE n >= 0),
bt AS ({_times('b', '(SELECT count(*) FROM b)')})
SELECT 'raw' AS regime, sum(times * length(block))::bigint AS raw_chars, sum(times * strlen(block))::bigint AS raw_bytes, sum(times * strlen(block))::bigint AS target_tokens, {STEPS * BATCH * CONTEXT}::bigint AS padded_positions FROM b JOIN bt USING (example)
UNION ALL
SELECT 'token', sum(times) FILTER (ends)::bigint, sum(times) FILTER (token < 256)::bigint, sum(times)::bigint, {STEPS * BATCH * CONTEXT}::bigint FROM gw JOIN gt USING (example)""",
    "exposure_unigram": f"""WITH {_TRAIN}, {_STREAM},
c AS (SELECT token, sum(times) AS c FROM gw JOIN gt USING (example) GROUP BY token),
v AS (SELECT doc_id, cast('0x' || h AS int) AS token, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents JOIN families USING (source) WHERE split = 'validation') GROUP BY ALL)
SELECT d.doc_id, strlen(d.text) AS scored_tokens, round(coalesce(sum(v.m * (ln((SELECT sum(c) FROM c) + {BYTE_VOCABULARY}.0::double) - ln(coalesce(c.c, 0) + 1.0::double))), 0), 6) AS nll_nats
FROM documents d JOIN families USING (source) LEFT JOIN v ON v.doc_id = d.doc_id LEFT JOIN c USING (token) WHERE split = 'validation' GROUP BY d.doc_id, d.text""",
    "completed_characters": "SELECT doc_id, strlen(text) AS tokens, strlen(text) AS utf8_bytes, length(text) AS characters, length(text) AS completing FROM documents",
    "flat_windows": f"""WITH {_WINDOWS.format(key='doc_id', table='documents')},
s AS (SELECT row_number() OVER (ORDER BY id, i) - 1 AS g, token FROM (SELECT id, unnest(range(len(ids))) AS i, unnest(ids) AS token FROM coded)),
k AS (SELECT g, token, lead(token) OVER (ORDER BY g) AS label FROM s WHERE g < (SELECT count(*) // 2 FROM s))
SELECT g // {CONTEXT} AS win, md5(string_agg(token::varchar, ',' ORDER BY g)) AS inputs_md5, arg_max(label, g) AS last_label FROM k GROUP BY 1 HAVING count(label) = {CONTEXT}""",
    "fertility": "SELECT lang, sum(strlen(text))::bigint AS tokens, round(sum(length(text)) / sum(strlen(text)), 6) AS characters_per_token FROM documents GROUP BY lang",
    # blocks of bytes hold the tokens of their documents, so both segmentations cost the same
    "tokenizer_diagnosis": f"""WITH {_SPLIT_BYTES},
c AS (SELECT label, token, m AS c FROM tm WHERE split = 'train'), s AS (SELECT label, sum(c) AS n FROM c GROUP BY label),
e AS (SELECT label, 'unigram' AS baseline, sum(v.m * (ln(n + {BYTE_VOCABULARY}.0::double) - ln(coalesce(c, 0) + 1.0::double))) AS nll, sum(v.m) AS t FROM tm v JOIN s USING (label) LEFT JOIN c USING (label, token) WHERE split = 'validation' GROUP BY label
  UNION ALL SELECT label, 'uniform', sum(m) * ln({BYTE_VOCABULARY}), sum(m) FROM tm WHERE split = 'validation' GROUP BY label)
SELECT segmentation, f.baseline, round(f.nll / (b * ln(2)), 6) AS fit_bpb, round(g.nll / (b * ln(2)), 6) AS general_bpb, round((f.nll - g.nll) / (b * ln(2)), 6) AS difference, round(f.t / g.t, 6) AS token_ratio
FROM e f JOIN e g ON f.baseline = g.baseline AND f.label = 'fit' AND g.label = 'general', vd, bl""",
    "scorer_evaluation": f"""WITH {_FAMILIES}, v AS (SELECT doc_id, text FROM documents JOIN families USING (source) WHERE split = 'validation')
SELECT doc_id, strlen(text) AS scored_tokens, strlen(text) AS utf8_bytes, round(coalesce(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ln(1.0::double + cast('0x' || h AS int)))), 0), 6) AS nll_nats FROM v""",
    "matrix_report": f"""{_PAIRS}, {_interval('seed', 'SELECT seed, source, f - g AS delta, utf8_bytes FROM pr')},
m AS (SELECT seed, sum(f) / (sum(utf8_bytes) * ln(2)) AS a, sum(g) / (sum(utf8_bytes) * ln(2)) AS b FROM pr GROUP BY seed)
SELECT 'raw' AS regime, seed, round(a, 6) AS fit_bpb, round(b, 6) AS general_bpb, round(a - b, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, groups, round(ln({BYTE_VOCABULARY}) / ln(2) - a, 6) AS fit_gain, round(ln({BYTE_VOCABULARY}) / ln(2) - b, 6) AS general_gain
FROM m JOIN iv USING (seed)""",
    "replication_report": f"""{_PAIRS}, {_interval('regime', "SELECT 'raw' AS regime, any_value(source) AS source, avg(f) - avg(g) AS delta, any_value(utf8_bytes) AS utf8_bytes FROM pr GROUP BY doc_id")},
m AS (SELECT seed, sum(f) / (sum(utf8_bytes) * ln(2)) AS a, sum(g) / (sum(utf8_bytes) * ln(2)) AS b FROM pr GROUP BY seed)
SELECT 'raw' AS regime, count(*) AS seed_count, round(avg(a), 6) AS fit_mean_bpb, round(avg(b), 6) AS general_mean_bpb, round(avg(a - b), 6) AS paired_mean_bpb, round(stddev_samp(a - b), 6) AS paired_sd, round(min(a - b), 6) AS paired_min, round(max(a - b), 6) AS paired_max,
  round((avg(a) - avg(b)) / avg(b), 6) AS relative_mean_difference, (SELECT round(low, 6) FROM iv) AS low, (SELECT round(high, 6) FROM iv) AS high, (SELECT groups FROM iv) AS groups, 1::bigint AS missing_pairs FROM m""",
    "checkpoint_pair": f"""{_PAIRS}, {_interval('seed', 'SELECT seed, source, f - g AS delta, utf8_bytes FROM pr WHERE seed = 1')},
m AS (SELECT sum(f) / (sum(utf8_bytes) * ln(2)) AS a, sum(g) / (sum(utf8_bytes) * ln(2)) AS b FROM pr WHERE seed = 1)
SELECT round(a, 6) AS fit_bpb, round(b, 6) AS general_bpb, round(a - b, 6) AS difference, round((b - a) / b, 6) AS relative_improvement, round(low, 6) AS low, round(high, 6) AS high, groups FROM m, iv""",
    "blank_texts": f"""WITH x AS (SELECT 'documents' AS "table", {_BLANK.format(c='text')} AS b FROM documents UNION ALL SELECT 'pages', {_BLANK.format(c='html')} FROM pages)
SELECT "table", count(*) FILTER (b) AS blank, count(*) FILTER (NOT b) AS sound FROM x GROUP BY 1""",
    "distinct_counts": f"WITH {_FAMILIES} SELECT split, count(DISTINCT lower(source)) AS repositories, count(DISTINCT lang || '/' || source) AS families FROM documents JOIN families USING (source) GROUP BY split",
    "partition_audit": """WITH k AS (SELECT lang, sha256(text) AS s, count(*) AS n FROM documents GROUP BY ALL)
SELECT 'repeated' AS audit, lang AS key, count(*) AS findings FROM k WHERE n > 1 GROUP BY lang
UNION ALL SELECT 'overlap', a.lang || '/' || b.lang, 1 FROM k a JOIN k b ON a.s = b.s AND a.lang < b.lang GROUP BY a.lang, b.lang
UNION ALL SELECT 'empty', p, 1 FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('xx')) v(p) WHERE p NOT IN (SELECT lang FROM documents)""",
    "family_audit": "SELECT 'family overlap' AS audit, lower(source) AS key, count(DISTINCT lang)::varchar AS detail FROM documents GROUP BY lower(source) HAVING count(DISTINCT lang) > 1",
    "scan_stop": """WITH n AS (SELECT greatest(1, count(*) // 3) AS a, greatest(1, count(*) // 2) AS b FROM documents),
judged AS (SELECT doc_id, length(text) NOT BETWEEN 200 AND 20000 AS out, sha256(text) AS sha, sha256(trim(regexp_replace(text, '[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), ' ')) AS norm FROM documents),
fit AS (SELECT doc_id, sha, first(sha) OVER w AS fs, row_number() OVER w AS k FROM judged WHERE NOT out WINDOW w AS (PARTITION BY norm ORDER BY doc_id)),
named AS (SELECT doc_id, CASE WHEN k = 1 THEN 'selected' WHEN sha = fs THEN 'exact_duplicates' ELSE 'whitespace_duplicates' END AS reason FROM fit UNION ALL SELECT doc_id, 'outside_size_bounds' FROM judged WHERE out),
seen AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS r, coalesce(sum((reason = 'selected')::int) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM named)
SELECT reason, count(*) AS documents, max(doc_id) AS last_doc FROM seen, n WHERE r < b AND g < a GROUP BY reason""",
    "characters_stop": """WITH b AS (SELECT doc_id, length(text) AS characters, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT doc_id, characters FROM b WHERE before < (SELECT sum(length(text))::bigint // 3 FROM documents)""",
    "close_totals": f"WITH {_FAMILIES} SELECT DISTINCT source, true AS close, false AS apart FROM documents JOIN families USING (source) WHERE split = 'validation'",
    "diagnosis_usage": f"""WITH RECURSIVE {_SPLIT_BYTES},
cut(doc_id, n, rest) AS (SELECT doc_id, 0::bigint, text FROM documents JOIN families USING (source) WHERE split = 'validation' UNION ALL
  SELECT doc_id, n + 1, substr(rest, list_max(list_filter(range(1, {BLOCK_BYTES + 1}), lambda x: strlen(substr(rest, 1, x)) <= {BLOCK_BYTES})) + 1) FROM cut WHERE rest <> ''),
sg AS (SELECT 'whole_documents' AS segmentation, (SELECT docs FROM vd) AS documents UNION ALL SELECT 'shared_raw_blocks', (SELECT count(*) FROM cut WHERE n > 0)),
v AS (SELECT label, token, m, (label, token) IN (SELECT (label, token) FROM tm WHERE split = 'train') AS known FROM tm WHERE split = 'validation'),
e AS (SELECT label, sum(m)::bigint AS tokens, count(*) AS unique_ids, (ln(sum(m)) - sum(m * ln(m)) / sum(m)) / ln(2) AS bits, count(*) FILTER (NOT known) AS unseen_ids, coalesce(sum(m) FILTER (NOT known), 0)::bigint AS unseen_tokens FROM v GROUP BY label)
SELECT label, segmentation, documents, tokens, unique_ids, round((SELECT b FROM vd) / tokens, 6) AS bytes_per_token, round(bits, 6) AS entropy_bits, unseen_ids, unseen_tokens FROM e, sg""",
    "disjoint_audit": f"""WITH en AS (SELECT doc_id, text, source, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE lang = 'en'),
kept AS (SELECT * FROM en WHERE before < (SELECT greatest(1, sum(length(text))::bigint // 2) FROM en) AND length(text) > 0),
f AS (SELECT 'family overlap' AS audit, count(*) AS findings FROM kept WHERE source IN (SELECT source FROM documents WHERE lang <> 'en')
  UNION ALL SELECT 'text overlap', count(*) FROM kept WHERE {_NORM} IN (SELECT {_NORM} FROM documents WHERE lang <> 'en'))
SELECT audit, findings FROM f WHERE findings > 0""",
}
ORACLES["early_scan"] = ORACLES["scan_stop"]
