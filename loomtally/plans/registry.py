"""The operators as queries over the shared tables, and DuckDB SQL for the same rows.

In all of them pos is doc_id, a document's family its source (or language and source), path
`*.py` its being English, and every query reads whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.functions.codes import BOS, BYTE_VOCABULARY, EOS, PAD
from loomtally.functions.text import SPACE_RE2, case_folding, casefold, lexemes, portable_key, text_sha256
from loomtally.operators import audit, blocks, compare, dedup, encode, reference_index, score, select, split
from loomtally.session import durable, scratch_path
from loomtally.sources.tables import spread, table

BLOCK_BYTES, CONTEXT, SHORT, THRESHOLD = 128, 128, 2000, Fraction(17, 20)
SEED, REPLICATES = 2026, 400
_R = 6  # decimals of doubles: sums of doubles depend on their order


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").withColumn("pos", F.col("doc_id"))


def heavy_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The same for stages that cost much for each document."""
    return spread(table(spark, folder, "documents")).withColumn("pos", F.col("doc_id"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, _R).alias(c) if c in names else F.col(c) for c in df.columns])


# -- partitions, identity, duplicates ------------------------------------------------


def partition_stats(spark: SparkSession, folder: str) -> DataFrame:
    return audit.partition_stats(documents(spark, folder), "lang")


def ordered_hash(spark: SparkSession, folder: str) -> DataFrame:
    return audit.ordered_hash(documents(spark, folder), "lang")


def tree_hash(spark: SparkSession, folder: str) -> DataFrame:
    return audit.tree_hash(documents(spark, folder), "lang")


def folded_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's hash under full case folding, and whether lowering gives another one."""
    docs = documents(spark, folder).withColumn("folded", casefold(F.col("text")))
    return docs.select("doc_id", text_sha256(F.col("folded")).alias("folded_sha256"), (F.col("folded") != F.lower("text")).alias("unlike_lower"))


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_dedup(documents(spark, folder)).withColumnRenamed("pos", "doc_id")


def whitespace_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.whitespace_dedup(heavy_documents(spark, folder)).withColumnRenamed("pos", "doc_id")


def _files(docs: DataFrame) -> DataFrame:
    return docs.select("pos", "text", F.concat("source", F.when(F.col("lang") == "en", ".PY").otherwise(".txt")).alias("path"), F.col("source").alias("family"))


def select_reasons(spark: SparkSession, folder: str) -> DataFrame:
    reasons = select.file_reasons(_files(heavy_documents(spark, folder)))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("documents"), F.min("pos").alias("first_doc"))


def candidate_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as candidates, a (language, source) pair their family; references are the
    documents labelled of low quality and toxic."""
    docs = heavy_documents(spark, folder)
    files = _files(docs).join(docs.select("pos", F.concat_ws("/", "lang", "source").alias("_family")), "pos").withColumn("family", F.col("_family")).drop("_family")
    bad = table(spark, folder, "labels").where("quality = 0 and toxic = 1").select("doc_id")
    refs = docs.join(bad, "doc_id", "left_semi").select("text", F.concat_ws("/", "lang", "source").alias("family"))
    return select.candidate_reasons(files, refs).groupBy("reason").agg(F.count(F.lit(1)).alias("documents"), F.min("pos").alias("first_doc"))


def family_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a (language, source) family without a document labelled of low quality, and
    whose text is no benchmark passage."""
    docs = documents(spark, folder).withColumn("family", F.concat_ws("/", "lang", "source"))
    bad = docs.join(table(spark, folder, "labels").where("quality = 0 and toxic = 1").select("doc_id"), "doc_id", "left_semi").select("family").distinct()
    kept = docs.join(bad, "family", "left_anti")
    return dedup.exclude_texts(kept, table(spark, folder, "benchmark")).select("doc_id", "family")


# -- splits and budgets ----------------------------------------------------------------


def _tenth(df: DataFrame) -> int:
    return max(1, -(-df.count() // 10))


def document_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    n = _tenth(docs)
    return split.document_split(docs, n, n, SEED).withColumnRenamed("pos", "doc_id")


def _families(docs: DataFrame) -> DataFrame:
    keyed = docs.withColumn("family", F.col("source"))
    n = _tenth(keyed)
    return split.group_split(keyed, n, n, SEED)


def group_split(spark: SparkSession, folder: str) -> DataFrame:
    return _families(documents(spark, folder)).withColumnRenamed("family", "source")


def character_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """The first half of all characters, in order of doc_id."""
    docs = documents(spark, folder)
    half = docs.agg(F.sum(F.length("text"))).first()[0] // 2
    return select.character_prefix(docs.select("pos", "text"), half).select(F.col("pos").alias("doc_id"), F.length("text").alias("kept"), text_sha256(F.col("text")).alias("sha256"))


def overlap_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    named = docs.join(_families(docs).select(F.col("family").alias("source"), "split"), "source")
    return audit.overlaps(named, "split")


# -- near-duplicates -------------------------------------------------------------------


def shingle_stats(spark: SparkSession, folder: str) -> DataFrame:
    docs = heavy_documents(spark, folder)
    sets = dedup.shingle_sets(docs).select("pos", "n")
    return docs.select("pos", F.size(lexemes(F.col("text"))).alias("lexemes")).join(sets, "pos").select(F.col("pos").alias("doc_id"), "lexemes", F.col("n").alias("shingles"))


def _near_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sets = durable(dedup.shingle_sets(heavy_documents(spark, folder)).withColumn("anchor", F.lit(False)), "shingle-sets")
    return dedup.near_pairs(sets, THRESHOLD)


def near_dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs between the first documents of classes of equal sets."""
    return _near_sets(spark, folder)[1].select("earlier", "later", F.round(dedup.jaccard(), _R).alias("jaccard"))


def near_dup_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every document: the first document with an equal set of shingles."""
    sets = durable(dedup.shingle_sets(heavy_documents(spark, folder)).withColumn("anchor", F.lit(False)), "shingle-sets")
    return dedup.set_classes(sets).select(F.col("pos").alias("doc_id"), F.col("n").alias("shingles"), F.col("rep").alias("class_id"))


def near_dup_survivors(spark: SparkSession, folder: str) -> DataFrame:
    state, removals = dedup.near_dedup(heavy_documents(spark, folder), THRESHOLD)
    return state.join(removals, "pos", "left").select(F.col("pos").alias("doc_id"), "kept", F.col("retained").alias("retained_id"), F.round("jaccard", _R).alias("jaccard"))


def anchor_contamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents against the benchmark's passages, which are never removed (positions below 0)."""
    refs = table(spark, folder, "benchmark").select((-1 - F.col("item_id")).alias("pos"), "text")
    cands = heavy_documents(spark, folder).select("pos", "text")
    state, rejected = dedup.anchored_dedup(refs, cands, THRESHOLD)
    return state.join(rejected, "pos", "left").select(F.col("pos").alias("doc_id"), "kept", "retained", F.round("jaccard", _R).alias("jaccard"), "anchor_is_reference")


def anchor_index(spark: SparkSession, folder: str) -> DataFrame:
    """The same, asked of an index of the passages that is written before."""
    path = scratch_path(spark, "reference-index")
    reference_index.build(table(spark, folder, "benchmark").select((-1 - F.col("item_id")).alias("pos"), "text"), path, THRESHOLD, buckets=8)
    state, rejected = reference_index.ReferenceIndex(spark, path).filter(heavy_documents(spark, folder).select("pos", "text"))
    return state.join(rejected, "pos", "left").select(F.col("pos").alias("doc_id"), "kept", "retained", F.round("jaccard", _R).alias("jaccard"), "anchor_is_reference")


# -- blocks and windows ----------------------------------------------------------------


def raw_blocks(spark: SparkSession, folder: str) -> DataFrame:
    made = blocks.raw_blocks(heavy_documents(spark, folder), BLOCK_BYTES)
    return made.select(F.col("pos").alias("doc_id"), "block_pos", F.length("block").alias("characters"), F.md5("block").alias("block_md5"))


def block_rollup(spark: SparkSession, folder: str) -> DataFrame:
    docs = heavy_documents(spark, folder)
    return blocks.block_rollup(docs, blocks.raw_blocks(docs, BLOCK_BYTES)).withColumnRenamed("pos", "doc_id")


def _joined(ids: str) -> F.Column:
    return F.md5(F.array_join(F.col(ids).cast("array<string>"), ","))


def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    made = blocks.chunk_windows(score.byte_documents(heavy_documents(spark, folder)), CONTEXT, BOS)
    return made.select(F.col("pos").alias("doc_id"), "win", F.size("labels").alias("scored"), _joined("inputs").alias("inputs_md5"), _joined("labels").alias("labels_md5"))


def rolling_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Rolling windows of CONTEXT over all documents: what each document's hold."""

    def fold(views: blocks.RollingViews) -> tuple[int, int, int, int]:
        sums, win = np.concatenate([[0], np.cumsum(views.buffer)]), np.arange(len(views))
        inputs = (sums[views.ends] - sums[views.starts]) * (win % 1000 + 1)
        return len(views), int((views.ends - views.starts).sum()), int((views.labels * (win + 1)).sum()), int(inputs.sum())

    coded = score.byte_documents(heavy_documents(spark, folder))
    return blocks.over_rolling(coded, CONTEXT, BOS, lambda: fold, "windows long, context long, labels long, inputs long").withColumnRenamed("pos", "doc_id")


def encoded_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded by a public vocabulary, each distinct pretoken once, and decoded."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = durable(encode.encoded_once(heavy_documents(spark, folder), path), "encoded")
    back = encode.decoded(coded, path).select(F.col("pos").alias("doc_id"), text_sha256(F.col("decoded")).alias("decoded_sha256"))
    return coded.select(F.col("pos").alias("doc_id"), "characters", "utf8_bytes").join(back, "doc_id")


def packed_windows(spark: SparkSession, folder: str) -> DataFrame:
    made = blocks.packed_windows(score.byte_documents(heavy_documents(spark, folder)), CONTEXT, BOS, EOS)
    return made.select("win", _joined("inputs").alias("inputs_md5"), F.element_at("labels", -1).alias("last_label"))


# -- tokens and baselines --------------------------------------------------------------


def _arms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training, validation, all with split): byte histograms by the source split, made once."""
    docs = documents(spark, folder)
    named = docs.join(F.broadcast(_families(docs).select(F.col("family").alias("source"), "split")), "source")  # a row for each source
    coded = durable(score.byte_histograms(named.withColumn("sha256", text_sha256(F.col("text"))), ("split", "lang", "source", "sha256")), "histograms")
    return coded.where("split = 'train'"), coded.where("split = 'validation'"), coded


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return score.token_counts(score.byte_histograms(documents(spark, folder)))


def top_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return score.top_tokens(score.byte_histograms(documents(spark, folder)), 20)


def vocab_usage(spark: SparkSession, folder: str) -> DataFrame:
    used = score.vocabulary_usage(score.byte_histograms(documents(spark, folder)), BYTE_VOCABULARY, (BOS, PAD, EOS))
    return _rounded(used, "characters_per_token", "bytes_per_token", "tokens_per_byte", "fraction_vocabulary", "fraction_noncontrol", "entropy_bits", "effective_vocabulary")


def unseen_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Byte tokens of documents in other languages that the English ones lack."""
    docs = documents(spark, folder)
    return _rounded(score.unseen_tokens(score.byte_histograms(docs.where("lang = 'en'")), score.byte_histograms(docs.where("lang <> 'en'"))), "unseen_fraction")


def unigram_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Add-one byte unigram of the training sources, per validation document. Flagship query."""
    train, valid, _ = _arms(spark, folder)
    scores = score.unigram_nll(train, valid, BYTE_VOCABULARY)
    bpb = F.when(F.col("utf8_bytes") > 0, F.col("nll_nats") / (F.col("utf8_bytes") * score.LN2))
    return scores.select(F.col("pos").alias("doc_id"), "scored_tokens", F.round("nll_nats", _R).alias("nll_nats"), F.round(bpb, _R).alias("bits_per_utf8_byte"))


def uniform_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Both baselines over all validation documents."""
    train, valid, _ = _arms(spark, folder)
    scores = durable(score.unigram_nll(train, valid, BYTE_VOCABULARY, eos=EOS), "scores")
    doubles = ("nll_nats", "nats_per_token", "perplexity", "bits_per_character", "bits_per_utf8_byte", "characters_per_token")
    both = score.summarize(scores, "uniform_nats").withColumn("baseline", F.lit("uniform")).unionByName(score.summarize(scores).withColumn("baseline", F.lit("unigram")))
    return both.select("baseline", "document_count", "scored_tokens", "text_tokens", "characters", "utf8_bytes", *[F.round(c, 4).alias(c) for c in doubles])


# -- comparisons -----------------------------------------------------------------------


def _pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(paired arms over validation documents, source of each): unigrams of English and of
    other training documents."""
    train, valid, _ = _arms(spark, folder)
    arms = [score.unigram_nll(t, valid, BYTE_VOCABULARY, keep=("sha256",)) for t in (train.where("lang = 'en'"), train.where("lang <> 'en'"))]
    return durable(compare.paired(*[durable(a, "arm") for a in arms]), "paired"), valid.select("pos", F.col("source").alias("group"))


def paired_difference(spark: SparkSession, folder: str) -> DataFrame:
    pairs, _ = _pair(spark, folder)
    return _rounded(compare.paired_difference(pairs), "nll_nats", "bits_per_utf8_byte", "bits_per_character", "token_ratio", "token_reduction")


def _numbered(units: DataFrame, key: str) -> DataFrame:
    from loomtally.operators.ordered import running_before

    keyed = durable(units.withColumn("_k", portable_key(0, F.col(key))).withColumn("_one", F.lit(1)), "units")
    return running_before(keyed, "_one", ["_k", key], out="unit").drop("_k", "_one")


def document_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    pairs, _ = _pair(spark, folder)
    units = durable(_numbered(pairs.select("pos", "delta", "utf8_bytes"), "pos"), "units")
    return _rounded(compare.bootstrap(units, REPLICATES, 0), "low", "high")


def group_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    pairs, groups = _pair(spark, folder)
    units = durable(_numbered(compare.group_totals(pairs, groups), "group"), "units")
    return _rounded(compare.bootstrap(units, REPLICATES, 31415), "low", "high")


def seed_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Sources stand for seeds: bits per byte of each source's validation and test documents
    under the unigrams of English and of other training documents."""
    train, _, coded = _arms(spark, folder)
    held = coded.where("split <> 'train'")
    arms = []
    for name, t in (("fit_bpb", train.where("lang = 'en'")), ("general_bpb", train.where("lang <> 'en'"))):
        s = score.unigram_nll(t, held, BYTE_VOCABULARY, keep=("split", "source"))
        arms.append(s.groupBy("split", "source").agg((F.sum("nll_nats") / (F.sum("utf8_bytes") * score.LN2)).alias(name)))
    values = arms[0].join(arms[1], ["split", "source"]).select(F.col("split").alias("regime"), F.col("source").alias("seed"), "fit_bpb", "general_bpb")
    doubles = ("fit_mean_bpb", "general_mean_bpb", "paired_mean_bpb", "paired_sd", "paired_min", "paired_max", "relative_mean_difference")
    return _rounded(compare.seed_summary(values), *doubles)


def model_size_search(spark: SparkSession, folder: str) -> DataFrame:
    """For each language the width of a model of its words that has a parameter for each byte of it."""
    docs = documents(spark, folder)
    words = docs.select("lang", F.explode(F.split("text", " ")).alias("w")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("vocab"))
    corpora = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("target")).join(words, "lang")
    return compare.size_search(corpora).select("lang", "vocab", "target", "dim", "parameters")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        partition_stats, ordered_hash, tree_hash, folded_texts, exact_dedup, whitespace_dedup, select_reasons, candidate_reasons, family_exclusion, document_split, group_split,
        character_prefix, overlap_audit, shingle_stats, near_dup_pairs, near_dup_classes, near_dup_survivors, anchor_contamination, anchor_index, raw_blocks, block_rollup, chunk_windows,
        rolling_windows, encoded_roundtrip, packed_windows, token_counts, top_tokens, vocab_usage, unseen_tokens, unigram_baseline, uniform_baseline, paired_difference,
        document_bootstrap, group_bootstrap, seed_summary, model_size_search,
    )
}

# -- the same in DuckDB ----------------------------------------------------------------

_NORM = f"trim(regexp_replace(text, '[{SPACE_RE2}]+', ' ', 'g'), ' ')"
_FOLDED = "translate(text, '{}', '{}')".format("".join(case_folding()[0]), "".join(case_folding()[0].values()))
for _c, _f in case_folding()[1].items():
    _FOLDED = f"replace({_FOLDED}, '{_c}', '{_f}')"
_LEX = rf"regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE_RE2}]')"


def _key(seed: int, column: str) -> str:
    return f"cast('0x' || substr(md5('{seed}|' || {column}), 1, 15) AS bigint)"


_SIZE = "greatest(1, cast(ceil((SELECT count(*) FROM documents) / 10.0) AS bigint))"
_FAMILIES = f"""
sized AS (SELECT source, count(*) AS documents, {_key(SEED, 'source')} AS k FROM documents GROUP BY source),
placed AS (SELECT *, coalesce(sum(documents) OVER (ORDER BY k, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sized),
families AS (SELECT source, documents, CASE WHEN b < {_SIZE} THEN 'validation'
  WHEN b - (SELECT max(b + documents) FROM placed WHERE b < {_SIZE}) < {_SIZE} THEN 'test' ELSE 'train' END AS split FROM placed)"""
_BYTES = """
bytes AS (SELECT doc_id, cast('0x' || h AS int) AS token, count(*) AS m
  FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY ALL),
named AS (SELECT d.doc_id, d.lang, d.source, f.split, length(d.text) AS characters, strlen(d.text) AS utf8_bytes, sha256(d.text) AS sha
  FROM documents d JOIN families f USING (source))"""


def _scores(name: str, train: str, held: str, eos: bool = False) -> str:
    ends = f" UNION ALL SELECT {EOS}, (SELECT count(*) FROM named WHERE {train})" if eos else ""
    own = f" UNION ALL SELECT doc_id, {EOS}, 1 FROM named" if eos else ""
    return f"""
{name}_c AS (SELECT token, sum(m) AS c FROM (SELECT token, m FROM bytes JOIN named USING (doc_id) WHERE {train}{ends}) GROUP BY token),
{name} AS (SELECT n.doc_id, n.source, n.split, n.sha, n.characters, n.utf8_bytes, n.utf8_bytes + {int(eos)} AS scored,
  coalesce(sum(b.m * (ln((SELECT sum(c) FROM {name}_c) + {BYTE_VOCABULARY}.0::double) - ln(coalesce(c.c, 0) + 1.0::double))), 0) AS nll
  FROM named n LEFT JOIN (SELECT * FROM bytes{own}) b USING (doc_id) LEFT JOIN {name}_c c USING (token) WHERE {held} GROUP BY ALL)"""


_PAIRED = f"WITH {_FAMILIES}, {_BYTES}, {_scores('f', 'split = $$train$$ AND lang = $$en$$', 'split = $$validation$$')}, {_scores('g', 'split = $$train$$ AND lang <> $$en$$', 'split = $$validation$$')}, p AS (SELECT f.doc_id, f.source, f.characters, f.utf8_bytes, f.nll - g.nll AS delta FROM f JOIN g USING (doc_id))"


def _bootstrap(units: str, seed: int) -> str:
    return f"""{_PAIRED}, u AS ({units}), n AS (SELECT count(*) AS n FROM u),
draws AS (SELECT r, cast('0x' || substr(md5('{seed}|' || r || '|' || s), 1, 8) AS bigint) % (SELECT n FROM n) AS unit
  FROM range({REPLICATES}) t(r), range((SELECT n FROM n)) t2(s)),
v AS (SELECT r, sum(delta) / sum(utf8_bytes) / ln(2) AS v FROM draws JOIN u USING (unit) GROUP BY r)
SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, (SELECT n FROM n) AS units FROM v"""


_LOW = "(SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 1))"


def _reasons(source: str, checks: str, exact: str, space: str, taken: str | None) -> str:
    old = f"old AS (SELECT sha256(text) AS s, sha256({_NORM}) AS w FROM ({taken}))," if taken else ""
    first = (f"WHEN f.sha IN (SELECT s FROM old) THEN '{exact}' WHEN f.norm IN (SELECT w FROM old) THEN '{space}' " if taken else "")
    return f"""WITH {old} judged AS (SELECT doc_id, sha256(text) AS sha, sha256({_NORM}) AS norm, {checks} AS r FROM ({source})),
fit AS (SELECT *, first(sha) OVER w AS fs, row_number() OVER w AS k FROM judged WHERE r IS NULL WINDOW w AS (PARTITION BY norm ORDER BY doc_id)),
named AS (SELECT doc_id, CASE {first}WHEN k = 1 THEN 'selected' WHEN sha = fs THEN '{exact}' ELSE '{space}' END AS reason FROM fit f
  UNION ALL SELECT doc_id, r FROM judged WHERE r IS NOT NULL)
SELECT reason, count(*) AS documents, min(doc_id) AS first_doc FROM named GROUP BY reason"""


def _sets(source: str) -> str:
    return f"""
lex AS (SELECT doc_id, {_LEX} AS t FROM {source}),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(t) < 5 THEN [hash(array_to_string(t, chr(1)))]
    ELSE list_transform(range(1, len(t) - 3), lambda i: hash(array_to_string(t[i:i+4], chr(1)))) END) AS s FROM lex)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s::varchar, ',' ORDER BY s)) AS key FROM sh GROUP BY doc_id)"""


def _near(source: str, first: str, order: str, free: str = "true") -> str:
    """m: doc_id, n, rep; p: pairs between the first documents of classes of equal sets."""
    return f"""{_sets(source)},
m AS (SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY key, doc_id >= 0 ORDER BY {first}) AS rep FROM n),
f AS (SELECT s FROM sh JOIN m USING (doc_id) WHERE doc_id = rep GROUP BY s HAVING count(*) > 1),
q AS (SELECT doc_id, s, n FROM sh JOIN f USING (s) JOIN m USING (doc_id) WHERE doc_id = rep),
o AS (SELECT a.doc_id AS earlier, b.doc_id AS later, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM q a JOIN q b ON a.s = b.s AND {order} AND {free} AND least(a.n, b.n) * 20 >= greatest(a.n, b.n) * 17 GROUP BY ALL),
p AS (SELECT earlier, later, nb, o / (na + nb - o) AS j FROM o WHERE o * 20 >= 17 * (na + nb - o))"""


_SETS = _sets("documents")
_NEAR = _near("documents", "doc_id", "(a.n, a.doc_id) < (b.n, b.doc_id)")
_NEAR_ANCHORED = _near("(SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)", "doc_id >= 0, doc_id", "(a.doc_id >= 0, a.doc_id) < (b.doc_id >= 0, b.doc_id)", "b.doc_id >= 0")
_WALK_BY = """
k AS (SELECT later AS id, list(earlier) AS nb, row_number() OVER (ORDER BY {order}) AS i FROM p GROUP BY later),
walk(i, gone) AS (SELECT 0::bigint, []::bigint[] UNION ALL
  SELECT k.i, CASE WHEN len(list_filter(nb, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, id) ELSE gone END FROM walk w JOIN k ON k.i = w.i + 1),
gone AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM walk ORDER BY i DESC LIMIT 1))"""
_WALK = _WALK_BY.format(order="any_value(nb), later")
_WINDOWS = """coded AS (SELECT {key} AS id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: cast('0x' || h AS int)) AS ids FROM {table})"""

ORACLES: dict[str, str] = {
    "partition_stats": "SELECT lang, count(*) AS documents, sum(length(text))::bigint AS characters, sum(strlen(text))::bigint AS utf8_bytes FROM documents GROUP BY lang",
    "ordered_hash": """SELECT lang, sha256('["' || string_agg(sha256(text), '","' ORDER BY doc_id) || '"]') AS ordered_text_sha256 FROM documents GROUP BY lang""",
    "tree_hash": f"""WITH t0 AS (SELECT lang, doc_id AS n, sha256(text) AS h FROM documents), {', '.join(f"t{i} AS (SELECT lang, n // 1024 AS n, sha256(string_agg(n || ':' || h, ',' ORDER BY n)) AS h FROM t{i - 1} GROUP BY lang, n // 1024)" for i in (1, 2, 3))}
SELECT lang, sha256(string_agg(n || ':' || h, ',' ORDER BY n)) AS tree_sha256 FROM t3 GROUP BY lang""",
    "folded_texts": f"SELECT doc_id, sha256({_FOLDED}) AS folded_sha256, {_FOLDED} <> lower(text) AS unlike_lower FROM documents",
    "exact_dedup": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "whitespace_dedup": f"SELECT sha256({_NORM}) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "select_reasons": _reasons("SELECT * FROM documents", "CASE WHEN length(text) NOT BETWEEN 200 AND 20000 THEN 'outside_size_bounds' WHEN lang <> 'en' THEN 'non_python_path' END", "exact_duplicates", "whitespace_duplicates", None),
    "candidate_reasons": _reasons(
        "SELECT * FROM documents",
        f"CASE WHEN lang || '/' || source IN (SELECT lang || '/' || source FROM {_LOW}) THEN 'excluded_reference_family' WHEN length(text) NOT BETWEEN 200 AND 20000 THEN 'outside_size_bounds' WHEN lang <> 'en' THEN 'non_python_path' END",
        "exact_duplicate",
        "whitespace_duplicate",
        f"SELECT text FROM {_LOW}",
    ),
    "family_exclusion": """SELECT doc_id, lang || '/' || source AS family FROM documents
WHERE lang || '/' || source NOT IN (SELECT lang || '/' || source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 1)
  AND sha256(text) NOT IN (SELECT sha256(text) FROM benchmark)""",
    "document_split": f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {_key(SEED, 'doc_id')}, doc_id) - 1 AS b FROM documents)
SELECT doc_id, CASE WHEN b < {_SIZE} THEN 'validation' WHEN b < 2 * {_SIZE} THEN 'test' ELSE 'train' END AS split FROM o""",
    "group_split": f"WITH {_FAMILIES} SELECT source, documents, split FROM families",
    "character_prefix": """WITH h AS (SELECT sum(length(text))::bigint // 2 AS h FROM documents),
b AS (SELECT doc_id, text, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS b FROM documents),
c AS (SELECT doc_id, substr(text, 1, least(length(text), h - b)) AS t FROM b, h WHERE b < h AND length(text) > 0)
SELECT doc_id, length(t) AS kept, sha256(t) AS sha256 FROM c""",
    "overlap_audit": f"""WITH {_FAMILIES}, t AS (SELECT DISTINCT split, sha256(text) AS s FROM documents JOIN families USING (source))
SELECT a.split AS first, b.split AS second, count(*) AS texts FROM t a JOIN t b ON a.s = b.s AND a.split < b.split GROUP BY ALL""",
    "shingle_stats": f"WITH {_SETS} SELECT doc_id, len(t) AS lexemes, n AS shingles FROM lex JOIN n USING (doc_id)",
    "near_dup_pairs": f"WITH {_NEAR} SELECT earlier, later, round(j, 6) AS jaccard FROM p",
    "near_dup_classes": f"WITH {_NEAR} SELECT doc_id, n AS shingles, rep AS class_id FROM m",
    "near_dup_survivors": f"""WITH RECURSIVE {_NEAR}, {_WALK},
y AS (SELECT rep AS rep_of, rep AS near, 1.0::double AS j FROM m UNION SELECT later, earlier, j FROM p UNION SELECT earlier, later, j FROM p),
x AS (SELECT m.doc_id, m.doc_id = m.rep AND m.rep NOT IN (SELECT id FROM gone) AS kept, m.n, m.rep FROM m),
r AS (SELECT x.doc_id, min(near) AS retained_id, arg_min(j, near) AS j FROM x JOIN y ON y.rep_of = x.rep JOIN m k ON k.doc_id = near
  WHERE NOT kept AND near NOT IN (SELECT id FROM gone) AND (k.n, near) < (x.n, x.doc_id) GROUP BY x.doc_id)
SELECT x.doc_id, kept, retained_id, round(j, 6) AS jaccard FROM x LEFT JOIN r USING (doc_id)""",
    "anchor_contamination": f"""WITH RECURSIVE {_NEAR_ANCHORED}, {_WALK_BY.format(order='later')},
y AS (SELECT rep AS rep_of, rep AS near, 1.0::double AS j FROM m UNION SELECT later, earlier, j FROM p UNION SELECT earlier, later, j FROM p),
x AS (SELECT m.doc_id, m.doc_id = m.rep AND m.rep NOT IN (SELECT id FROM gone) AS kept, m.rep FROM m WHERE doc_id >= 0),
r AS (SELECT x.doc_id, arg_min(near, (near >= 0, near)) AS retained, arg_min(j, (near >= 0, near)) AS j FROM x JOIN y ON y.rep_of = x.rep
  WHERE NOT kept AND near NOT IN (SELECT id FROM gone) AND (near >= 0, near) < (true, x.doc_id) GROUP BY x.doc_id)
SELECT x.doc_id, kept, retained, round(j, 6) AS jaccard, retained < 0 AS anchor_is_reference FROM x LEFT JOIN r USING (doc_id)""",
    "raw_blocks": f"""WITH RECURSIVE cut(doc_id, block_pos, block, rest) AS (
  SELECT doc_id, -1::bigint, '', text FROM documents
  UNION ALL
  SELECT doc_id, block_pos + 1, substr(rest, 1, k), substr(rest, k + 1) FROM (
    SELECT *, list_max(list_filter(range(1, {BLOCK_BYTES + 1}), lambda x: strlen(substr(rest, 1, x)) <= {BLOCK_BYTES})) AS k FROM cut WHERE rest <> ''))
SELECT doc_id, block_pos, length(block) AS characters, md5(block) AS block_md5 FROM cut WHERE block_pos >= 0""",
    "chunk_windows": f"""WITH {_WINDOWS.format(key='doc_id', table='documents')},
w AS (SELECT id, ids, [{BOS}] || ids[:len(ids) - 1] AS inp, unnest(range((len(ids) - 1) // {CONTEXT} + 1)) AS win FROM coded WHERE len(ids) > 0)
SELECT id AS doc_id, win, len(ids[win * {CONTEXT} + 1:(win + 1) * {CONTEXT}]) AS scored, md5(array_to_string(inp[win * {CONTEXT} + 1:(win + 1) * {CONTEXT}], ',')) AS inputs_md5,
  md5(array_to_string(ids[win * {CONTEXT} + 1:(win + 1) * {CONTEXT}], ',')) AS labels_md5 FROM w""",
    "rolling_windows": f"""WITH {_WINDOWS.format(key='doc_id', table='documents')},
w AS (SELECT id, unnest(range(len(ids))) AS win, unnest(ids) AS label, unnest([{BOS}] || ids[:len(ids) - 1]) AS x FROM coded WHERE len(ids) > 0),
e AS (SELECT id, win, label, count(*) OVER f AS context, sum(x) OVER f AS s FROM w WINDOW f AS (PARTITION BY id ORDER BY win ROWS BETWEEN {CONTEXT - 1} PRECEDING AND CURRENT ROW))
SELECT id AS doc_id, count(*) AS windows, sum(context)::bigint AS context, sum(label * (win + 1))::bigint AS labels, sum(s * (win % 1000 + 1))::bigint AS inputs FROM e GROUP BY id""",
    "encoded_roundtrip": "SELECT doc_id, length(text) AS characters, strlen(text) AS utf8_bytes, sha256(text) AS decoded_sha256 FROM documents",
    "packed_windows": f"""WITH {_WINDOWS.format(key='doc_id', table='documents')},
s AS (SELECT 0::bigint AS g, {BOS} AS token UNION ALL
  SELECT row_number() OVER (ORDER BY id, i), token FROM (SELECT id, unnest(range(len(ids) + 1)) AS i, unnest(ids || [{EOS}]) AS token FROM coded)),
l AS (SELECT g, token, lead(token) OVER (ORDER BY g) AS label FROM s)
SELECT g // {CONTEXT} AS win, md5(string_agg(token::varchar, ',' ORDER BY g)) AS inputs_md5, arg_max(label, g) AS last_label FROM l
GROUP BY 1 HAVING count(label) = {CONTEXT}""",
    "token_counts": """SELECT cast('0x' || h AS int) AS token, count(*) AS count FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY 1""",
    "top_tokens": """SELECT cast('0x' || h AS int) AS token, count(*) AS count FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "vocab_usage": f"""WITH c AS (SELECT h, count(*) AS c FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY h),
e AS (SELECT sum(c)::bigint AS t, count(*) AS u, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS e FROM c),
d AS (SELECT count(*) AS d, sum(length(text))::bigint AS ch, sum(strlen(text))::bigint AS b FROM documents)
SELECT d AS documents, t AS tokens, ch AS characters, b AS utf8_bytes, u AS unique_ids, round(ch / t, 6) AS characters_per_token, round(b / t, 6) AS bytes_per_token,
  round(t / b, 6) AS tokens_per_byte, round(u / {BYTE_VOCABULARY}, 6) AS fraction_vocabulary, round(u / {BYTE_VOCABULARY - 3}, 6) AS fraction_noncontrol,
  round(e / ln(2), 6) AS entropy_bits, round(exp(e), 6) AS effective_vocabulary FROM e, d""",
    "unseen_tokens": """WITH c AS (SELECT en, h, count(*) AS c FROM (SELECT lang = 'en' AS en, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY ALL),
o AS (SELECT *, h NOT IN (SELECT h FROM c WHERE en) AS gone FROM c WHERE NOT en)
SELECT count(*) FILTER (gone) AS unseen_ids, coalesce(sum(c) FILTER (gone), 0)::bigint AS unseen_tokens, round(coalesce(sum(c) FILTER (gone), 0) / sum(c), 6) AS unseen_fraction FROM o""",
    "unigram_baseline": f"""WITH {_FAMILIES}, {_BYTES}, {_scores('s', 'split = $$train$$', 'split = $$validation$$')}
SELECT doc_id, scored AS scored_tokens, round(nll, 6) AS nll_nats, CASE WHEN utf8_bytes > 0 THEN round(nll / (utf8_bytes * ln(2)), 6) END AS bits_per_utf8_byte FROM s""",
    "uniform_baseline": f"""WITH {_FAMILIES}, {_BYTES}, {_scores('s', 'split = $$train$$', 'split = $$validation$$', True)},
a AS (SELECT 'unigram' AS baseline, * FROM s UNION ALL SELECT 'uniform', * REPLACE (scored * ln({BYTE_VOCABULARY}) AS nll) FROM s)
SELECT baseline, count(*) AS document_count, sum(scored)::bigint AS scored_tokens, sum(utf8_bytes)::bigint AS text_tokens, sum(characters)::bigint AS characters, sum(utf8_bytes)::bigint AS utf8_bytes,
  round(sum(nll), 4) AS nll_nats, round(sum(nll) / sum(scored), 4) AS nats_per_token, round(exp(sum(nll) / sum(scored)), 4) AS perplexity,
  round(sum(nll) / (sum(characters) * ln(2)), 4) AS bits_per_character, round(sum(nll) / (sum(utf8_bytes) * ln(2)), 4) AS bits_per_utf8_byte, round(sum(characters) / sum(utf8_bytes), 4) AS characters_per_token
FROM a GROUP BY baseline""",
    "paired_difference": f"""{_PAIRED} SELECT round(sum(delta), 6) AS nll_nats, round(sum(delta) / (sum(utf8_bytes) * ln(2)), 6) AS bits_per_utf8_byte,
  round(sum(delta) / (sum(characters) * ln(2)), 6) AS bits_per_character, 1.0::double AS token_ratio, 0.0::double AS token_reduction FROM p""",
    "document_bootstrap": _bootstrap(f"SELECT row_number() OVER (ORDER BY {_key(0, 'doc_id')}, doc_id) - 1 AS unit, delta, utf8_bytes FROM p", 0),
    "group_bootstrap": _bootstrap(f"SELECT row_number() OVER (ORDER BY {_key(0, 'source')}, source) - 1 AS unit, delta, utf8_bytes FROM (SELECT source, sum(delta) AS delta, sum(utf8_bytes) AS utf8_bytes FROM p GROUP BY source)", 31415),
    "seed_summary": f"""WITH {_FAMILIES}, {_BYTES}, {_scores('f', 'split = $$train$$ AND lang = $$en$$', 'split <> $$train$$')}, {_scores('g', 'split = $$train$$ AND lang <> $$en$$', 'split <> $$train$$')},
v AS (SELECT split AS regime, source, sum(f.nll) / (sum(f.utf8_bytes) * ln(2)) AS a, sum(g.nll) / (sum(f.utf8_bytes) * ln(2)) AS b FROM f JOIN g USING (doc_id, split, source) GROUP BY ALL)
SELECT regime, count(DISTINCT source) AS seed_count, round(avg(a), 6) AS fit_mean_bpb, round(avg(b), 6) AS general_mean_bpb, round(avg(a - b), 6) AS paired_mean_bpb, round(stddev_samp(a - b), 6) AS paired_sd,
  round(min(a - b), 6) AS paired_min, round(max(a - b), 6) AS paired_max, round((avg(a) - avg(b)) / avg(b), 6) AS relative_mean_difference FROM v GROUP BY regime""",
    "model_size_search": """WITH c AS (SELECT lang, count(*) AS vocab FROM (SELECT DISTINCT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY lang),
t AS (SELECT lang, sum(strlen(text))::bigint AS target FROM documents GROUP BY lang),
s AS (SELECT lang, vocab, target, d AS dim, vocab * d + 512 * d + 8 * (12 * d * d + 13 * d) + 2 * d AS parameters FROM c JOIN t USING (lang), range(8, 2049, 8) r(d))
SELECT lang, vocab, target, arg_min(dim, (abs(parameters - target), dim)) AS dim, arg_min(parameters, (abs(parameters - target), dim)) AS parameters FROM s GROUP BY ALL""",
    "block_rollup": f"""WITH RECURSIVE cut(doc_id, n, rest) AS (
  SELECT doc_id, 0::bigint, text FROM documents
  UNION ALL
  SELECT doc_id, n + 1, substr(rest, list_max(list_filter(range(1, {BLOCK_BYTES + 1}), lambda x: strlen(substr(rest, 1, x)) <= {BLOCK_BYTES})) + 1) FROM cut WHERE rest <> '')
SELECT doc_id, max(n) AS blocks, any_value(length(text)) AS characters, any_value(strlen(text)) AS utf8_bytes, true AS matches FROM cut JOIN documents d USING (doc_id) GROUP BY doc_id""",
}
ORACLES["anchor_index"] = ORACLES["anchor_contamination"]
