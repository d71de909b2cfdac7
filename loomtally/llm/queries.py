"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.llm import alignment, fingerprint, hnsw, hpylm, mixing, packing, pieces, simhash, spelling, token_store, toxicity, url_rules, warc
from loomtally.session import scratch_path
from loomtally.sources.tables import table

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents by source weights 5, 2, 1 takes of each."""
    return mixing.mix_taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_piecewise_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, compared with its edited text and its successor."""
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability under a model of four fifths of them."""
    return hpylm.score_documents(table(spark, sf_dir, "documents"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in at most two bits."""
    return simhash.near_components(table(spark, sf_dir, "documents"), width=3, radius=2)


REVISIT_AFTER = 1000


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page captured once in full and revisited later: what each revisit resolves to."""
    found = warc.resolve_revisits(warc.page_records(table(spark, sf_dir, "pages"), REVISIT_AFTER))
    header = lambda name, alias: F.col("headers")[name].alias(alias)
    return found.select(
        F.expr("record_id div 2").alias("page_id"), "canonical_url", "ts", F.expr("resolved_id div 2").alias("resolved_page_id"), "outcome",
        header("etag", "etag"), header("last-modified", "last_modified"), header("date", "date"), header("content-length", "content_length"), header("cache-control", "cache_control"),
    )


def op6_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), window=1024, end_id=0)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to a store and read back from it."""
    store = scratch_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), store, vocabulary("word_bpe_49k.json"), spaced=False, end_id=2)
    return token_store.read_tokens(spark, store)


def op7_vector_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.95 and its component."""
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity, likeliest grade and whether it is toxic."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by nested host and path rules."""
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, RULES))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces by the agenda and what they decode to, as digests."""
    made = pieces.encode_texts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's near words, form and root over all documents."""
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links of two tokenizers, with the links' counts over all."""
    docs = table(spark, sf_dir, "documents")
    found = alignment.link_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_overlaps")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mix_sources, op2_piecewise_fingerprint, op3_pitman_yor_scores, op4_simhash_components, op5_warc_revisits,
        op6_pack_windows, op7_vector_graphs, op8_token_store, op9_ordinal_toxicity, op10_url_rules, op11_sentence_pieces, op12_spelling_groups,
        op13_token_alignment,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return {
        "op10_url_rules": f"""
WITH rules(h, p, v) AS (VALUES {rules}),
seen AS (
  SELECT row_number() OVER () AS n, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{url_rules.UPPER}', '{url_rules.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT n, max_by(struct_pack(rule := h || p, verdict := v), length(h || p) * 1000 + length(h)) AS best
  FROM seen JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM seen LEFT JOIN fits USING (n)""",
        "op5_warc_revisits": f"""
WITH cut AS (
  SELECT row_number() OVER () AS n, page_id, md5(coalesce(html, '')) AS tag, strlen(coalesce(html, '')) AS bytes,
    regexp_replace(regexp_replace(coalesce(url, ''), '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
split AS (SELECT *, regexp_extract(bare, '(?s)^([^/?]*)', 1) AS h FROM cut),
named AS (
  SELECT *, regexp_replace(regexp_replace(translate(h, '{url_rules.UPPER}', '{url_rules.LOWER}'), ':(80|443)$', ''), '^www\\.', '') ||
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(substr(bare, length(h) + 1), '([?&])({warc.TRACKING})=[^&]*', '\\1', 'g'),
      '&+', '&', 'g'), '\\?&', '?', 'g'), '[?&]$', ''), '/$', '') AS canonical_url
  FROM split),
pairs AS (
  SELECT r.n, r.page_id AS page_id, r.canonical_url AS canonical_url, r.page_id + {REVISIT_AFTER} AS ts, r.tag AS tag, r.page_id % 3 <> 2 AS tagged,
    max_by(struct_pack(id := f.page_id, tag := f.tag, bytes := f.bytes), f.page_id) AS got
  FROM named r JOIN named f ON f.canonical_url = r.canonical_url AND f.page_id < r.page_id + {REVISIT_AFTER}
  GROUP BY ALL),
judged AS (
  SELECT *, CASE WHEN tagged THEN CASE WHEN tag = got.tag THEN 'etag' ELSE 'mismatch' END
    ELSE CASE WHEN page_id = got.id THEN 'last-modified' ELSE 'mismatch' END END AS outcome FROM pairs)
SELECT page_id, canonical_url, ts, CASE WHEN outcome <> 'mismatch' THEN got.id END AS resolved_page_id, outcome,
  CASE WHEN tagged THEN 'W/' || tag WHEN outcome <> 'mismatch' THEN got.tag END AS etag,
  CASE WHEN outcome <> 'mismatch' THEN got.id::varchar ELSE page_id::varchar END AS last_modified, ts::varchar AS date,
  CASE WHEN outcome <> 'mismatch' THEN got.bytes::varchar ELSE '0' END AS content_length,
  CASE WHEN outcome <> 'mismatch' THEN 'max-age=60' END AS cache_control
FROM judged""",
    }
