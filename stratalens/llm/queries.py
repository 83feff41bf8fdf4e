"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalens.llm.chat_prefix_tree import prefix_tree, read_back
from stratalens.llm.cotrain_quality import fit as fit_quality, score_quality
from stratalens.llm.crf_language import fit as fit_language, held_out, identify
from stratalens.llm.decontaminate import contamination
from stratalens.llm.dialog_repair import damaged, repair
from stratalens.llm.external_shuffle import external_shuffle
from stratalens.llm.minhash_forest import near_duplicates
from stratalens.llm.secret_battery import secrets
from stratalens.llm.sentencepiece_viterbi import encode
from stratalens.llm.simhash_bktree import near_fingerprints
from stratalens.llm.spelling_variants import variants, vocabulary
from stratalens.llm.url_filter import host_of, judge_urls
from stratalens.llm.weighted_fingerprints import edited_likeness

PIECES = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, as a prefix tree and read back from it."""
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(*prefix_tree(turns.union(tricky)))


@query
def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 85 % of their three-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return edited_likeness(table(spark, sf_dir, "documents"))


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items each document overlaps."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a random order, in 24 shards by the law of equal row counts."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    return external_shuffle(table(spark, sf_dir, "documents")).select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets(table(spark, sf_dir, "documents"))


URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL; listed are the canonical URLs of pages on hosts with a hyphenated name."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, pages.where(host_of(F.col("url")).contains("-")).select("url"), URL_RULES)


_HOST = "translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op4_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, coalesce({_HOST}, '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    coalesce(regexp_extract(url, '^.*?://[^?#]*\\?([^#]*)', 1, 's'), '') AS query, contains(url, '://') AS whole
  FROM pages
), named AS (
  SELECT page_id, host, path, CASE WHEN whole THEN
    regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END END AS canonical_url
  FROM (SELECT *, list_filter(string_split(query, '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)')) AS kept FROM parts)
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' END AS rule,
    canonical_url IS NOT NULL AND canonical_url IN (SELECT canonical_url FROM named WHERE contains(host, '-') AND canonical_url IS NOT NULL) AS found
  FROM named
)
SELECT page_id, host, path, rule, canonical_url, found AS listed,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN found THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query
def op6_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether they decode to the text."""
    ids = encode(table(spark, sf_dir, "documents"), PIECES, round_trip=True)
    return ids.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


@query
def op7_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from the training fold."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_language(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op8_cotrain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by text, by metadata and by both, and which are kept."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents after damage, their near words, forms and roots."""
    words = vocabulary(table(spark, sf_dir, "documents"), damage=199)
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and components of those at two or fewer differing bits."""
    found = near_fingerprints(table(spark, sf_dir, "documents"))
    mark = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", mark.alias("fingerprint"), "component_id")


@query
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of all conversations after damage, and their cheapest repair."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(turns))
    every = turns.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, F.col("conv_id").cast("string").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
