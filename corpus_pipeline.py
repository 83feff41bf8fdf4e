"""The training-text pipeline: five stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalens.llm import cotrain_quality, decontaminate, minhash_forest, secret_battery, sentencepiece_viterbi
from stratalens.llm.shared import stored

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
NEAR = minhash_forest.Forest(words=5, percent=80, trees=28)

#: SQL can't train classifiers, estimate signatures or segment text; tests hold each stage against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier does not reject."""
    return cotrain_quality.filter_quality(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id."""
    return minhash_forest.drop_near_duplicates(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in the text replaced by a mark."""
    return secret_battery.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids of all documents, and whether the ids decode to the text."""
    found = sentencepiece_viterbi.encode(docs, PIECES, keep=["lang", "source"], round_trip=True)
    n_tokens = F.size("token_ids").cast("long").alias("n_tokens")
    return found.select("doc_id", "lang", "source", n_tokens, "token_ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; each stage before it is a table in the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
