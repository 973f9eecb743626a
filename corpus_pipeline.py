"""A training corpus from ``documents``: stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryproof.llm import minhash, mixing, pseudonyms, toxicity, trie_bpe
from queryproof.llm.common import read_table, unused, written
from queryproof.llm.queries import PSEUDONYM_KEY, word_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic; it learns from ``labels``."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    into = unused(docs, "toxic_score", "toxic_predicted")
    return toxicity.score(docs, model, into=into).filter(F.col(into[1]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates, and rows without an id."""
    return minhash.first_of_class(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return pseudonyms.pseudonymize_column(docs, PSEUDONYM_KEY, found=None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token ids and their decoding."""
    return trie_bpe.encode_column(docs, word_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the stages: trained scores, signatures, keyed permutations, BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
