"""The registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

import importlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryproof.llm import (
    chat,
    kdtree,
    media,
    minhash,
    mixing,
    oracles,
    pseudonyms,
    repair,
    resampling,
    sharding,
    spans,
    toxicity,
    trie_bpe,
    warc,
)
from queryproof.llm.common import read_table
from queryproof.session import scratch_path

#: Stands in for a secret that an owner would keep; pseudonyms are linked as long as it stays the same.
PSEUDONYM_KEY = b"queryproof example key"


def word_vocabulary(path: str | None = None) -> str:
    """The text of a tokenizer file with word ends; without a path the installed public one."""
    if path is None:
        path = importlib.import_module("public_tokenizers").path("word_bpe_49k.json")
    return Path(path).read_text(encoding="utf-8")


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.drop_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonyms.pseudonymize_column(docs, PSEUDONYM_KEY)
    return out.select("doc_id", "text", F.size("kinds").alias("n_values"), "kinds")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(read_table(spark, sf_dir, "embeddings"))


def op6_wave_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = media.store_as_wave(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return media.media_features(docs)


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return trie_bpe.digest_column(docs, word_vocabulary())


def op8_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.expr(toxicity.HELD_OUT), F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op9_difference_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = warc.archived(pages, scratch_path(spark, "warc"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_checkpoint_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(read_table(spark, sf_dir, "conversations"))


def op12_token_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = chat.byte_vocabulary()
    rows = chat.with_hostile(read_table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_conversations(rows, vocabulary), vocabulary)


def op13_automaton_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_dart_minhash,
        op2_sentence_spans,
        op3_feistel_pseudonyms,
        op4_mix_sources,
        op5_kdtree_top_k,
        op6_wave_media,
        op7_trie_bpe,
        op8_factorization_toxicity,
        op9_difference_shards,
        op10_warc_index,
        op11_checkpoint_repair,
        op12_token_chat,
        op13_automaton_resampling,
    )
}

SQL: dict[str, str] = {
    "op5_kdtree_top_k": """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
    SELECT DISTINCT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    WHERE q.vec_id % 50 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_warc_index": """
WITH p AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id
    FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f""",
    "op11_checkpoint_repair": oracles.REPAIR,
    "op12_token_chat": oracles.CHAT,
    "op13_automaton_resampling": oracles.RESAMPLING,
}
