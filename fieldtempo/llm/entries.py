"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from fieldtempo.llm import (
    grace_dedup,
    language_id,
    license_automaton,
    merkle_manifest,
    mixing,
    multi_index,
    prefix_trie,
    secret_ledger,
    sharding,
    simhash_anchors,
    sql,
    suffix_pieces,
    token_attribution,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ledger = secret_ledger.scan_unseen(docs, secret_ledger.empty_ledger(spark))
    by_path = secret_ledger.findings_by_path(docs, ledger)

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")

    spans = F.array_join(
        F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )
    return by_path.withColumn("spans", spans).select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


OP1_SQL = r"""
WITH kinds(kind, place, pattern, grp, least) AS (VALUES
    ('assign', 0,
     '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)',
     2, 6),
    ('access', 1, 'AKIA[A-Z0-9]+', 0, 20),
    ('hex', 2, '[0-9a-f]+', 0, 24)),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matches AS (
    SELECT doc_id, kind, place, least,
        [length(x) FOR x IN regexp_extract_all(text, pattern, 0)] AS sizes,
        [length(x) FOR x IN regexp_extract_all(text, pattern, grp)] AS tested,
        [length(x) FOR x IN string_split_regex(text, pattern)] AS gaps
    FROM texts, kinds),
numbered AS (
    SELECT doc_id, kind, place, least, unnest(sizes) AS size, unnest(tested) AS tested,
        unnest(gaps[:len(sizes)]) AS gap, unnest(range(len(sizes))) AS n
    FROM matches),
ends AS (
    SELECT doc_id, kind, place, size, tested >= least AS holds,
        sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY n) AS finish
    FROM numbered),
joined AS (
    SELECT doc_id,
        count(*) FILTER (kind = 'assign') AS n_assign,
        count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || (finish - size)::BIGINT || ':' || finish::BIGINT, ','
            ORDER BY finish - size, place) AS spans
    FROM ends WHERE holds GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
    coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
    coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (doc_id)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by sentence, each token counted where most of it lies."""
    docs = documents(spark, sf_dir)
    return token_attribution.count_by_section(
        docs, token_attribution.sentence_lengths(F.col("text")), rule="most"
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_texts(docs, toxicity.fit(docs, labels))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.duplicate_groups(documents(spark, sf_dir))


OP4_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY text)
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.predict_languages(docs, language_id.fit(docs))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return multi_index.search(vectors, F.col("id") % multi_index.QUERY_DIVISOR == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchors.near_duplicates(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.minimax_shards(documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return suffix_pieces.encode(docs, check=True).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "round_trip"
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_automaton.scan(documents(spark, sf_dir))
    labels = F.array_sort(F.array_union("base_labels", F.transform("spans", lambda x: x["label"])))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        "score",
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verified(documents(spark, sf_dir)).drop("path")


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scans": op1_secret_scans,
        "op2_token_counts": op2_token_counts,
        "op3_toxicity": op3_toxicity,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_language_id": op5_language_id,
        "op6_nearest_vectors": op6_nearest_vectors,
        "op7_simhash": op7_simhash,
        "op8_sharding": op8_sharding,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_mixing": op10_mixing,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_license_scans": op12_license_scans,
        "op13_merkle_manifest": op13_merkle_manifest,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scans": OP1_SQL,
        "op4_exact_dedup": OP4_SQL,
        "op11_conversation_trie": sql.OP11,
        "op13_merkle_manifest": sql.OP13,
    }
