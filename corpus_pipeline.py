"""From the documents table to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs``, and returns a DataFrame, which
is written as Parquet and read again as the next one's ``docs``. All but the last return the columns
of ``docs``, whatever they are.

1. toxicity: documents predicted toxic from their nearest labelled examples go.
2. exact dedup: of documents with equal texts the one with the largest id stays.
3. SimHash near-dedup: of linked fingerprints the document with the smallest id stays.
4. mixing: every document is repeated as often as its source's target asks for.
5. SentencePiece: texts become ids.

Null texts count as empty texts, null ids are never learned from and lose against any other id, null
sources are a source of their own. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtempo.llm import grace_dedup, mixing, simhash_anchors, suffix_pieces, toxicity
from fieldtempo.llm.storage import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return grace_dedup.survivors(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_anchors.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_pieces.encode(docs.select("doc_id", "lang", "source", "text")).withColumn(
        "n_ids", F.size("ids").cast("bigint")
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL has no SentencePiece encoder and no such classifier; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
