"""From raw documents to token ids: quality rules, exact and near duplicates, source mix, encoding.

Each stage takes the table its predecessor left and returns the columns of `documents`; the last one
returns token ids. `run` writes each stage to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact, importance, jaccard, mixing, pieces
from plumbline.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject; the trusted ones are those labelled good."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return importance.passing_documents(docs, trusted)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of least doc_id stays."""
    return exact.distinct_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets, the one of least doc_id stays."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (32-bit little-endian), with digests of the ids and of the decoded text."""
    import public_tokenizers

    both = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: The hash bins of the first stage and the encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
