"""A pipeline over documents: each stage takes what the one before kept, and all but the last return the columns of documents.

1. quality classifier: co-trained on ``labels``; documents that it rejects go.
2. n-gram Jaccard join: of documents that links of similarity 0.8 or more connect, the one with the least id stays.
3. secret scans: secrets in the texts are replaced by their kind in brackets.
4. mixing sources to target weights: documents are repeated, or left out, as the mix takes them.
5. BPE encoding and decoding: (doc_id, n_tokens, ids, ids_sha256, decoded_sha256) for each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lathe.llm import bpe, common, cotrain, jaccard_join, mixing, secret_scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotrain.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenize(docs, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither the classifier nor the library's tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each but the last returns is written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage-{k + 1}")
    return docs
