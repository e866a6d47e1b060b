"""From raw documents to sampled pieces: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustloom.llm.common import removed_after, shared_dir, table
from dustloom.llm.exact_dedup import drop_exact_copies
from dustloom.llm.mixing import mixed_rows
from dustloom.llm.near_dedup import drop_near_copies
from dustloom.llm.piece_sampling import encode_rows
from dustloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that a machine fitted on the labels doesn't reject. Null and empty texts are scored as empty; without labels, or with one kind alone, all rows stay."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the smallest doc_id (null after all others); null and empty texts are the same text."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one with the smallest doc_id (null after all others)."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks, at most three times; a null source is a source of its own."""
    return mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each row, and whether they spell its text; all columns of docs but the text.

    Rows that the mix repeats are numbered, so that each has a segmentation of its own; as they are the same, it doesn't
    matter which has which number. Null and empty texts have no pieces. Columns of docs named as ours give way.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    copy = "_copy"
    while copy in docs.columns:
        copy += "_"
    nth = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
    encoded = encode_rows(docs.withColumn(copy, nth), model, key_cols=("doc_id", copy), decode=True)
    ours = {"ids": F.col("ids"), "n_pieces": F.size("ids").cast("long"), "lossless": F.col("lossless")}
    return encoded.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("text", *ours)), *(c.alias(n) for n, c in ours.items()))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("pieces", pieces)]
#: SQL can't fit the scorer or sample segmentations; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/dustloom-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with removed_after(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
