"""Corpus pipeline: each stage applies one operator to all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.

In every stage an empty table gives an empty result, a null text counts as empty, repeated rows are judged alike (SimHash
keeps one of them), rows with a null id take part, and other columns stay as they are, whatever their names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelattice.llm.bpe import encode, read_ranks
from pricelattice.llm.common import free, settle, small_batches, stored, table
from pricelattice.llm.decontaminate import clean_documents
from pricelattice.llm.line_dedup import dedup_lines
from pricelattice.llm.quality_net import keep_good
from pricelattice.llm.simhash import keep_one_of_each


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject (score of 0.5 or more)."""
    small_batches(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs of 50 words or more, and ``n_chars`` to match. A
    document that consists of such copies alone goes."""
    n_lines, n_deleted = free(docs, "n_lines"), free(docs, "n_deleted")
    cleaned = dedup_lines(docs, n_lines=n_lines, n_deleted=n_deleted)
    changed = F.col(n_deleted) > 0
    return (
        cleaned.where(~changed | (F.length(F.btrim("text", F.lit(" \t\n\x0b\f\r"))) > 0))
        .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(*docs.columns)
    )


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity of 0.8 or more) the document with the least id."""
    small_batches(spark)
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    small_batches(spark)
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    small_batches(spark)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = encode(docs, ranks, public_tokenizers.PATTERN, id_bytes="raw", decoded="back", keep=["doc_id"])
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("raw", 256).alias("ids_sha256"), F.sha2("back", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: SQL cannot express the network or the retrieval; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stored and read again. What a stage leaves behind is cleaned before the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        settle(spark)
    return docs
