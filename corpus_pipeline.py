"""A corpus pipeline of five operators, each stage written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import cut
from feedloom.llm.decontaminate import contamination
from feedloom.llm.line_dedup import passage_dedup
from feedloom.llm.packing import pack_documents
from feedloom.llm.quality import keep_good
from feedloom.llm.simhash_dedup import simhash_dedup

#: Not SQL: the classifier is trained, the fingerprints and the packing are not expressible.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 4), trained on docs and the labels, does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the content-defined chunks of lines (operator 6), and then the runs of lines, that stand somewhere before; n_chars follows the text."""
    out = passage_dedup(docs, divisor=4)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (operator 10) the document with the smallest id."""
    return simhash_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window (operator 2), told apart by id and text: a null id is one too, and of rows that share an id each stands for itself."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hash_col="_hit_h")
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("_hit_id"), "_hit_h").distinct()
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["_hit_id"]) & (F.xxhash64(docs["text"]) == hit["_hit_h"]), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences of at most 2048 tokens (operator 3)."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("simhash near-dedup", simhash_stage), ("benchmark decontamination", benchmark_stage), ("best-fit packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
