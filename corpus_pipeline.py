"""The training-corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import packing, quality_classifier, quality_rules, shingle_join, suffix_dedup
from skyloom.llm.common import crc_mod, documents, fresh_dir
from skyloom.llm.queries import tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives 0.3 or more; it learns from the labelled ones among them (not fold 0)."""
    model = quality_classifier.learn(docs, documents(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return quality_classifier.predict(docs, model, keep="all").where("quality_score >= 0.3").drop("quality_score")


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.quality_filter(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that links of a five-word Jaccard similarity of 0.8 or more make."""
    return shingle_join.deduplicate(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, texts without passages that stand in a document of smaller id; n_chars is counted anew."""
    return suffix_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0)


STAGES = [("quality_classifier", good_quality), ("quality_rules", by_rules), ("simhash_near_dedup", without_near_copies), ("suffix_array_dedup", without_repeats), ("best_fit_packing", packed)]

#: Several stages can't be expressed in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        at = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
