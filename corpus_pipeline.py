"""From raw documents to sampled training pieces: language, quality, near duplicates, benchmark passages, segmentation.

Each stage works on all rows that the one before kept, and its output is written and read again. The first four return the columns of
documents. A null text is rejected by the first stage, as it has no language.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfield.llm import decontaminate, language, neardup, rules, segment
from peakfield.llm._common import free_name, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and those of whose n-grams fewer than a tenth belong to the language found."""
    name = free_name(docs, "language")
    found = language.with_language(docs, language.LanguageFilters.fit(docs))
    return found.where((F.col(name)["lang_pred"] != "und") & (F.col(name)["coverage"] >= 0.1)).select(*docs.columns)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that fail the base rules or any learned rule."""
    learned = rules.fit(rules.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), 20_000))
    rows, stats = rules.features(docs)
    return rows.where(~rules.base_failed(stats) & (learned.verdict(stats) == 0)).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class."""
    return neardup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts, and drops a text of which no word is left."""
    name = free_name(docs, "contamination")
    found = decontaminate.with_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate(F.col(name)["spans"], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    left = found.where((hit == 0) | (hit < F.col(name)["n_words"])).withColumn("text", decontaminate.without_spans(F.col("text"), F.col(name)["spans"]))
    return left.withColumn("n_chars", F.when(F.size(F.col(name)["spans"]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, and two sampled segmentations of each text with their scores."""
    own = docs.select("doc_id", "lang", "text")
    return segment.with_segmentations(own, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "lang", "segmentations")


STAGES = [("language", identified), ("quality", of_quality), ("near_duplicates", deduplicated), ("decontamination", decontaminated), ("segmentation", segmented)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
