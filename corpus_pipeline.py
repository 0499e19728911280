"""The corpus pipeline: language ID, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import free_name, materialize
from folioflow.llm.language import UNKNOWN, identify_language, learn_languages
from folioflow.llm.mixing import mixed_documents
from folioflow.llm.neardup import one_of_each
from folioflow.llm.packing import best_two_fit_pack
from folioflow.llm.queries import TOKENIZER
from folioflow.llm.toxicity import THRESHOLD, learn_toxicity, score_toxicity


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, and so in none, go. lang becomes the predicted language."""
    found = free_name(docs, "found")
    rows = identify_language(docs, learn_languages(docs, F.lit(True)), into=found)
    return rows.where(F.col(found)["lang_pred"] != UNKNOWN).withColumn("lang", F.col(found)["lang_pred"]).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    score = free_name(docs, "score")
    return score_toxicity(docs, model, into=score).where(F.col(score) < THRESHOLD).select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id; rows without an id are classed alike."""
    return one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as their source's weight takes them, the last time cut where its share ends."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequence and place; copies that the mixture made are packed each."""
    return best_two_fit_pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language_stage),
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", neardup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Learned models, signatures and a tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each over what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
