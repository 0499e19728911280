"""The opN_<name> queries and the pipeline, with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney, oracles
from .ann import nearest_neighbours
from .exact_topk import exact_top_k
from .language import identify_language, learn_languages
from .licences import scan_licences
from .mixing import taken_words
from .neardup import near_duplicate_classes
from .packing import best_two_fit_pack
from .toxicity import THRESHOLD, learn_toxicity, score_toxicity
from .url_filter import judge_urls

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_two_fit_pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents"))


def _fold(n: int, key: str = "doc_id"):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(key).cast("string")) % n


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = learn_toxicity(documents, _table(spark, sf_dir, "labels"), _fold(3) != 1)
    scored = score_toxicity(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(_table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(documents.where(_fold(7) != 2))
    scored = kneser_ney.score(documents, model)
    return scored.select("doc_id", F.coalesce(_fold(7) == 2, F.lit(False)).alias("held_out"), "_lm.n_tokens", "_lm.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "_lm.base_score", "_lm.score")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    found = identify_language(documents.select("doc_id", "text"), learn_languages(documents, _fold(5) != 0))
    return found.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "_language.lang_pred", "_language.score", "_language.ambiguous")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: (verdict, host, path); the longest that fits wins.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: (verdict, glob) over host + path where no rule fits: mobile mirrors and printer-friendly copies repeat other pages.
URL_GLOBS = [("block", "m.**"), ("block", "**/print/**")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack, op2_licences, op3_toxicity, op4_mix, op5_lm, op6_language, op7_ann, op8_url_filter, op9_exact_topk, op10_neardup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix": oracles.OP4, "op8_url_filter": oracles.OP8, "op9_exact_topk": oracles.OP9}
