"""Conversion routes between formats, and the whole translation dataflow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.glossary import Glossary
from ..operators import assembly, checkpoints, cleaning, segmentation
from ..operators.translation import Generator, translate
from ..sources.settings import Settings

# The steps from one format to another.
ROUTES = {
    ("pdf", "md"): ["extract", "segment", "assemble"],
    ("pdf", "epub"): ["extract", "segment", "assemble", "export_epub"],
    ("md", "epub"): ["export_epub"],
    ("md", "pdf"): ["export_pdf"],
    ("epub", "md"): ["read_epub"],
    ("epub", "pdf"): ["read_epub", "export_pdf"],
}


def route_table(spark: SparkSession) -> DataFrame:
    """(source, target, steps) of all pairs of formats; the same format is copied."""
    rows = [(f, f, ["copy"]) for f in ("pdf", "md", "epub")] + [(a, b, steps) for (a, b), steps in ROUTES.items()]
    return spark.createDataFrame(rows, "source string, target string, steps array<string>")


def route(requests: DataFrame, source: Column, target: Column) -> DataFrame:
    """Requests with the steps to take; null where a format is unknown. The routes are nine rows."""
    table = route_table(requests.sparkSession)
    keyed = requests.withColumns({"_from": T.format_name(source), "_to": T.format_name(target)})
    joined = keyed.join(F.broadcast(table), (F.col("_from") == F.col("source")) & (F.col("_to") == F.col("target")), "left")
    return joined.drop("_from", "_to", "source", "target")


def prepare_chunks(blocks: DataFrame, settings: Settings, window_pages: int | None = None) -> DataFrame:
    """Blocks cleaned and packed into chunks."""
    return segmentation.semantic_chunks(cleaning.clean(blocks, window_pages=window_pages), settings.translation.chunk_max_tokens, keep=True)


def translate_documents(blocks: DataFrame, states: DataFrame, generator: Callable[[], Generator], glossary: Glossary, settings: Settings, persist: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(states, documents): translate what states lack and assemble all documents.

    persist writes the new states and reads them back: a generator's answers
    must not be asked for twice. Documents whose chunks are all done are not
    sent again; of the others the done chunks go along as context.
    """
    chunks = prepare_chunks(blocks, settings)
    known = checkpoints.with_states(chunks, states).withColumn("done_before", F.coalesce(F.col("_status").isin(*checkpoints.DONE), F.lit(False)))
    known = known.withColumns({"translated_text": F.when(F.col("done_before"), F.col("_text")), "status": F.when(F.col("done_before"), F.col("_status")).otherwise(F.col("status"))})
    todo = known.withColumn("_left", F.max(~F.col("done_before")).over(Window.partitionBy("doc_id"))).where("_left")
    t = settings.translation
    done = translate(todo, generator, glossary, t.target_language, t.max_retries, t.temperature)
    new = persist(done.select("doc_id", "chunk_idx", "status", F.col("translated_text").alias("text"), "error_message", F.current_timestamp().alias("updated_at"), "text_key"))
    states = checkpoints.upsert(states, new)
    shown = checkpoints.with_states(chunks, states).withColumn("status", F.coalesce("_status", "status"))
    text = assembly.chunk_markdown(F.col("status"), F.col("original_text"), F.col("_text"), F.col("kept_text"), F.col("all_kept"))
    return states, assembly.assemble(shown.withColumn("markdown", text))
