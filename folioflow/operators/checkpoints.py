"""Checkpoint tables: what of each document is done, and what is left.

A chunk's state is keyed by document, chunk and a hash of its text, so a run
with other limits never takes over the wrong text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

DONE = ("translated", "skipped")

MANIFEST_SCHEMA = (
    "version int, sha256 string, source_name string, source_path string, total_pages int, model string, prompt_version string, "
    "target_language string, status string, created_at string, updated_at string, "
    "chunks map<string, struct<id: string, index: int, page_start: int, page_end: int, status: string, md_file: string, token_count: int, error_message: string, updated_at: string>>"
)


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def latest(states: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_idx"), order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """One row per key, the latest; of several of one time the greatest by the other columns in their order."""
    rest = [c for c in states.columns if c not in (*keys, *order) and not isinstance(states.schema[c].dataType, MapType)]
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in (*order, *rest)])
    return states.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def upsert(states: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_idx"), order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """States with changes put in place of those they are newer than."""
    return latest(states.unionByName(changes, allowMissingColumns=True), keys, order)


def insert_absent(manifest: DataFrame, rows: DataFrame, key: str = "sha256") -> DataFrame:
    """Manifest with rows added whose key it lacks; existing rows stay as they are."""
    return manifest.unionByName(rows.join(manifest, key, "left_anti"))


def mark_completed(manifest: DataFrame, done: Column, now: Column) -> DataFrame:
    """Manifest with the status completed, and the time, where done holds."""
    return manifest.withColumns({"status": F.when(done, "completed").otherwise(F.col("status")), "updated_at": F.when(done, now).otherwise(F.col("updated_at"))})


def clear(rows: DataFrame, documents: DataFrame, key: str = "sha256") -> DataFrame:
    """Rows of a manifest or of states without those of some documents."""
    return rows.join(documents.select(key).distinct(), key, "left_anti")


def with_states(chunks: DataFrame, states: DataFrame) -> DataFrame:
    """Chunks with their latest state's _status and _text, null where there is none for the chunk's text.

    A state that bears a text_key holds for a chunk of that text alone; one
    without is taken by its place. Chunks need original_text for the comparison.
    """
    columns = ["doc_id", "chunk_idx", F.col("status").alias("_status"), F.col("text").alias("_text")]
    if "text_key" not in states.columns or "original_text" not in chunks.columns:
        return chunks.join(latest(states).select(*columns), ["doc_id", "chunk_idx"], "left")
    joined = chunks.join(latest(states).select(*columns, F.col("text_key").alias("_of")), ["doc_id", "chunk_idx"], "left")
    fits = F.col("_of").isNull() | (F.col("_of") == text_key(F.col("original_text")))
    return joined.withColumns({"_status": F.when(fits, F.col("_status")), "_text": F.when(fits, F.col("_text"))}).drop("_of")


def resume(chunks: DataFrame, states: DataFrame) -> DataFrame:
    """Chunks with the text and status of those done before; the others as they were."""
    done = F.col("_status").isin(*DONE)
    joined = with_states(chunks, states).withColumns({"translated_text": F.when(done, F.coalesce("_text", "translated_text")).otherwise(F.col("translated_text")), "status": F.when(done, F.col("_status")).otherwise(F.col("status"))})
    return joined.drop("_status", "_text")


def pending(chunks: DataFrame, states: DataFrame) -> DataFrame:
    """Chunks that no state says are done."""
    return with_states(chunks, states).where(~F.coalesce(F.col("_status").isin(*DONE), F.lit(False))).drop("_status", "_text")


def conflict_action(saved_model: Column, saved_prompt: Column, model: Column, prompt: Column, on_conflict: Column) -> Column:
    """What to do with a checkpoint: continue if it was made the same way, else as on_conflict says. restart always restarts."""
    same = saved_model.eqNullSafe(model) & saved_prompt.eqNullSafe(prompt)
    return F.when(on_conflict == "restart", "restart").when(same, "continue").otherwise(on_conflict)


def parse_manifests(texts: DataFrame, json_col: str = "json") -> DataFrame:
    """Manifest rows from JSON texts; those that don't parse give none. Chunks may be a map or a list."""
    as_map = F.from_json(json_col, MANIFEST_SCHEMA)
    record = MANIFEST_SCHEMA.split("map<string, ", 1)[1][:-1]
    listed = F.from_json(F.get_json_object(json_col, "$.chunks"), f"array<{record}>")
    chunks = F.coalesce(as_map["chunks"], F.map_from_entries(F.transform(F.filter(listed, lambda x: x["id"].isNotNull()), lambda x: F.struct(x["id"], x))))
    rows = texts.select("*", as_map.alias("_m"), chunks.alias("_chunks")).where("_m.sha256 is not null")
    defaults = {"version": F.lit(1), "status": F.lit("in_progress")}
    return rows.select(*[F.coalesce(F.col(f"_m.{c}"), v).alias(c) for c, v in defaults.items()], *[f"_m.{c}" for c in ("sha256", "source_name", "source_path", "total_pages", "model", "prompt_version", "target_language", "created_at", "updated_at")], F.col("_chunks").alias("chunks"))


def progress_counts(states: DataFrame) -> DataFrame:
    """(doc_id, done, failed, total, percent) of chunk states."""
    out = states.groupBy("doc_id").agg(F.count_if(F.col("status").isin(*DONE)).alias("done"), F.count_if(F.col("status") == "error").alias("failed"), F.count("*").alias("total"))
    return out.withColumn("percent", F.floor(F.col("done") * 100 / F.col("total")).cast("int"))
