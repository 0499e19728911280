"""Putting translated chunks together again, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .segmentation import ordered_join

#: Put before the text of a chunk that could not be translated.
UNTRANSLATED = "<!-- NÃO TRADUZIDO -->"


def kept_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, chunk_idx, kept_text, all_kept): blocks' output forms joined, and whether none of them is translatable."""
    shown = T.assembly_markdown(*[F.col(c) for c in ("type", "content", "language", "alt", "html", "is_complex")])
    return blocks.groupBy("doc_id", "chunk_idx").agg(ordered_join(F.col("pos"), shown).alias("kept_text"), F.bool_and(~F.col("translatable")).alias("all_kept"))


def chunk_markdown(status: Column, original: Column, translated: Column, kept: Column, all_kept: Column, marker: str = "documented") -> Column:
    """Output text of a chunk by status; failed chunks are the original, marked unless marker is 'reference'."""
    failed = T.strip(original) if marker == "reference" else F.concat(F.lit(UNTRANSLATED + "\n\n"), T.strip(original))
    return (
        F.when((status == "skipped") | F.coalesce(all_kept, F.lit(False)), F.coalesce(kept, F.lit("")))
        .when(translated.isNotNull() & (status == "translated"), T.strip(translated))
        .when(status == "error", failed)
        .otherwise(T.strip(original))
    )


def assemble(chunks: DataFrame, text_col: str = "markdown") -> DataFrame:
    """(doc_id, markdown): each document's chunk texts in order, a blank line between, a line end at the end unless empty."""
    joined = chunks.groupBy("doc_id").agg(ordered_join(F.col("chunk_idx"), F.col(text_col)).alias("markdown"))
    return joined.withColumn("markdown", F.when(F.col("markdown") == "", "").otherwise(F.concat("markdown", F.lit("\n"))))


def image_assets(blocks: DataFrame, output_dir: str) -> DataFrame:
    """(source, target): images to copy beside the output."""
    return blocks.where("type = 'image' and image_path is not null").select(F.col("image_path").alias("source"), F.concat_ws("/", F.lit(output_dir), "content").alias("target")).where("source <> target").distinct()
