"""Cleaning block tables: running headers and footers, page numbers, hyphenated line ends.

Everything is keyed by document, so one shuffle by doc_id serves all windows
and the counts of running lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .blocks import renumber

#: A running line is shorter than this.
RUNNING_LENGTH = 120


def drop_labelled(blocks: DataFrame) -> DataFrame:
    """Without blocks labelled as page headers or footers."""
    return blocks.where(~F.lower(F.coalesce("label", F.lit(""))).isin("page_header", "page_footer"))


def page_edges(blocks: DataFrame) -> DataFrame:
    """Mark the first and last paragraph or heading of each page (is_first, is_last) and give the running form."""
    prose = F.col("type").isin("paragraph", "heading")
    page = Window.partitionBy("doc_id", "page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.when(prose, F.col("pos"))
    return blocks.withColumns(
        {
            "is_first": F.coalesce(F.col("pos") == F.min(place).over(page), F.lit(False)) & prose,
            "is_last": F.coalesce(F.col("pos") == F.max(place).over(page), F.lit(False)) & prose,
            "running": T.running_form(F.col("content")),
        }
    )


def repeated_lines(edged: DataFrame) -> DataFrame:
    """Edges of pages with how often their form runs at the top (as_header) and bottom (as_footer) of the document's pages.

    Only short single lines count; headings of chapters and parts don't count as headers.
    """
    trimmed = T.strip(F.col("content"))
    short = (F.length(trimmed) < RUNNING_LENGTH) & ~trimmed.contains("\n")
    form = Window.partitionBy("doc_id", "running")
    return edged.withColumns(
        {
            "as_header": F.count_if(F.col("is_first") & short & ~T.is_exempt_heading(F.col("content"))).over(form),
            "as_footer": F.count_if(F.col("is_last") & short).over(form),
        }
    )


def drop_running_lines(blocks: DataFrame) -> DataFrame:
    """Without labelled headers and footers, page numbers and lines that run over two or more of a document's pages."""
    columns = blocks.columns
    rows = repeated_lines(page_edges(drop_labelled(blocks)))
    document = Window.partitionBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("pages", F.size(F.collect_set("page").over(document)))
    many = F.col("pages") >= 2
    drop = F.col("type").isin("paragraph", "heading") & T.is_page_number(F.col("content"))
    drop |= many & F.col("is_first") & (F.col("as_header") >= 2)
    drop |= many & F.col("is_last") & (F.col("as_footer") >= 2)
    return rows.where(~drop).select(*columns)


def dehyphenated(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("content", F.when(F.col("type").isin(*T.PROSE_TYPES), T.dehyphenate(F.col("content"))).otherwise(F.col("content")))


def clean(blocks: DataFrame, passes: int = 1, window_pages: int | None = None, first_id: int = 0) -> DataFrame:
    """Running lines off, hyphens joined, ids dense.

    With window_pages each window of pages is cleaned by itself first and the
    whole document after it, as a reader in windows does (two passes). Output
    order is that of pages' first appearance, then position. Texts are shuffled
    once, by document; all windows keep to that.
    """
    blocks = blocks.repartition("doc_id")
    if window_pages:
        keyed = blocks.withColumns({"_doc": F.col("doc_id"), "doc_id": F.struct("doc_id", F.floor((F.col("page") - 1) / window_pages).alias("window"))})
        blocks = dehyphenated(drop_running_lines(keyed)).withColumn("doc_id", F.col("_doc")).drop("_doc")
    for _ in range(passes):
        blocks = dehyphenated(drop_running_lines(blocks))
    begins = F.min("pos").over(Window.partitionBy("doc_id", "page"))
    order = Window.partitionBy("doc_id").orderBy("_begins", "pos")
    blocks = blocks.withColumn("_begins", begins).withColumn("pos", (F.row_number().over(order) - 1).cast("int")).drop("_begins")
    return renumber(blocks, first_id)
