"""Block tables: one row per piece of a document, in order.

Rows carry their order: ``doc_id, pos`` identify and order blocks. Other
columns: page int, type, label, content, and heading_level, language, alt,
html, is_complex, image_path where a reader knows them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as T

_I, _S, _B = IntegerType(), StringType(), BooleanType()
BLOCK_SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("pos", _I), StructField("page", _I), StructField("type", _S), StructField("label", _S), StructField("content", _S)]
    + [StructField("translatable", _B), StructField("heading_level", _I), StructField("language", _S), StructField("alt", _S), StructField("html", _S), StructField("is_complex", _B), StructField("image_path", _S)]
)


def complete(blocks: DataFrame) -> DataFrame:
    """All columns of BLOCK_SCHEMA in order, null where blocks lack them; translatable by type."""
    known = set(blocks.columns)
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in BLOCK_SCHEMA]
    return blocks.select(*columns).withColumn("translatable", F.coalesce("translatable", F.lit(True)) & T.is_translatable(F.coalesce("type", F.lit("unknown"))))


def line_label(pos: Column, line: Column) -> Column:
    """A label for a line of plain text, from its looks."""
    return (
        F.when(pos == 0, "title")
        .when(line.contains(" | "), "table")
        .when(line.contains("$$$ "), "code")
        .when(F.length(line) < 40, "list_item")
        .otherwise("text")
    )


def text_blocks(documents: DataFrame, lines_per_page: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-blank lines of plain texts as blocks, so many to a page."""
    lines = F.filter(F.split(text_col, "\n"), lambda x: T.strip(x) != "")
    rows = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(lines).alias("pos", "content"))
    rows = rows.withColumn("page", (F.floor(F.col("pos") / lines_per_page) + 1).cast("int")).withColumn("label", line_label(F.col("pos"), F.col("content")))
    return complete(rows.withColumn("type", T.block_type(F.col("label"))).withColumn("heading_level", F.when(F.col("type") == "heading", T.heading_level(F.lit(None).cast("int"), F.col("label")))))


_BLOCKY = "h[1-6]|p|li|ul|ol|dl|dt|dd|div|article|section|nav|header|footer|main|aside|table|caption|thead|tbody|tfoot|tr|td|th|pre|blockquote|form|fieldset|figure|figcaption|address|hr|details|summary|body|html"
_ENDS_ITEM = "/?(?:h1|p|li)|/(?:ul|ol|article|section|nav|header|footer|main|aside|body|html)"
#: Blocks in a page: the opening tag and all up to the closing tag or the next block; in list items other elements may stand.
PAGE_BLOCK = rf"(?i)<(?:(?:h1|p)(?:\s[^>]*)?>[^<]*+(?:<(?!/?(?:{_BLOCKY})[\s/>])[^<]*+)*+|li(?:\s[^>]*)?>[^<]*+(?:<(?!(?:{_ENDS_ITEM})[\s/>])[^<]*+)*+)"
#: What is no text in a page, tags that part words, and all other tags.
_NO_TEXT = r"(?is)<!--.*?-->|<(script|style)(?:\s[^>]*)?>.*?</\1\s*>"
_PARTING = rf"(?i)</?(?:br|{_BLOCKY})(?:[\s/][^>]*)?>"
_TAG = r"<[/!?]?[a-zA-Z][^>]*>"


def html_blocks(pages: DataFrame, blocks_per_page: int = 10, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Headings, paragraphs and list items of raw pages as blocks, with all their text; blank ones go.

    Text that follows a block inside a list item is in no block.
    """
    found = F.regexp_extract_all(F.regexp_replace(html_col, _NO_TEXT, ""), F.lit(PAGE_BLOCK), F.lit(0))
    rows = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("pos", "tagged"))
    tag = F.lower(F.regexp_extract("tagged", "^<([a-zA-Z0-9]+)", 1))
    label = F.when(tag == "h1", "title").when(tag == "li", "list_item").otherwise("text")
    content = F.regexp_replace(F.regexp_replace(F.regexp_replace("tagged", "^<[^>]*>", ""), _PARTING, " "), _TAG, "")
    rows = rows.select("doc_id", "pos", (F.floor(F.col("pos") / blocks_per_page) + 1).cast("int").alias("page"), label.alias("label"), T.strip(content).alias("content"))
    rows = rows.withColumn("type", T.block_type(F.col("label"))).withColumn("heading_level", F.when(F.col("type") == "heading", F.lit(1)))
    return complete(rows.where("content <> ''"))


def renumber(blocks: DataFrame, first: int = 0) -> DataFrame:
    """Dense ids b0, b1, ... per document in order."""
    return blocks.withColumn("block_id", F.concat(F.lit("b"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1 + first).cast("string")))


def page_numbers(items: DataFrame) -> DataFrame:
    """Page of each item: that of its first provenance, else the slice's first page."""
    return items.withColumn("page", F.coalesce(F.try_element_at("prov", F.lit(1))["page_no"], F.col("slice_start")).cast("int"))
