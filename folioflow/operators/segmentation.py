"""Segmenting documents: greedy token packing with barriers, page windows, page runs.

Packing is a sequential fold, since each flush resets the running sum. It is a
higher-order ``aggregate`` over one document's (position, tokens, barrier)
array, small beside its text; texts themselves are joined per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MAX_TOKENS = 800


#: Items that one step of the outer fold takes; numbers are appended to short arrays, so a document of a million blocks is no square of work.
SEGMENT = 1000


def _fold(items: Column, max_tokens: int) -> Column:
    """Chunk numbers of items (tokens, barrier), in order.

    State: the open chunk's blocks and tokens, chunks so far, and the numbers
    given. The count of open blocks tells an open chunk from none, as a block
    may have no tokens.
    """
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).cast("long").alias("run"), F.lit(-1).alias("chunk"), none.alias("given"))

    def step(s: Column, x: Column) -> Column:
        new = x["barrier"] | (s["open"] == 0) | (s["run"] + x["tokens"] > max_tokens)
        chunk = F.when(new, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(
            F.when(x["barrier"], 0).when(new, 1).otherwise(s["open"] + 1).alias("open"),
            F.when(x["barrier"], 0).when(new, x["tokens"]).otherwise(s["run"] + x["tokens"]).cast("long").alias("run"),
            chunk.alias("chunk"),
            F.concat(s["given"], F.array(chunk)).alias("given"),
        )

    def segment(s: Column, first: Column) -> Column:
        fresh = F.struct(s["open"].alias("open"), s["run"].alias("run"), s["chunk"].alias("chunk"), none.alias("given"))
        one = F.aggregate(F.slice(items, first, SEGMENT), fresh, step)
        # The segment's result is an array of one, so that it is folded once and read four times.
        return F.transform(F.array(one), lambda r: F.struct(r["open"].alias("open"), r["run"].alias("run"), r["chunk"].alias("chunk"), F.concat(s["given"], r["given"]).alias("given")))[0]

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(items)), F.lit(SEGMENT)), start, segment, lambda s: s["given"])


def assign_chunks(blocks: DataFrame, max_tokens: int = MAX_TOKENS, barriers: bool = True) -> DataFrame:
    """Add chunk_idx to blocks that have doc_id, pos, tokens and translatable.

    Packed greedily in order: a block opens a chunk if the open one would
    exceed max_tokens; no block is split. With barriers a block that is not
    translatable closes the open chunk and is one by itself. The blocks are
    read and shuffled once: a document's rows are gathered, numbered and
    spread again.
    """
    barrier = (lambda x: ~x["translatable"]) if barriers else (lambda x: F.lit(False))
    columns = ["pos", *[c for c in blocks.columns if c not in ("doc_id", "pos")]]
    packed = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("items"))
    packed = packed.withColumn("light", F.transform("items", lambda x: F.struct(x["tokens"].alias("tokens"), barrier(x).alias("barrier"))))
    packed = packed.select("doc_id", "items", _fold(F.col("light"), max_tokens).alias("chunk_idx"))
    rows = packed.select("doc_id", F.inline(F.arrays_zip("items", "chunk_idx")))
    return rows.select("doc_id", *[f"items.{c}" for c in columns], "chunk_idx")


def ordered_join(order: Column, text: Column, separator: str = "\n\n") -> Column:
    """Aggregate: texts in order, joined; empty and null ones left out."""
    sorted_ = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(F.filter(sorted_, lambda x: x["t"] != ""), lambda x: x["t"]), separator)


def all_joined(order: Column, text: Column, separator: str = "\n\n") -> Column:
    """As ordered_join, with empty ones kept."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def semantic_chunks(blocks: DataFrame, max_tokens: int = MAX_TOKENS, first: int = 0, keep: bool = False) -> DataFrame:
    """(doc_id, chunk_idx, id, original_text, translated_text, page_start, page_end, n_blocks, token_count, status).

    Chunks of blocks that stay as they are have status skipped and their own
    text as translation; the others are pending. With keep there are also
    kept_text, the blocks' output form for chunks that are not translated, and
    all_kept.
    """
    marked = blocks.withColumn("markdown", T.semantic_markdown(F.col("type"), F.col("content"), F.col("block_id"), F.col("heading_level"), F.col("language"), F.col("alt")))
    return _chunks(assign_chunks(marked.withColumn("tokens", T.estimate_tokens(F.col("markdown"))), max_tokens), first, keep)


def naive_chunks(blocks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The same without barriers: all blocks are packed together, in plain Markdown, all pending."""
    marked = blocks.withColumn("markdown", T.naive_markdown(F.col("type"), F.col("content"), F.col("heading_level"), F.col("language"), F.col("alt"))).withColumn("translatable", F.lit(True))
    return _chunks(assign_chunks(marked.withColumn("tokens", T.estimate_tokens(F.col("markdown"))), max_tokens, False), 0)


def _chunks(assigned: DataFrame, first: int, keep: bool = False) -> DataFrame:
    shown = T.assembly_markdown(*[F.col(c) for c in ("type", "content", "language", "alt", "html", "is_complex")]) if keep else None
    out = assigned.groupBy("doc_id", "chunk_idx").agg(
        *([ordered_join(F.col("pos"), shown).alias("kept_text"), F.bool_and(~F.col("translatable")).alias("all_kept")] if keep else []),
        all_joined(F.col("pos"), F.col("markdown")).alias("original_text"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.count("*").cast("int").alias("n_blocks"),
        F.bool_and("translatable").alias("_open"),
    )
    out = out.withColumn("chunk_idx", F.col("chunk_idx") + first)
    return out.select(
        "doc_id",
        "chunk_idx",
        F.concat(F.lit("chunk-"), F.col("chunk_idx").cast("string")).alias("id"),
        "original_text",
        F.when(~F.col("_open"), F.col("original_text")).alias("translated_text"),
        "page_start",
        "page_end",
        "n_blocks",
        T.estimate_tokens(F.col("original_text")).alias("token_count"),
        F.when(F.col("_open"), "pending").otherwise("skipped").alias("status"),
        *(["kept_text", "all_kept"] if keep else []),
    )


def page_windows(pages: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, window, first_page, last_page, n_pages) of tumbling windows over (doc_id, page)."""
    window = F.floor((F.col("page") - 1) / size).cast("int").alias("window")
    return pages.groupBy("doc_id", window).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.countDistinct("page").cast("int").alias("n_pages"))


def page_runs(pages: DataFrame, flag: str = "needs_ocr") -> DataFrame:
    """(doc_id, first_page, last_page, flag): runs of consecutive pages of one flag."""
    own = Window.partitionBy("doc_id").orderBy("page")
    same = Window.partitionBy("doc_id", flag).orderBy("page")
    island = F.row_number().over(own) - F.row_number().over(same)
    return pages.withColumn("_island", island).groupBy("doc_id", flag, "_island").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")).drop("_island")


def pages_needing_ocr(page_texts: DataFrame, min_chars: int = 50, mode: str = "auto", first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, page, needs_ocr): by the text layer's letters and digits, or by mode always or never; pages clamped to a range."""
    if first is not None:
        page_texts = page_texts.where(F.col("page") >= max(1, first))
    if last is not None:
        page_texts = page_texts.where(F.col("page") <= last)
    short = F.coalesce(T.count_alnum(F.col("text")), F.lit(0)) < min_chars
    return page_texts.select("doc_id", "page", {"auto": short, True: F.lit(True), False: F.lit(False)}[mode].alias("needs_ocr"))
