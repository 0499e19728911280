"""Binary files as rows: validity, hash, and adapters that parse them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import BLOCK_SCHEMA

#: Files smaller than this with a PDF header need no parsing.
STUB_BYTES = 50


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, sha256) of files; the binary reader passes over empty files, so they are listed beside it."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x for s in fs.globStatus(root) or [] for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    empty = [(x.getPath().toString(), 0, bytearray()) for x in found if x.isFile() and x.getLen() == 0]
    files = files.unionByName(spark.createDataFrame(empty, "path string, length long, content binary")) if empty else files
    return files.withColumn("sha256", F.sha2("content", 256))


def pdf_problem(name: Column, content: Column) -> Column:
    """Why a file is no readable PDF, by the first rule it breaks; null if none does."""
    header = F.substring(content, 1, 1024).cast("string")
    return (
        F.when(content.isNull(), "Arquivo não encontrado")
        .when(~F.lower(name).endswith(".pdf"), "extensão")
        .when(F.length(content) == 0, "arquivo vazio (0 bytes)")
        .when(~F.coalesce(header.contains("%PDF-"), F.lit(False)), "cabeçalho PDF não encontrado")
    )


def needs_parsing(content: Column) -> Column:
    """Whether a PDF is more than a stub, so that a parser has to open it."""
    return ~((F.length(content) < STUB_BYTES) & F.substring(content, 1, 5).cast("string").eqNullSafe("%PDF-"))


class Extractor(Protocol):
    """A parser of one document: its pages' texts, and blocks of a run of pages with or without OCR."""

    def page_count(self, content: bytes) -> int: ...

    def page_texts(self, content: bytes) -> list[str]: ...

    def blocks(self, content: bytes, first: int, last: int, ocr: bool) -> list[dict]: ...


class TextExtractor:
    """A stand-in for a PDF parser: form feeds part pages, line ends part blocks."""

    def page_count(self, content: bytes) -> int:
        return content.count(b"\f") + 1

    def page_texts(self, content: bytes) -> list[str]:
        return content.decode("utf-8", "replace").split("\f")

    def blocks(self, content: bytes, first: int, last: int, ocr: bool) -> list[dict]:
        pages = self.page_texts(content)[first - 1 : last]
        return [{"page": first + i, "label": "text", "type": "paragraph", "content": line} for i, page in enumerate(pages) for line in page.splitlines() if line.strip()]


def page_texts(files: DataFrame, extractor: Callable[[], Extractor]) -> DataFrame:
    """(doc_id, page, text) of every page; a document that doesn't parse is one page without text."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = extractor()
        for batch in batches:
            doc, page, text = [], [], []
            for i, content in enumerate(batch.column(1)):
                try:
                    texts = parser.page_texts(content.as_py()) or [None]
                except Exception:  # whatever a parser raises, the document counts as one page
                    texts = [None]
                doc += [i] * len(texts)
                page += range(1, len(texts) + 1)
                text += texts
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(page, pa.int32()), pa.array(text, pa.string())], names=["doc_id", "page", "text"])

    return files.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, page int, text string")


def extract_blocks(files: DataFrame, runs: DataFrame, extractor: Callable[[], Extractor]) -> DataFrame:
    """Blocks of every document, its runs of pages (first_page, last_page, needs_ocr) going to OCR or not; empty content is dropped."""
    routed = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_page", "last_page", "needs_ocr"))).alias("runs"))
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(f.name, arrow[f.dataType.simpleString()]) for f in BLOCK_SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = extractor()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                parts = (b for r in row["runs"] for b in parser.blocks(row["content"], r["first_page"], r["last_page"], r["needs_ocr"]))
                rows += [{"doc_id": row["doc_id"], "pos": i} | b for i, b in enumerate(b for b in parts if b.get("content"))]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.join(routed, "doc_id").select("doc_id", "content", "runs").mapInArrow(run, BLOCK_SCHEMA)


def log_shows_gpu(log: DataFrame, marks: tuple[str, ...] = ("cuda", "offloaded", "gpu")) -> DataFrame:
    """(gpu) whether any line of a server's log has one of the marks."""
    low = F.lower("value")
    hit = low.contains(marks[0])
    for mark in marks[1:]:
        hit |= low.contains(mark)
    return log.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("gpu"))


def same_model(wanted: Column, offered: Column) -> Column:
    """Whether a model's name is another's, with or without its tag."""
    return (wanted == offered) | (F.split(wanted, ":")[0] == F.split(offered, ":")[0])


def synthetic_pages(spark: SparkSession, pages: int, table_every: int = 2, image_every: int = 5) -> DataFrame:
    """Blocks of a generated book: a heading and two paragraphs a page, a table on every second and an image on every fifth."""
    kinds = F.array(F.lit("heading"), F.lit("paragraph"), F.lit("paragraph"), F.when(F.col("page") % table_every == 0, "table"), F.when(F.col("page") % image_every == 0, "image"))
    rows = spark.range(1, pages + 1).select(F.col("id").cast("int").alias("page")).select("page", F.posexplode(F.array_compact(kinds)).alias("at", "type"))
    return rows.select("page", "at", "type", F.format_string("%s %d.%d", "type", "page", "at").alias("content"))
