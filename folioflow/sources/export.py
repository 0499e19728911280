"""Finished documents as files: exporters of Markdown, EPUB and PDF, and a reader of EPUB.

An exporter turns one document's Markdown into a file's bytes; tables of
documents go through it in Arrow batches, and each file is written whole or not
at all into a folder that all machines mount. The EPUB and PDF forms need no
outside engine: headings, paragraphs, list items and code are carried over,
everything else as plain text.
"""

from __future__ import annotations

import html
import io
import os
import re
import shutil
import subprocess
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"(#{1,6})\s+(.*)", re.S)
_FENCE = re.compile(r"```(\S*)\n(.*?)\n?```", re.S)


def markdown_parts(markdown: str) -> list[tuple[str, str]]:
    """(kind, text) of a document's blocks in order: h1 to h6, li, pre or p. Blank lines part blocks, but not inside code."""
    out, at = [], 0
    for m in [*re.finditer(r"(?ms)^```[^\n]*\n.*?^```[ \t]*$", markdown), None]:
        for block in re.split(r"\n[ \t]*\n", markdown[at : m.start() if m else len(markdown)]):
            if not (text := block.strip()):
                continue
            if head := _HEADING.fullmatch(text):
                out.append((f"h{len(head[1])}", head[2]))
            elif text.startswith("- "):
                out.append(("li", text[2:]))
            else:
                out.append(("p", text))
        if m:
            code = _FENCE.fullmatch(m[0].rstrip())
            out.append(("pre", code[2] if code else m[0]))
            at = m.end()
    return out


def markdown_title(markdown: str, default: str = "Documento") -> str:
    """The first heading of the first level, else of the second, else the default."""
    heads = [(k, t) for k, t in markdown_parts(markdown) if k in ("h1", "h2")]
    return next((t.strip() for k, t in heads if k == "h1"), heads[0][1].strip() if heads else default)


class Exporter(Protocol):
    """A form of finished documents."""

    suffix: str

    def export(self, markdown: str, title: str | None = None) -> bytes: ...


class MarkdownExporter:
    suffix = ".md"

    def export(self, markdown: str, title: str | None = None) -> bytes:
        return markdown.encode()


# The container's format.
_CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
_XHTML = '<?xml version="1.0" encoding="utf-8"?><!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{lang}"><head><title>{title}</title></head><body>{body}</body></html>'
_PACKAGE = (
    '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:uuid:{id}</dc:identifier>'
    '<dc:title>{title}</dc:title><dc:language>{lang}</dc:language><meta property="dcterms:modified">2000-01-01T00:00:00Z</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
    '<item id="text" href="text.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="text"/></spine></package>'
)
_NOT_XML = re.compile("[^\t\n\r -퟿-�\U00010000-\U0010ffff]")


class EpubExporter:
    """EPUB 3 with title, language and a table of contents three levels deep; the same document gives the same bytes."""

    suffix = ".epub"

    def __init__(self, lang: str = "pt-BR", toc_depth: int = 3):
        self.lang, self.toc_depth = lang, toc_depth

    def export(self, markdown: str, title: str | None = None) -> bytes:
        clean = lambda t: html.escape(_NOT_XML.sub("", t), quote=False)
        name = clean(title or markdown_title(markdown))
        body, toc = [], []
        for i, (kind, text) in enumerate(markdown_parts(markdown)):
            inner = clean(text)
            if kind == "li":
                body.append(f"<ul><li>{inner}</li></ul>")
            elif kind == "pre":
                body.append(f"<pre><code>{inner}</code></pre>")
            else:
                body.append(f'<{kind} id="b{i}">{inner}</{kind}>')
            if kind[0] == "h" and int(kind[1]) <= self.toc_depth:
                toc.append(f'<li><a href="text.xhtml#b{i}">{inner}</a></li>')
        nav = f'<nav epub:type="toc"><ol>{"".join(toc) or "<li><a href=" + chr(34) + "text.xhtml" + chr(34) + f">{name}</a></li>"}</ol></nav>'
        page = lambda b: _XHTML.format(lang=self.lang, title=name, body=b)
        files = {"META-INF/container.xml": _CONTAINER, "OEBPS/content.opf": _PACKAGE.format(id=uuid.uuid5(uuid.NAMESPACE_URL, markdown), title=name, lang=self.lang), "OEBPS/nav.xhtml": page(nav), "OEBPS/text.xhtml": page("\n".join(body) or f"<p>{name}</p>")}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
            for path, text in files.items():
                z.writestr(zipfile.ZipInfo(path), text, zipfile.ZIP_DEFLATED)
        return out.getvalue()


class PdfExporter:
    """A plain PDF of A4 pages in Helvetica; letters that its encoding lacks become question marks."""

    suffix = ".pdf"
    width, height, margin = 595, 842, 56

    def export(self, markdown: str, title: str | None = None) -> bytes:
        lines: list[tuple[int, str]] = []
        for kind, text in markdown_parts(markdown):
            size = {"h1": 18, "h2": 15, "h3": 13}.get(kind, 10)
            room = int((self.width - 2 * self.margin) / (size * 0.5))
            for line in text.split("\n"):
                words, now = ("• " * (kind == "li") + line).split(" "), ""
                for word in words:
                    while len(word) > room:
                        lines.append((size, f"{now} {word[:room]}".strip())) if now else lines.append((size, word[:room]))
                        now, word = "", word[room:]
                    if now and len(now) + 1 + len(word) > room:
                        lines.append((size, now))
                        now = word
                    else:
                        now = f"{now} {word}" if now else word
                lines.append((size, now))
            lines.append((6, ""))
        pages: list[list[str]] = [[]]
        y = self.height - self.margin
        for size, text in lines:
            y -= int(size * 1.4)
            if y < self.margin:
                pages.append([])
                y = self.height - self.margin - int(size * 1.4)
            shown = text.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
            pages[-1].append(f"BT /F1 {size} Tf {self.margin} {y} Td ({shown}) Tj ET")
        objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
        out = bytearray(b"%PDF-1.4\n")
        parts: list[bytes] = [o.encode() for o in objects]
        for i, page in enumerate(pages):
            parts.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {self.width} {self.height}] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
            data = zlib.compress("\n".join(page).encode("cp1252", "replace"))
            parts.append(f"<< /Length {len(data)} /Filter /FlateDecode >>\nstream\n".encode() + data + b"\nendstream")
        at = []
        for i, part in enumerate(parts):
            at.append(len(out))
            out += f"{i + 1} 0 obj\n".encode() + part + b"\nendobj\n"
        start = len(out)
        out += f"xref\n0 {len(parts) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{a:010d} 00000 n \n".encode() for a in at)
        out += f"trailer\n<< /Size {len(parts) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
        return bytes(out)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.kind, self.text = "", ""

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre"):
            self.kind, self.text = tag, ""
        elif tag == "img" and not self.kind:
            given = dict(attrs)
            self.parts.append(f"![{given.get('alt') or ''}]({given.get('src') or ''})")

    def handle_data(self, data):
        if self.kind:
            self.text += data

    def handle_endtag(self, tag):
        if tag == self.kind:
            text = self.text if tag == "pre" else self.text.strip()
            if text.strip():
                self.parts.append({"li": f"- {text}", "pre": f"```\n{text}\n```", "p": text}.get(tag) or f"{'#' * int(tag[1])} {text}")
            self.kind = ""


def read_epub(content: bytes) -> str:
    """An EPUB's text as Markdown, in the order of its spine."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        package = re.search(r'full-path="([^"]+)"', z.read("META-INF/container.xml").decode())[1]
        opf, base = z.read(package).decode(), os.path.dirname(package)
        items = {}
        for item in re.findall(r"<item\b[^>]*>", opf):
            given = dict(re.findall(r'([\w:-]+)="([^"]*)"', item))
            items[given.get("id")] = given.get("href", "")
        out = []
        for ref in re.findall(r'<itemref\b[^>]*\bidref="([^"]+)"', opf):
            reader = _Reader()
            reader.feed(z.read(os.path.normpath(os.path.join(base, items[ref]))).decode())
            out += reader.parts
    return "\n\n".join(out) + "\n" if out else ""


def validate_epub(content: bytes, tool: str | None = "epubcheck") -> tuple[bool, str]:
    """(valid, message): the container's structure, then the outside checker where it is installed; without one that step is passed over."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            first = z.infolist()[0]
            if first.filename != "mimetype" or first.compress_type != zipfile.ZIP_STORED or z.read(first) != b"application/epub+zip":
                return False, "mimetype is not the first, stored entry"
        read_epub(content)
    except (zipfile.BadZipFile, KeyError, IndexError, TypeError, UnicodeDecodeError) as e:
        return False, f"damaged container: {e}"
    path = shutil.which(tool) if tool else None
    if not path:
        return True, "no outside checker found; its step is passed over"
    name = f"{os.environ.get('TMPDIR', '/tmp')}/{uuid.uuid4().hex}.epub"
    try:
        with open(name, "wb") as f:
            f.write(content)
        done = subprocess.run([path, name], capture_output=True, text=True, check=False)
        return done.returncode == 0, done.stdout + done.stderr
    except OSError as e:
        return False, str(e)
    finally:
        if os.path.exists(name):
            os.remove(name)


#: Steps of a route that turn one document's bytes into others.
STEPS: dict[str, Callable[[bytes], bytes]] = {
    "copy": lambda b: b,
    "read_epub": lambda b: read_epub(b).encode(),
    "export_epub": lambda b: EpubExporter().export(b.decode()),
    "export_pdf": lambda b: PdfExporter().export(b.decode()),
}


def run_steps(files: DataFrame) -> DataFrame:
    """files (content binary, steps array) with the converted content, and error where a step fails or is not one of STEPS.

    Extraction and translation are dataflows of their own; a route that begins
    with them is taken up here once its Markdown is there. Null content stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, errors = [], []
            for content, steps in zip(batch.column(batch.schema.get_field_index("content")), batch.column(batch.schema.get_field_index("steps"))):
                value, error = content.as_py(), None
                try:
                    for step in steps.as_py() or []:
                        value = value if value is None else STEPS[step](value)
                except Exception as e:  # whatever a step raises is that file's result
                    value, error = None, f"{type(e).__name__}: {e}"
                done.append(value)
                errors.append(error)
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("content", "error")]
            names = [n for n in batch.schema.names if n not in ("content", "error")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(done, pa.binary()), pa.array(errors, pa.string())], names=[*names, "content", "error"])

    kept = [f for f in files.schema if f.name not in ("content", "error")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "content binary", "error string"])
    return files.mapInArrow(run, schema)


def checked(files: DataFrame, tool: str | None = "epubcheck") -> DataFrame:
    """files (content binary) with valid: whether each is a whole EPUB, by validate_epub()."""

    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda b: b is not None and validate_epub(bytes(b), tool)[0]).astype(bool)

    return files.withColumn("valid", F.pandas_udf(run, "boolean")("content"))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, content) as files of a folder that all machines mount; (name, bytes) of those written.

    Each file is written aside and renamed, so it is there whole or not at all
    and a task that runs again does no harm. Names stay below the folder; the
    result has to be read for the files to be written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = os.path.normpath(os.path.join(folder, name))
                if not path.startswith(os.path.normpath(folder) + os.sep):
                    raise ValueError(f"{name} leads out of the folder")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(aside := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(content)
                os.replace(aside, path)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return files.where("name is not null and content is not null").select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, bytes long")


def export_documents(documents: DataFrame, exporter: Callable[[], Exporter], folder: str, assets: DataFrame | None = None) -> DataFrame:
    """Write documents (name without suffix, markdown) in the exporter's form, and assets (name, content) under assets/ beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = exporter()
        for batch in batches:
            names = [f"{n}{out.suffix}" for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([out.export(m) for m in batch.column(1).to_pylist()], pa.binary())], names=["name", "content"])

    files = documents.where("name is not null and markdown is not null").select("name", "markdown").mapInArrow(run, "name string, content binary")
    if assets is not None:
        files = files.unionByName(assets.select(F.concat(F.lit("assets/"), "name").alias("name"), "content"))
    return write_files(files, folder)
