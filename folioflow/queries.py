"""Queries over the driver's tables, one or more per operator, with DuckDB SQL of the same results.

The tables hold plain text and raw pages, so some inputs are enriched by
expressions that Spark and DuckDB share: labels from a line's looks, code and
paths put around a URL, and the like.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import glossary as G
from .functions import placeholders as PH
from .functions import text as T
from .functions import validation as V
from .operators import assembly, blocks, checkpoints, cleaning, progress, segmentation
from .operators import translation as R
from .plans import convert
from .sources import export, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BUDGET = 120
GLOSSARY = G.Glossary(("the", "der", "que"), {"with": "mit", "for": "für"})


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.text_blocks(_read(spark, sf_dir, "documents"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.semantic_chunks(blocks.renumber(_lines(spark, sf_dir)), BUDGET)


# Parts of the SQL, as common table expressions.
WORDS = r"(CASE WHEN trim({0}, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE len(regexp_extract_all({0}, '[^\s]+')) END)"


def _tokens(x: str) -> str:
    return f"({WORDS.format(x)} * 13 // 10)::INT"


LINES = """
lines AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, content
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
  WHERE trim(content) <> ''),
labelled AS (
  SELECT *, (pos // 3 + 1)::INT AS page,
    CASE WHEN pos = 0 THEN 'title' WHEN contains(content, ' | ') THEN 'table' WHEN contains(content, '$$$ ') THEN 'code' WHEN length(content) < 40 THEN 'list_item' ELSE 'text' END AS label
  FROM lines),
blocks AS (
  SELECT *, CASE label WHEN 'title' THEN 'heading' WHEN 'text' THEN 'paragraph' ELSE label END AS type, label NOT IN ('table', 'code') AS translatable
  FROM labelled),
marked AS (
  SELECT *, CASE type WHEN 'heading' THEN '# ' || content
    WHEN 'list_item' THEN CASE WHEN regexp_matches(trim(content), '^(\\*|-|\\+|\\d+\\.)\\s+') THEN trim(content) ELSE '- ' || trim(content) END
    WHEN 'code' THEN '```' || chr(10) || content || chr(10) || '```' ELSE content END AS markdown
  FROM blocks)""".replace("\\\\", "\\")


def _packed(source: str, barrier: str, budget: int = BUDGET) -> str:
    """The greedy fold as a recursive query."""
    return f"""
items AS (SELECT *, {_tokens('markdown')} AS tokens, {barrier} AS barrier FROM {source}),
packed AS (
  SELECT doc_id, pos, CASE WHEN barrier THEN 0 ELSE 1 END AS open, CASE WHEN barrier THEN 0 ELSE tokens END AS run, 0 AS chunk_idx FROM items WHERE pos = 0
  UNION ALL
  SELECT i.doc_id, i.pos,
    CASE WHEN i.barrier THEN 0 WHEN p.open = 0 OR p.run + i.tokens > {budget} THEN 1 ELSE p.open + 1 END,
    CASE WHEN i.barrier THEN 0 WHEN p.open = 0 OR p.run + i.tokens > {budget} THEN i.tokens ELSE p.run + i.tokens END,
    CASE WHEN i.barrier OR p.open = 0 OR p.run + i.tokens > {budget} THEN p.chunk_idx + 1 ELSE p.chunk_idx END
  FROM packed p JOIN items i ON i.doc_id = p.doc_id AND i.pos = p.pos + 1),
chunked AS (SELECT i.*, p.chunk_idx FROM items i JOIN packed p USING (doc_id, pos)),
chunks AS (
  SELECT doc_id, chunk_idx, 'chunk-' || chunk_idx AS id, string_agg(markdown, chr(10) || chr(10) ORDER BY pos) AS original_text,
    min(page) AS page_start, max(page) AS page_end, count(*)::INT AS n_blocks, CASE WHEN bool_and(NOT barrier) THEN 'pending' ELSE 'skipped' END AS status
  FROM chunked GROUP BY doc_id, chunk_idx)"""


CHUNKS = f"WITH RECURSIVE {LINES}, {_packed('marked', 'NOT translatable')}"


@query(f"WITH RECURSIVE {LINES}, plain AS (SELECT doc_id, pos, page, content AS markdown FROM lines JOIN labelled USING (doc_id, pos, content)), {_packed('plain', 'false')} SELECT doc_id, chunk_idx, n_blocks, (SELECT sum(tokens) FROM chunked c WHERE c.doc_id = k.doc_id AND c.chunk_idx = k.chunk_idx)::BIGINT AS tokens FROM chunks k")
def w2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy token packing of lines into chunks of at most 120 tokens."""
    lines = _lines(spark, sf_dir).withColumn("tokens", T.estimate_tokens(F.col("content")))
    packed = segmentation.assign_chunks(lines, BUDGET, barriers=False)
    return packed.groupBy("doc_id", "chunk_idx").agg(F.count("*").cast("int").alias("n_blocks"), F.sum("tokens").alias("tokens"))


@query(f"{CHUNKS} SELECT doc_id, chunk_idx, id, md5(original_text) AS text_md5, page_start, page_end, n_blocks, {_tokens('original_text')} AS token_count, status FROM chunks")
def w4_semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with barriers, their Markdown, pages and tokens."""
    return _chunks(spark, sf_dir).select("doc_id", "chunk_idx", "id", F.md5("original_text").alias("text_md5"), "page_start", "page_end", "n_blocks", "token_count", "status")


NAIVE = LINES + ", naive AS (SELECT doc_id, pos, page, CASE type WHEN 'heading' THEN '# ' || content WHEN 'list_item' THEN '- ' || content WHEN 'code' THEN '```' || chr(10) || content || chr(10) || '```' ELSE content END AS markdown FROM blocks)"


@query(f"WITH RECURSIVE {NAIVE}, {_packed('naive', 'false')} SELECT doc_id, chunk_idx, md5(original_text) AS text_md5, page_start, page_end, n_blocks, {_tokens('original_text')} AS token_count, status FROM chunks")
def p7_naive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without barriers, in plain Markdown."""
    chunks = segmentation.naive_chunks(blocks.renumber(_lines(spark, sf_dir)), BUDGET)
    return chunks.select("doc_id", "chunk_idx", F.md5("original_text").alias("text_md5"), "page_start", "page_end", "n_blocks", "token_count", "status")


@query(None)
def p6_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages as typed blocks with their Markdown; nested tags are beyond RE2, so tests hold it against an HTML parser."""
    rows = blocks.renumber(blocks.html_blocks(_read(spark, sf_dir, "pages")))
    marked = T.semantic_markdown(F.col("type"), F.col("content"), F.col("block_id"), F.col("heading_level"), F.col("language"), F.col("alt"))
    return rows.select("doc_id", "pos", "page", "type", "translatable", "block_id", marked.alias("markdown"))


LEVELS = """(VALUES ('title', 0, 9, '', 'cap'), ('section_header', 0, 0, 'x', NULL), ('text', NULL, 3, NULL, ''), ('picture', 7, NULL, '', ''), ('formula', 2, 2, 'y', 'z'), ('sidebar', NULL, NULL, NULL, NULL)) AS t(label, page, level, txt, caption)"""


@query(
    f"""SELECT n_nationkey, label, coalesce(page, n_nationkey)::INT AS page, CASE label WHEN 'title' THEN 'heading' WHEN 'section_header' THEN 'heading' WHEN 'text' THEN 'paragraph' WHEN 'picture' THEN 'image' WHEN 'formula' THEN 'formula' ELSE 'unknown' END AS type,
    label NOT IN ('picture', 'formula') AS translatable, (CASE WHEN level IS NOT NULL THEN greatest(1, least(6, level)) WHEN label = 'section_header' THEN 2 ELSE 1 END)::INT AS level, coalesce(nullif(caption, ''), nullif(txt, ''), 'image_' || n_nationkey) AS alt, printf('img_doc_%03d.png', n_nationkey) AS name
    FROM nation, {LEVELS}"""
)
def p1_p5_item_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label to type, page, translatable flag, heading level, alternative text and image name of parsed items."""
    items = spark.createDataFrame([("title", 0, 9, "", "cap"), ("section_header", 0, 0, "x", None), ("text", None, 3, None, ""), ("picture", 7, None, "", ""), ("formula", 2, 2, "y", "z"), ("sidebar", None, None, None, None)], "label string, page int, level int, txt string, caption string")
    rows = _read(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(items))
    prov = F.when(F.col("page").isNotNull(), F.array(F.struct(F.col("page").alias("page_no")))).otherwise(F.array().cast("array<struct<page_no:int>>"))
    rows = blocks.page_numbers(rows.withColumns({"prov": prov, "slice_start": F.col("n_nationkey")}))
    kind = T.block_type(F.col("label"))
    return rows.select(
        "n_nationkey", "label", "page", kind.alias("type"), T.is_translatable(kind).alias("translatable"),
        T.heading_level(F.col("level"), F.col("label")).alias("level"), T.image_alt(F.col("caption"), F.col("txt"), F.col("n_nationkey")).alias("alt"), T.image_name(F.lit("doc"), F.col("n_nationkey")).alias("name"),
    )


def _cleaned(name: str, source: str, key: str = "doc_id") -> str:
    """SQL of one cleaning pass over source, as CTE name."""
    return f"""
{name}_prose AS (SELECT *, regexp_replace(lower(trim(content)), '\\d+', '#', 'g') AS running, type IN ('paragraph', 'heading') AS prose FROM {source}),
{name}_edges AS (
  SELECT *, prose AND pos = min(CASE WHEN prose THEN pos END) OVER (PARTITION BY {key}, page) AS is_first,
    prose AND pos = max(CASE WHEN prose THEN pos END) OVER (PARTITION BY {key}, page) AS is_last, length(trim(content)) < 120 AS short
  FROM {name}_prose),
{name}_pages AS (SELECT {key}, count(DISTINCT page) AS pages FROM {source} GROUP BY {key}),
{name}_runs AS (
  SELECT {key}, running, count(*) FILTER (is_first AND short AND NOT regexp_matches(lower(trim(content)), '^(chapter|capítulo|section|seção|part|parte)([^\\p{{L}}\\p{{N}}_]|$)')) AS as_header,
    count(*) FILTER (is_last AND short) AS as_footer
  FROM {name}_edges GROUP BY {key}, running),
{name} AS (
  SELECT e.* EXCLUDE (running, prose, is_first, is_last, short) FROM {name}_edges e JOIN {name}_runs r USING ({key}, running) JOIN {name}_pages p USING ({key})
  WHERE NOT (prose AND regexp_matches(trim(content), '(?i)^(page|pág\\.?|p\\.)?\\s*\\d+\\s*(/\\s*\\d+|of\\s*\\d+)?$|^[-—–]\\s*\\d+\\s*[-—–]$|^\\[\\s*\\d+\\s*\\]$'))
    AND NOT (pages >= 2 AND is_first AND as_header >= 2) AND NOT (pages >= 2 AND is_last AND as_footer >= 2))"""


@query(f"WITH {LINES}, {_cleaned('cleaned', 'blocks')} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, page, type, md5(content) AS content_md5, 'b' || (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) AS block_id FROM cleaned")
def c1_c7_clean_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running headers, footers and page numbers off; dense ids."""
    return cleaning.clean(_lines(spark, sf_dir)).select("doc_id", "pos", "page", "type", F.md5("content").alias("content_md5"), "block_id")


@query(f"WITH {LINES}, windowed AS (SELECT *, (page - 1) // 10 AS w FROM blocks), {_cleaned('once', 'windowed', 'doc_id, w')}, {_cleaned('cleaned', 'once')} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, page, type, md5(content) AS content_md5 FROM cleaned")
def s5_clean_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten pages cleaned each, and the whole document after them."""
    return cleaning.clean(_lines(spark, sf_dir), window_pages=10).select("doc_id", "pos", "page", "type", F.md5("content").alias("content_md5"))


@query(f"WITH {LINES}, {_cleaned('cleaned', 'blocks')} SELECT doc_id, running, as_header, as_footer FROM cleaned_runs WHERE as_header >= 2 OR as_footer >= 2")
def a2_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that run at the top or bottom of two or more pages."""
    rows = cleaning.repeated_lines(cleaning.page_edges(cleaning.drop_labelled(_lines(spark, sf_dir))))
    return rows.where("as_header >= 2 or as_footer >= 2").select("doc_id", "running", "as_header", "as_footer").distinct()


NUMBERED = "(VALUES ('%d'), (' %d '), ('Page %d'), ('pág. %d'), ('- %d -'), ('[ %d ]'), ('%d / 10'), ('%d of 30'), ('Chapter %d: The Beginning'), ('There are %d workers.'), ('Section %d.1 Overview'), ('')) AS t(form)"


@query(rf"SELECT event_id, form, regexp_matches(trim(x), '(?i)^(page|pág\.?|p\.)?\s*\d+\s*(/\s*\d+|of\s*\d+)?$|^[-—–]\s*\d+\s*[-—–]$|^\[\s*\d+\s*\]$') AS is_page_number, regexp_matches(lower(trim(x)), '^(chapter|capítulo|section|seção|part|parte)([^\p{{L}}\p{{N}}_]|$)') AS is_exempt, regexp_replace(lower(trim(x)), '\d+', '#', 'g') AS running FROM (SELECT event_id, form, replace(form, '%d', user_id::VARCHAR) AS x FROM events, {NUMBERED})")
def c2_page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-number lines, exempt headings and normal forms."""
    forms = ["%d", " %d ", "Page %d", "pág. %d", "- %d -", "[ %d ]", "%d / 10", "%d of 30", "Chapter %d: The Beginning", "There are %d workers.", "Section %d.1 Overview", ""]
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", F.explode(F.array(*map(F.lit, forms))).alias("form"))
    text = F.replace("form", F.lit("%d"), F.col("user_id").cast("string"))
    return rows.select("event_id", "form", T.is_page_number(text).alias("is_page_number"), T.is_exempt_heading(text).alias("is_exempt"), T.running_form(text).alias("running"))


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]'))::INT AS alnum, {_tokens('text')} AS tokens, {WORDS.format('text')}::INT AS words FROM documents")
def f1_f2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and digits, words and estimated tokens."""
    return _read(spark, sf_dir, "documents").select("doc_id", T.count_alnum(F.col("text")).alias("alnum"), T.estimate_tokens(F.col("text")).alias("tokens"), T.count_words(F.col("text")).alias("words"))


# RE2 knows word ends in ASCII only, so they are classes of their neighbours, which a match takes in: two passes find matches side by side, and chr(31) keeps a joined word from being joined again.
CUT = r"(^|[^\p{L}\p{M}\p{N}_])([a-zA-Z]+)-[\s\x0B\x{85}\p{Z}]*\n[\s\x0B\x{85}\p{Z}]*([a-zA-Z]+)([^\p{L}\p{M}\p{N}_]|$)"


def _joined(x: str) -> str:
    return f"regexp_replace({x}, '{CUT}', '\\1\\2\\3' || chr(31) || '\\4', 'g')"


@query("SELECT doc_id, md5(replace(" + _joined(_joined("replace(text, 'tion ', 'ti-' || chr(10) || ' on ')")) + ", chr(31), '')) AS joined_md5 FROM documents")
def f3_dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words cut at line ends put together."""
    text = F.replace("text", F.lit("tion "), F.lit("ti-\n on "))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(T.dehyphenate(text)).alias("joined_md5"))


ENRICHED = "SELECT page_id, 'See ' || url || ' and `' || left(url, 12) || '` in conf/x' || page_id || '.toml, ./run.sh or /etc/app/' || page_id || '.conf; then `a b` at ' || url || ' end.' AS text FROM pages"


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, i = F.col("url"), F.col("page_id").cast("string")
    parts = ["See ", u, " and `", F.left(u, F.lit(12)), "` in conf/x", i, ".toml, ./run.sh or /etc/app/", i, ".conf; then `a b` at ", u, " end."]
    return _read(spark, sf_dir, "pages").select("page_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))


def _protect_sql() -> str:
    """Three passes of extracting and interleaving."""
    patterns = [r"`[^`\n]+`", r"""https?://[^\s)\]>"''`]+""", r"(?:(?:~|\.{1,2})/(?:[a-zA-Z0-9_.\-]+/?)+|/(?:[a-zA-Z0-9_.\-]+/)+[a-zA-Z0-9_.\-]+|[a-zA-Z0-9_.\-]+/(?:[a-zA-Z0-9_.\-]+/)*[a-zA-Z0-9_\-]+\.[a-zA-Z0-9]{1,6})"]
    out = f"WITH p0 AS (SELECT page_id, text AS original, text, []::VARCHAR[] AS found FROM ({ENRICHED}))"
    for k, p in enumerate(patterns):
        out += f", m{k} AS (SELECT *, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS parts FROM p{k})"
        out += f", p{k + 1} AS (SELECT page_id, original, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN i = 1 THEN parts[i] ELSE '__PH_' || (len(found) + i - 2) || '__' || parts[i] END), '') AS text, list_concat(found, hits) AS found FROM m{k})"
    return out


@query(_protect_sql() + " SELECT page_id, text AS protected, array_to_string(found, '|') AS placeholders FROM p3")
def r1_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline code, URLs and paths as placeholders, numbered pass by pass."""
    out = PH.protect(_enriched(spark, sf_dir))
    return out.select("page_id", "protected", F.array_join("placeholders", "|").alias("placeholders"))


@query(f"SELECT page_id, text AS restored, true AS same FROM ({ENRICHED})")
def r2_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders back, also from lower case and with spaces inside."""
    out = PH.protect(_enriched(spark, sf_dir))
    spoken = F.regexp_replace(F.lower("protected"), r"__ph_(\d+)__", "__ ph_$1 __")
    exact = PH.restore(F.col("protected"), F.col("placeholders"))
    return out.select("page_id", exact.alias("restored"), (PH.restore(spoken, F.col("placeholders")) == PH.restore(F.lower("protected"), F.col("placeholders"))).alias("same"))


def _term(column: str, term: str) -> str:
    return rf"regexp_matches({column}, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_]){term}(s|es)?([^\p{{L}}\p{{M}}\p{{N}}_]|$)')"


@query(
    "SELECT doc_id, array_to_string(list_filter([CASE WHEN " + "), CASE WHEN ".join(f"{_term('text', t)} THEN '{t}' END" for t in GLOSSARY.preserve).replace("), CASE", ", CASE") + "], lambda x: x IS NOT NULL), ',') AS preserve, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {_term('text', s)} THEN '{s}={d}' END" for s, d in GLOSSARY.translate.items()) + "], lambda x: x IS NOT NULL), ',') AS translate FROM documents"
)
def g2_applicable_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary terms that each document has."""
    found = G.applicable_terms(_read(spark, sf_dir, "documents"), G.glossary_table(spark, GLOSSARY), ["doc_id"])
    return found.select("doc_id", F.array_join("preserve", ",").alias("preserve"), F.array_join(F.transform("translate", lambda t: F.concat(t.src, F.lit("="), t.dst)), ",").alias("translate"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant's next one."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    rows = _read(spark, sf_dir, "conversations").withColumns({"response": F.lead("text").over(turns), "next": F.lead("role").over(turns)})
    return rows.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("original"), "response")


TURNS = "turns AS (SELECT conv_id, turn, text AS original, response FROM (SELECT *, lead(text) OVER w AS response, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant')"


@query(
    f"WITH {TURNS} SELECT conv_id, turn, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {_term('original', t)} AND NOT {_term('response', t)} THEN 'Preserved term ''{t}'' is missing from translation.' END" for t in GLOSSARY.preserve)
    + ", " + ", ".join(f"CASE WHEN {_term('original', s)} AND NOT {_term('response', d)} THEN 'Translation target ''{d}'' for source ''{s}'' is missing from translation.' END" for s, d in GLOSSARY.translate.items())
    + "], lambda x: x IS NOT NULL), ' ') AS violations FROM turns"
)
def g4_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary terms that answers lack."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(G.violations(F.col("response"), F.col("original"), GLOSSARY), " ").alias("violations"))


TECH = G.Glossary(("bug", "pipeline", "deploy", "commit", "framework"), {"machine learning": "aprendizado de máquina", "thread": "thread"})
ORIGINALS = ["The build pipeline failed because of a bug.", "Machine learning on each thread.", "Deploy the framework.", "Nothing here."]
ANSWERS = ["A esteira de integração falhou por causa de um defeito.", "Aprendizagem automática em cada fio de execução.", "Implantação do arcabouço.", "O pipeline e o inseto."]
CORRECTED = ["A pipeline falhou por causa de um bug.", "aprendizado de máquina em cada thread.", "deploy do framework.", "O pipeline e o inseto."]


@query("SELECT n_nationkey, i::INT AS i, [" + ", ".join(f"'{x}'" for x in CORRECTED) + "][i + 1] AS corrected FROM nation, range(4) AS t(i)")
def g3_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered corrections by the glossary."""
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    of = lambda texts: F.array(*map(F.lit, texts))[F.col("i")]
    return rows.select("n_nationkey", "i", G.correct(of(ANSWERS), of(ORIGINALS), TECH).alias("corrected"))


@query(
    f"""WITH {TURNS}, counted AS (SELECT *, len(regexp_extract_all(original, '(?m)^\\s*(?:[-*+]|\\d+[.)])\\s+')) AS a, len(regexp_extract_all(response, '(?m)^\\s*(?:[-*+]|\\d+[.)])\\s+')) AS b, length(trim(original)) AS n, length(trim(response)) AS m FROM turns)
    SELECT conv_id, turn, CASE WHEN m = 0 THEN 'A resposta do modelo veio vazia.' ELSE array_to_string(list_filter([CASE WHEN b < a OR b - a > greatest(1, a // 10) THEN printf('Quantidade de itens de lista diverge: original tem %d, tradução tem %d', a, b) END,
    CASE WHEN n >= 30 THEN CASE WHEN m / n < 0.4 THEN printf('Tamanho muito curto: razão %.2f < mínimo 0.4', m / n) WHEN m / n > 2.5 THEN printf('Tamanho muito longo: razão %.2f > máximo 2.5', m / n) END
    WHEN m > n * 4 + 25 THEN printf('Tamanho excedeu limite para texto curto: %d caracteres', m) END], lambda x: x IS NOT NULL), '; ') END AS reasons FROM counted"""
)
def v1_v6_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons against an answer, over pairs of turns."""
    found = V.validate(F.col("response"), F.col("original"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(found["reasons"], "; ").alias("reasons"))


# Answers that lose or gain headings, list items and placeholders, by the event's number.
_HEADS = "1 + k % 12 + CASE k % 5 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END"
_ITEMS = "1 + k % 7 + CASE k % 4 WHEN 0 THEN -1 WHEN 1 THEN 2 ELSE 0 END"
_CASE = "repeat('# H' || chr(10), (1 + k % 12)::INT) || repeat('- i' || chr(10), (1 + k % 7)::INT) || 'body of some length __PH_0__ and __PH_' || (k % 3) || '__'"
_ANSWER = f"repeat('# H' || chr(10), ({_HEADS})::INT) || repeat('- i' || chr(10), ({_ITEMS})::INT) || 'body of some length' || CASE WHEN k % 6 > 0 THEN ' __ ph_0 __' ELSE '' END || CASE WHEN k % 3 > 0 THEN ' __PH_' || (k % 3) || '__' ELSE '' END"
_OVER = "CASE WHEN {1} < {0} OR {1} - {0} > greatest(1, {0} // 10) THEN printf('Quantidade de {2} diverge: original tem %d, tradução tem %d', {0}, {1}) END"
_PLACES = "CASE WHEN len(lost) > 0 THEN 'Divergência de placeholders: esperado ' || want || ', ausente(s): [''' || array_to_string(lost, ''', ''') || ''']' END"


@query(
    f"""WITH cases AS (SELECT event_id, k, {_CASE} AS original, {_ANSWER} AS response FROM (SELECT event_id, event_id % 840 AS k FROM events)),
    counted AS (SELECT event_id, 1 + k % 12 AS ha, {_HEADS} AS hb, 1 + k % 7 AS la, {_ITEMS} AS lb, '[''__PH_0__'', ''__PH_1__'', ''__PH_2__'']' AS want,
      list_filter(['__PH_0__', '__PH_1__', '__PH_2__'], lambda x: NOT contains(upper(replace(response, ' ', '')), x)) AS lost FROM cases)
    SELECT event_id, array_to_string(list_filter([{_PLACES}, {_OVER.format('ha', 'hb', 'títulos')}, {_OVER.format('la', 'lb', 'itens de lista')}], lambda x: x IS NOT NULL), '; ') AS reasons FROM counted"""
)
def v2_v4_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost and added headings and list items, and placeholders that an answer lacks, in any spelling."""
    k = F.col("event_id") % 840
    line = lambda text, n: F.repeat(F.lit(text + "\n"), n.cast("int"))
    more = lambda of, cases: F.coalesce(*[F.when(of == c, F.lit(n)) for c, n in cases.items()], F.lit(0))
    own = F.concat(F.lit("__PH_"), (k % 3).cast("string"), F.lit("__"))
    original = F.concat(line("# H", 1 + k % 12), line("- i", 1 + k % 7), F.lit("body of some length __PH_0__ and "), own)
    tail = F.concat(F.lit("body of some length"), F.when(k % 6 > 0, " __ ph_0 __").otherwise(""), F.when(k % 3 > 0, F.concat(F.lit(" "), own)).otherwise(""))
    response = F.concat(line("# H", 1 + k % 12 + more(k % 5, {0: -1, 1: 1, 2: 2})), line("- i", 1 + k % 7 + more(k % 4, {0: -1, 1: 2})), tail)
    found = V.validate(response, original, F.array(F.lit("a"), F.lit("b"), F.lit("c")), least=0.0, most=99.0)
    return _read(spark, sf_dir, "events").select("event_id", F.array_join(found["reasons"], "; ").alias("reasons"))


@query("SELECT event_id, label FROM (SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'text' END AS label, event_id % 4 AS k FROM events) WHERE k > 1")
def c1_labelled_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a reader labelled as page headers or footers go, in any case; those without a label stay."""
    labels = F.array(F.lit("page_header"), F.lit("PAGE_FOOTER"), F.lit("text"), F.lit(None).cast("string"))
    rows = _read(spark, sf_dir, "events").select("event_id", labels[(F.col("event_id") % 4).cast("int")].alias("label"))
    return cleaning.drop_labelled(rows)


@query(None)
def v7_demote_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented headings back to plain lines: each page's blocks against the same with every second paragraph made a heading."""
    rows = blocks.html_blocks(_read(spark, sf_dir, "pages"))
    line = F.when(F.col("type") == "heading", F.concat(F.lit("# "), F.col("content"))).otherwise(F.col("content"))
    more = F.when((F.col("type") == "paragraph") & (F.col("pos") % 2 == 0), F.concat(F.lit("## "), F.col("content"))).otherwise(line)
    texts = rows.groupBy("doc_id").agg(segmentation.ordered_join(F.col("pos"), line).alias("original"), segmentation.ordered_join(F.col("pos"), more).alias("answer"))
    return texts.select("doc_id", V.demote_extra_headings("answer", "original").alias("demoted"))


FENCES = "(VALUES (0, '```markdown', '```'), (1, '```md', '```'), (2, '```', '```'), (3, '``` x', '```'), (4, '', '')) AS t(k, a, b)"


@query(f"SELECT conv_id, turn, k, md5(CASE WHEN k = 3 THEN a || chr(10) || trim(text, ' ' || chr(10)) || chr(10) || b ELSE trim(text, ' ' || chr(10)) END) AS inside_md5 FROM conversations, {FENCES}")
def l1_strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inside of a fence around a whole answer."""
    rows = _read(spark, sf_dir, "conversations").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    opening = F.array(*map(F.lit, ["```markdown", "```md", "```", "``` x", ""]))[F.col("_k")]
    closing = F.when(F.col("_k") < 4, "```").otherwise("")
    text = F.concat(opening, F.lit("\n"), T.strip(F.col("text")), F.lit("\n"), closing)
    return rows.select("conv_id", "turn", F.col("_k").alias("k"), F.md5(T.strip_code_fence(text)).alias("inside_md5"))


@query("SELECT conv_id, turn, md5(trim(text, ' ' || chr(10))) AS answer_md5 FROM conversations")
def l2_strip_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off with the prompt's own headings at an answer's start."""
    head = "### Glossary Rules:\n- the\n\n### Text to Translate to pt-BR:\n"
    text = F.concat(F.when(F.col("turn") % 2 == 0, head).otherwise(""), T.strip(F.col("text")))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.strip_echo(text)).alias("answer_md5"))


@query("SELECT doc_id, CASE WHEN length(trim(text, ' ' || chr(10))) > 400 THEN '...' || right(trim(text, ' ' || chr(10)), 400) ELSE trim(text, ' ' || chr(10)) END AS tail FROM documents")
def o5_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 400 characters."""
    return _read(spark, sf_dir, "documents").select("doc_id", T.tail(F.col("text")).alias("tail"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'T' || doc_id WHEN 1 THEN 'One ' || doc_id WHEN 2 THEN 'Two ' || doc_id ELSE 'Documento' END AS title FROM documents")
def o4_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title by the first rule that finds one."""
    i = F.col("doc_id").cast("string")
    heads = F.array(F.concat(F.lit('---\nlang: x\ntitle: "T'), i, F.lit('"\n---\n# H\n')), F.concat(F.lit("## Two\n# One "), i, F.lit("\n")), F.concat(F.lit("### x\n## Two "), i, F.lit("\n")), F.lit("plain\n"))
    return _read(spark, sf_dir, "documents").select("doc_id", T.markdown_title(heads[(F.col("doc_id") % 4).cast("int")]).alias("title"))


@query(
    f"""{CHUNKS}, seen AS (SELECT *, CASE WHEN status = 'pending' AND chunk_idx % 2 = 0 THEN 'translated' ELSE status END AS state, 'T ' || original_text AS translated FROM chunks),
    ctx AS (SELECT *, last_value(CASE WHEN state = 'translated' THEN original_text END IGNORE NULLS) OVER w AS po, last_value(CASE WHEN state = 'translated' THEN translated END IGNORE NULLS) OVER w AS pt FROM seen WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT doc_id, chunk_idx, md5(po) AS previous_md5, md5(array_to_string(list_filter([CASE WHEN po IS NOT NULL THEN '{R.CONTEXT_HEAD}' || chr(10) || chr(10) || 'Original:' || chr(10) || '\"\"\"' || chr(10) || CASE WHEN length(tpo) > 400 THEN '...' || right(tpo, 400) ELSE tpo END || chr(10) || '\"\"\"' || chr(10) || chr(10)
      || 'Translated (pt-BR):' || chr(10) || '\"\"\"' || chr(10) || CASE WHEN length(tpt) > 400 THEN '...' || right(tpt, 400) ELSE tpt END || chr(10) || '\"\"\"' END,
      '### Glossary Rules:' || chr(10) || 'Do not translate (preserve verbatim):' || chr(10) || '- the' || chr(10) || 'Translate as specified:' || chr(10) || '- "with" -> "mit"',
      '### Text to Translate to pt-BR:' || chr(10) || original_text], lambda x: x IS NOT NULL), chr(10) || chr(10))) AS prompt_md5 FROM (SELECT *, trim(po, ' ' || chr(10)) AS tpo, trim(pt, ' ' || chr(10)) AS tpt FROM ctx)"""
)
def l3_w5_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with the last translated chunk before as context."""
    done = (F.col("status") == "pending") & (F.col("chunk_idx") % 2 == 0)
    chunks = _chunks(spark, sf_dir).withColumn("translated_text", F.concat(F.lit("T "), "original_text")).withColumn("status", F.when(done, "translated").otherwise(F.col("status")))
    rows = R.with_context(chunks)
    fixed = F.array(F.struct(F.lit("with").alias("src"), F.lit("mit").alias("dst")))
    prompt = R.prompt_column(F.col("original_text"), "pt-BR", F.array(F.lit("the")), fixed, F.col("previous.original"), F.col("previous.translated"), F.array().cast("array<string>"))
    return rows.select("doc_id", "chunk_idx", F.md5("previous.original").alias("previous_md5"), F.md5(prompt).alias("prompt_md5"))


@query(f"{CHUNKS} SELECT doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY chunk_idx) || chr(10)) AS markdown_md5 FROM (SELECT doc_id, chunk_idx, CASE WHEN status = 'skipped' THEN original_text WHEN chunk_idx % 3 = 0 THEN trimmed WHEN chunk_idx % 3 = 1 THEN '<!-- NÃO TRADUZIDO -->' || chr(10) || chr(10) || trimmed ELSE 'T ' || trimmed END AS t FROM (SELECT *, trim(original_text, ' ' || chr(10)) AS trimmed FROM chunks)) GROUP BY doc_id")
def k5_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from pending, failed, translated and kept chunks."""
    chunks, turn = _chunks(spark, sf_dir), F.col("chunk_idx") % 3
    status = F.when(F.col("status") == "skipped", "skipped").when(turn == 0, "pending").when(turn == 1, "error").otherwise("translated")
    text = assembly.chunk_markdown(status, F.col("original_text"), F.concat(F.lit("T "), "original_text"), F.col("original_text"), F.lit(False))
    return assembly.assemble(chunks.withColumn("markdown", text)).select("doc_id", F.md5("markdown").alias("markdown_md5"))


@query(f"WITH {LINES} SELECT doc_id, pos, md5(CASE WHEN type = 'code' THEN '```' || chr(10) || trim(content) || chr(10) || '```' WHEN type = 'table' AND pos % 2 = 0 THEN '<table colspan=2>' || content || '</table>' ELSE trim(content) END) AS shown_md5 FROM blocks")
def p8_block_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in their output form, merged-cell tables as HTML."""
    rows = _lines(spark, sf_dir).withColumn("html", F.when((F.col("type") == "table") & (F.col("pos") % 2 == 0), F.concat(F.lit("<table colspan=2>"), "content", F.lit("</table>"))))
    shown = T.assembly_markdown(*[F.col(c) for c in ("type", "content", "language", "alt", "html", "is_complex")])
    return rows.select("doc_id", "pos", F.md5(shown).alias("shown_md5"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chunk states: user_id the document, event_id modulo 7 the chunk."""
    e = _read(spark, sf_dir, "events")
    status = F.array(*map(F.lit, ["translated", "error", "skipped", "pending"]))[(F.col("event_id") % 4).cast("int")]
    return e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).cast("int").alias("chunk_idx"), status.alias("status"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"), F.col("ts").alias("updated_at"), "event_id", checkpoints.text_key(F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string"))).alias("text_key"))


STATES = "states AS (SELECT user_id AS doc_id, (event_id % 7)::INT AS chunk_idx, ['translated', 'error', 'skipped', 'pending'][event_id % 4 + 1] AS status, 't' || event_id AS text, ts AS updated_at, event_id, sha256('c' || event_id % 7) AS text_key FROM events), latest AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY updated_at DESC, event_id DESC) = 1)"


@query(f"WITH {STATES} SELECT doc_id, chunk_idx, status, text FROM latest")
def k3_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of every chunk, from a table of states and two tables of changes put over it."""
    s = _states(spark, sf_dir)
    table = checkpoints.latest(s.where("event_id % 3 = 0"), order=("updated_at", "event_id"))
    for turn in (1, 2):
        table = checkpoints.upsert(table, s.where(F.col("event_id") % 3 == turn), order=("updated_at", "event_id"))
    return table.select("doc_id", "chunk_idx", "status", "text")


@query("SELECT user_id AS doc_id, status, text FROM (SELECT user_id, event_type AS status, 'v' || (event_id % 5) AS text, event_id % 3 AS updated_at FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, status DESC, text DESC) = 1")
def k3_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of states of one time the greatest by their other columns."""
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("status"), F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string")).alias("text"), (F.col("event_id") % 3).alias("updated_at"))
    return checkpoints.latest(e, keys=("doc_id",)).select("doc_id", "status", "text")


@query(f"WITH {STATES} SELECT doc_id, count(*) FILTER (status IN ('translated', 'skipped')) AS done, count(*) FILTER (status = 'error') AS failed, count(*) AS total, (count(*) FILTER (status IN ('translated', 'skipped')) * 100 // count(*))::INT AS percent FROM latest GROUP BY doc_id")
def a8_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks done, failed and in all."""
    return checkpoints.progress_counts(checkpoints.latest(_states(spark, sf_dir), order=("updated_at", "event_id")))


# Every third document was changed since: its chunks have other texts than their states.
_WORK = f"WITH {STATES}, work AS (SELECT u AS doc_id, k::INT AS chunk_idx, 'c' || k || CASE WHEN u % 3 = 0 THEN ' new' ELSE '' END AS original_text FROM (SELECT DISTINCT user_id AS u FROM events), range(9) AS t(k)), done AS (SELECT * FROM latest WHERE status IN ('translated', 'skipped'))"


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    rows = users.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("chunk_idx"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("translated_text"))
    return rows.withColumn("original_text", F.concat(F.lit("c"), F.col("chunk_idx").cast("string"), F.when(F.col("doc_id") % 3 == 0, " new").otherwise("")))


@query(f"{_WORK} SELECT doc_id, chunk_idx FROM work w WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.doc_id = w.doc_id AND d.chunk_idx = w.chunk_idx AND d.text_key = sha256(w.original_text))")
def j1_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks left to do, those whose text has changed among them."""
    return checkpoints.pending(_work(spark, sf_dir), checkpoints.latest(_states(spark, sf_dir), order=("updated_at", "event_id"))).select("doc_id", "chunk_idx")


@query(f"{_WORK} SELECT w.doc_id, w.chunk_idx, coalesce(d.status, 'pending') AS status, d.text AS translated_text FROM work w LEFT JOIN done d ON d.doc_id = w.doc_id AND d.chunk_idx = w.chunk_idx AND d.text_key = sha256(w.original_text)")
def t3_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the texts done before, where they still have the same original."""
    states = checkpoints.latest(_states(spark, sf_dir), order=("updated_at", "event_id"))
    return checkpoints.resume(_work(spark, sf_dir), states).select("doc_id", "chunk_idx", "status", "translated_text")


@query("SELECT 'h' || c_custkey AS sha256, CASE WHEN c_custkey % 4 = 0 THEN 'completed' ELSE 'in_progress' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 'now' ELSE 'then' END AS updated_at FROM customer WHERE c_custkey % 7 > 0")
def k4_complete_and_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests marked as completed, some cleared."""
    c = _read(spark, sf_dir, "customer")
    manifest = c.select("c_custkey", F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("sha256"), F.lit("in_progress").alias("status"), F.lit("then").alias("updated_at"))
    done = checkpoints.mark_completed(manifest, F.col("c_custkey") % 4 == 0, F.lit("now"))
    return checkpoints.clear(done, manifest.where("c_custkey % 7 = 0")).select("sha256", "status", "updated_at")


@query("SELECT 'h' || n_nationkey AS sha256, CASE WHEN n_nationkey < 10 THEN 'old' ELSE 'new' END AS model FROM nation")
def k2_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of documents that have none yet."""
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("sha256"), F.lit("new").alias("model"))
    old = rows.where("n_nationkey < 10").withColumn("model", F.lit("old"))
    return checkpoints.insert_absent(old.drop("n_nationkey"), rows.drop("n_nationkey"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'restart' WHEN c_custkey % 5 > 0 AND c_mktsegment = 'BUILDING' THEN 'continue' WHEN c_custkey % 3 = 0 THEN 'reuse' ELSE 'ask' END AS action FROM customer")
def c10_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with a checkpoint that was made otherwise."""
    k = F.col("c_custkey")
    wish = F.array(F.lit("reuse"), F.lit("ask"), F.lit("restart"))[(k % 3).cast("int")]
    action = checkpoints.conflict_action(F.when(k % 5 > 0, "m"), F.col("c_mktsegment"), F.lit("m"), F.lit("BUILDING"), wish)
    return _read(spark, sf_dir, "customer").select("c_custkey", action.alias("action"))


PAGED = f"WITH {LINES}, paged AS (SELECT doc_id, page, string_agg(content, chr(10) ORDER BY pos) AS text FROM labelled GROUP BY doc_id, page), flagged AS (SELECT doc_id, page, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]')) < 400 AS needs_ocr FROM paged)"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    paged = _lines(spark, sf_dir).groupBy("doc_id", "page").agg(segmentation.all_joined(F.col("pos"), F.col("content"), "\n").alias("text"))
    return segmentation.pages_needing_ocr(paged, 400)


@query(f"{PAGED} SELECT doc_id, page, needs_ocr FROM flagged")
def s7_pages_needing_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose text layer is too thin."""
    return _flagged(spark, sf_dir)


@query(f"{PAGED} SELECT doc_id, needs_ocr, min(page) AS first_page, max(page) AS last_page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) - row_number() OVER (PARTITION BY doc_id, needs_ocr ORDER BY page) AS g FROM flagged) GROUP BY doc_id, needs_ocr, g")
def w3_page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of pages that go to OCR or not."""
    return segmentation.page_runs(_flagged(spark, sf_dir))


@query(f"{PAGED} SELECT doc_id, ((page - 1) // 10)::INT AS \"window\", min(page) AS first_page, max(page) AS last_page, count(DISTINCT page)::INT AS n_pages FROM paged GROUP BY doc_id, (page - 1) // 10")
def w7_page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of ten pages."""
    return segmentation.page_windows(_lines(spark, sf_dir))


def _eta_sql(s: str) -> str:
    t = f"round_even({s}, 0)::BIGINT"
    return f"CASE WHEN {s} IS NULL THEN '' WHEN {s} <= 0 THEN 'concluído' WHEN {t} < 60 THEN '~' || greatest(1, {t}) || ' s' WHEN {t} // 60 < 60 THEN CASE WHEN {t} % 60 > 0 THEN '~' || {t} // 60 || ' min ' || {t} % 60 || ' s' ELSE '~' || {t} // 60 || ' min' END ELSE CASE WHEN {t} % 3600 // 60 > 0 THEN '~' || {t} // 3600 || ' h ' || {t} % 3600 // 60 || ' min' ELSE '~' || {t} // 3600 || ' h' END END"


@query(f"SELECT event_id, user_id, round(average, 6) AS average, {_eta_sql('remaining * round(average, 6)')} AS eta FROM (SELECT *, event_id % 97 AS remaining, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS average FROM events WHERE value > 0)")
def w6_x2_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last ten durations and the time left."""
    rows = progress.moving_average(_read(spark, sf_dir, "events"), "user_id", "event_id", "value").withColumn("average", F.round("average", 6)).withColumn("remaining", F.col("event_id") % 97)
    return progress.remaining(rows).select("event_id", "user_id", "average", "eta")


@query("SELECT event_type, round(seconds, 4) AS seconds, peak, round(seconds / sum(seconds) OVER (), 8) AS share, peak <= 50 AS within FROM (SELECT event_type, sum(value) AS seconds, max(value) AS peak FROM events GROUP BY event_type)")
def a10_stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds, peak and share by stage."""
    out = progress.stage_summary(_read(spark, sf_dir, "events"), "event_type", "value", "value", 50)
    return out.select("event_type", F.round("seconds", 4).alias("seconds"), "peak", F.round("share", 8).alias("share"), "within")


MESSAGES = ["file is ENCRYPTED", "isto não é um PDF", "Data format error", "No space left on device", "Permission denied: x", "Arquivo não encontrado", "ollama: connection refused", "connection refused", "boom", "corrompido com senha"]
TITLES = ["PDF com senha", "Arquivo não é PDF", "PDF corrompido", "Disco cheio", "Sem permissão na pasta de destino", "Arquivo não encontrado", "Serviço de tradução indisponível", "Erro na operação", "Erro na operação", "PDF com senha"]


_quoted = lambda texts: "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"
TOLD = [T.ERROR_ADVICE[t][0] + (m if t == "Erro na operação" else "") for t, m in zip(TITLES, MESSAGES)]


@query(f"SELECT event_id, {_quoted(TITLES)}[event_id % 10 + 1] AS title, {_quoted(TOLD)}[event_id % 10 + 1] AS message, {_quoted([T.ERROR_ADVICE[t][1] for t in TITLES])}[event_id % 10 + 1] AS action FROM events")
def x1_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error messages by class, with what to tell the user and what to do."""
    message = F.array(*map(F.lit, MESSAGES))[(F.col("event_id") % 10).cast("int")]
    return _read(spark, sf_dir, "events").select("event_id", T.error_report(message).alias("r")).select("event_id", "r.*")


@query(
    """SELECT event_id, CASE WHEN s = 'Traduzindo' AND c > 0 THEN d * 100 // c WHEN p > 0 AND n > 0 THEN p * 100 // n WHEN c > 0 THEN d * 100 // c ELSE 0 END::INT AS percent,
    CASE WHEN s = 'Traduzindo' AND c > 0 THEN CASE WHEN p > 0 AND n > 0 THEN printf('Página %d de %d — ', p, n) ELSE '' END || printf('%s (%d%%)', s, d * 100 // c) WHEN p > 0 AND n > 0 THEN printf('Página %d de %d — %s', p, n, s) WHEN c > 0 THEN printf('%s (%d%%)', s, d * 100 // c) ELSE s || '…' END AS label
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Traduzindo' WHEN 1 THEN 'Extraindo' ELSE 'Processando' END AS s, event_id % 4 AS p, event_id % 2 * 9 AS n, event_id % 8 AS d, event_id % 5 * 4 AS c FROM events)"""
)
def x3_progress_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress in percent and words."""
    i = F.col("event_id")
    percent, label = T.progress(F.when(i % 3 == 0, "Traduzindo").when(i % 3 == 1, "Extraindo").otherwise(""), i % 4, i % 2 * 9, i % 8, i % 5 * 4)
    return _read(spark, sf_dir, "events").select("event_id", percent.alias("percent"), label.alias("label"))


@query(
    """SELECT c_custkey, f AS wanted, CASE WHEN f IN ('.MD', ' markdown') THEN 'md' WHEN f = 'PDF' THEN 'pdf' WHEN f = '..epub' THEN 'epub' END AS format, CASE WHEN c_custkey % 3 = 0 THEN 'in/' || c_custkey || '.md' WHEN c_custkey % 3 = 1 THEN 'out/x.MD' ELSE 'out/' || c_custkey || '.md' END AS target,
    '.cache/' || sha256(c_name) || '/output/' || c_name || '.pt-BR.md' AS default_path, CASE f WHEN '.MD' THEN 'extract,segment,assemble' WHEN ' markdown' THEN 'extract,segment,assemble' WHEN 'PDF' THEN 'copy' WHEN '..epub' THEN 'extract,segment,assemble,export_epub' END AS steps
    FROM (SELECT *, ['.MD', ' markdown', 'PDF', '..epub', 'docx'][c_custkey % 5 + 1] AS f FROM customer)"""
)
def p11_k13_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format names, target paths and conversion routes."""
    k = F.col("c_custkey")
    rows = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.array(*map(F.lit, [".MD", " markdown", "PDF", "..epub", "docx"]))[(k % 5).cast("int")].alias("wanted"))
    rows = convert.route(rows, F.lit("pdf"), F.col("wanted"))
    destination = F.when(k % 3 == 1, "out/x.MD").when(k % 3 == 2, "out")
    return rows.select(
        "c_custkey", "wanted", T.format_name(F.col("wanted")).alias("format"), T.target_path(F.lit("in"), k.cast("string"), destination, F.lit(".md")).alias("target"),
        T.default_output_path(F.sha2("c_name", 256), F.col("c_name")).alias("default_path"), F.array_join("steps", ",").alias("steps"),
    )


@query(
    """SELECT page_id, sha256(body) AS sha256, CASE WHEN page_id % 6 = 1 THEN 'extensão' WHEN page_id % 6 = 2 THEN 'arquivo vazio (0 bytes)' WHEN page_id % 6 = 3 THEN 'cabeçalho PDF não encontrado' END AS problem, page_id % 6 <> 4 AS needs_parsing
    FROM (SELECT page_id, CASE page_id % 6 WHEN 2 THEN '' WHEN 3 THEN html WHEN 4 THEN '%PDF-1.4' ELSE '%PDF-1.7 ' || html END AS body FROM pages)"""
)
def s8_s17_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of binary files before parsing, and their hashes."""
    k = F.col("page_id") % 6
    body = F.when(k == 2, "").when(k == 3, F.col("html")).when(k == 4, "%PDF-1.4").otherwise(F.concat(F.lit("%PDF-1.7 "), "html"))
    rows = _read(spark, sf_dir, "pages").select("page_id", k.alias("k"), F.encode(body, "utf-8").alias("content"))
    name = F.when(F.col("k") == 1, "a.txt").otherwise("a.PDF")
    return rows.select("page_id", F.sha2("content", 256).alias("sha256"), files.pdf_problem(name, F.col("content")).alias("problem"), files.needs_parsing(F.col("content")).alias("needs_parsing"))


@query("SELECT 'h' || c_custkey AS sha256, c_name AS source_name, (c_custkey % 50)::INT AS total_pages, 2::BIGINT AS chunks, CASE WHEN c_custkey % 3 = 0 THEN 'translated' ELSE 'error' END AS first_status FROM customer WHERE c_custkey % 3 < 2")
def s12_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests with chunks as a map or a list; damaged ones give none."""
    k = F.col("c_custkey")
    record = lambda i, s: F.format_string(f'{{"id":"chunk-{i}","index":{i},"status":"%s"}}', F.lit(s))
    as_map = F.concat(F.lit('{"chunk-0":'), record(0, "translated"), F.lit(',"chunk-1":'), record(1, "pending"), F.lit("}"))
    as_list = F.concat(F.lit("["), record(0, "error"), F.lit(","), record(1, "pending"), F.lit("]"))
    text = F.concat(F.format_string('{"sha256":"h%d","source_name":"%s","total_pages":%d,"chunks":', k, "c_name", k % 50), F.when(k % 3 == 0, as_map).otherwise(as_list), F.lit("}"))
    rows = _read(spark, sf_dir, "customer").select(F.when(k % 3 == 2, "{broken").otherwise(text).alias("json"))
    return checkpoints.parse_manifests(rows).select("sha256", "source_name", "total_pages", F.size("chunks").cast("long").alias("chunks"), F.try_element_at("chunks", F.lit("chunk-0"))["status"].alias("first_status"))


@query("SELECT s_suppkey, wanted, offered, wanted = offered OR string_split(wanted, ':')[1] = string_split(offered, ':')[1] AS same FROM (SELECT s_suppkey, 'm' || s_suppkey % 3 || ':' || s_suppkey % 2 AS wanted, 'm' || s_suppkey % 4 || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE ':latest' END AS offered FROM supplier)")
def c12_model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that are the same but for the tag."""
    k = F.col("s_suppkey")
    text = lambda x: x.cast("string")
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("m"), text(k % 3), F.lit(":"), text(k % 2)).alias("wanted"), F.concat(F.lit("m"), text(k % 4), F.when(k % 5 == 0, "").otherwise(":latest")).alias("offered"))
    return rows.select("*", files.same_model(F.col("wanted"), F.col("offered")).alias("same"))


@query("SELECT count(*) FILTER (contains(lower(props), 'cuda') OR contains(lower(props), '\"k\": 7')) > 0 AS gpu FROM events")
def s16_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a log has one of some marks."""
    return files.log_shows_gpu(_read(spark, sf_dir, "events").select(F.col("props").alias("value")), ("cuda", '"k": 7'))


@query("SELECT page::INT AS page, (row_number() OVER (PARTITION BY page ORDER BY o) - 1)::INT AS at, type, type || ' ' || page || '.' || (row_number() OVER (PARTITION BY page ORDER BY o) - 1) AS content FROM range(1, 1001) AS p(page), (VALUES (0, 'heading'), (1, 'paragraph'), (2, 'paragraph'), (3, 'table'), (4, 'image')) AS t(o, type) WHERE o < 3 OR (o = 3 AND page % 2 = 0) OR (o = 4 AND page % 5 = 0)")
def s18_synthetic_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a generated book of 1000 pages."""
    return files.synthetic_pages(spark, 1000)


@query(f"{CHUNKS} SELECT doc_id, chunk_idx, CASE WHEN status = 'skipped' THEN 'skipped' ELSE 'translated' END AS status, md5(original_text) AS text_md5, CASE WHEN status = 'skipped' THEN 0 ELSE 1 END::INT AS attempts FROM chunks")
def l6_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks through the translator with a generator that echoes the text."""
    out = R.translate(_chunks(spark, sf_dir), R.EchoGenerator, G.Glossary())
    return out.select("doc_id", "chunk_idx", "status", F.md5("translated_text").alias("text_md5"), F.col("attempts").cast("int").alias("attempts"))


class ContextGenerator:
    """A stand-in that answers with the text and marks the context it was given."""

    def generate(self, prompt: str, system: str, temperature: float) -> str:
        text = R.EchoGenerator().generate(prompt, system, temperature)
        if R.CONTEXT_HEAD not in prompt:
            return text
        before = prompt.split('Original:\n"""\n', 1)[1].split('\n"""\n\nTranslated (', 1)[0]
        return f"{text} {hashlib.md5(before.encode()).hexdigest()[:4]}"


@query(
    f"""{CHUNKS}, told AS (SELECT *, last_value(CASE WHEN status = 'pending' THEN trim(original_text, ' ' || chr(10)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM chunks)
    SELECT doc_id, chunk_idx, CASE status WHEN 'pending' THEN 'translated' ELSE status END AS status, md5(original_text || CASE WHEN status = 'pending' AND before IS NOT NULL THEN ' ' || left(md5(CASE WHEN length(before) > 400 THEN '...' || right(before, 400) ELSE before END), 4) ELSE '' END) AS text_md5
    FROM told WHERE NOT (status = 'pending' AND chunk_idx % 3 = 0)"""
)
def l6_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interrupted documents taken up again: the chunks done before are not sent, and are the context of those after them."""
    done = (F.col("status") == "pending") & (F.col("chunk_idx") % 3 == 0)
    chunks = _chunks(spark, sf_dir).withColumn("done_before", done)
    chunks = chunks.withColumns({"translated_text": F.when(done, F.concat(F.lit("T "), "original_text")), "status": F.when(done, "translated").otherwise(F.col("status"))})
    out = R.translate(chunks, ContextGenerator, G.Glossary())
    return out.select("doc_id", "chunk_idx", "status", F.md5("translated_text").alias("text_md5"))


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, markdown) of documents, without lines of code."""
    rows, content = _lines(spark, sf_dir).where("type <> 'code'"), T.strip(F.col("content"))
    shown = F.when(F.col("type") == "heading", F.concat(F.lit("# "), content)).when(F.col("type") == "list_item", F.concat(F.lit("- "), content)).otherwise(content)
    return rows.groupBy("doc_id").agg(F.concat(segmentation.ordered_join(F.col("pos"), shown), F.lit("\n")).alias("markdown"))


ASSEMBLED = f"WITH {LINES}, assembled AS (SELECT doc_id, string_agg(CASE type WHEN 'heading' THEN '# ' || trim(content) WHEN 'list_item' THEN '- ' || trim(content) ELSE trim(content) END, chr(10) || chr(10) ORDER BY pos) || chr(10) AS markdown FROM blocks WHERE type <> 'code' GROUP BY doc_id)"


@query(f"{ASSEMBLED} SELECT doc_id, md5(markdown) AS markdown_md5, true AS valid, NULL::VARCHAR AS error FROM assembled")
def k10_k11_s14_epub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to EPUB and back along the conversion routes, their EPUBs checked."""
    files = _assembled(spark, sf_dir).select("doc_id", F.encode("markdown", "utf-8").alias("content"))
    there = export.run_steps(files.withColumn("steps", F.array(F.lit("export_epub")))).drop("steps")
    back = export.run_steps(export.checked(there).withColumn("steps", F.array(F.lit("read_epub"))))
    return back.select("doc_id", F.md5(F.decode("content", "utf-8")).alias("markdown_md5"), "valid", "error")


@query(f"{ASSEMBLED} SELECT 'd' || doc_id || '.md' AS name, strlen(markdown)::BIGINT AS bytes FROM assembled")
def k9_markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as Markdown files of a shared folder, whole or not at all; the files' names and bytes."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "/tmp/checkpoints/folioflow"
    folder = f"{urlparse(base).path}/{spark.sparkContext.applicationId}/markdown"
    documents = _assembled(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "markdown")
    return export.export_documents(documents, export.MarkdownExporter, folder)


@query(f"{ASSEMBLED} SELECT doc_id, '%PDF-1.4' AS head, '%%EOF' AS tail FROM assembled")
def k12_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDFs: their first and last bytes."""
    files = _assembled(spark, sf_dir).select("doc_id", F.encode("markdown", "utf-8").alias("content"), F.array(F.lit("export_pdf")).alias("steps"))
    out = export.run_steps(files)
    return out.select("doc_id", F.decode(F.substring("content", 1, 8), "utf-8").alias("head"), F.decode(F.substring("content", -6, 5), "utf-8").alias("tail"))
