"""Scalar text expressions: counting, normal forms, Markdown, names, messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: Block types that are kept as they are.
FIXED_TYPES = ("code", "table", "image", "formula")
#: Types whose text may hold hyphenated line ends.
PROSE_TYPES = ("paragraph", "heading", "list_item", "footnote")

# Layout labels and the block types they stand for.
LABEL_TYPES = {
    "title": "heading",
    "section_header": "heading",
    "text": "paragraph",
    "paragraph": "paragraph",
    "caption": "paragraph",
    "list_item": "list_item",
    "code": "code",
    "table": "table",
    "picture": "image",
    "footnote": "footnote",
    "formula": "formula",
}


def strip(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, rf"(?U)\A{P.SPACE}+|{P.SPACE}+\z", "")


def count_words(text: Column) -> Column:
    """Runs without white space."""
    return F.when(strip(text) == "", 0).otherwise(F.size(F.split(strip(text), rf"(?U){P.SPACE}+"))).cast("int")


def count_alnum(text: Column) -> Column:
    """Letters and digits."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")).cast("int")


def estimate_tokens(text: Column) -> Column:
    """1.3 tokens a word, rounded down; at least 1 if there is a word."""
    return F.floor(count_words(text) * 13 / 10).cast("int")


def dehyphenate(text: Column) -> Column:
    """Words cut at a line end put together, in a single pass."""
    return F.regexp_replace(text, P.java(P.HYPHENATED, "(?U)"), "$1$2")


def running_form(text: Column) -> Column:
    """The normal form in which running headers and footers repeat: lower case, digits as #."""
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\d+", "#")


def is_page_number(text: Column) -> Column:
    trimmed = strip(text)
    return (trimmed != "") & reduce(Column.__or__, [trimmed.rlike(P.java(p, "(?iuUd)")) for p in P.PAGE_NUMBERS])


def is_exempt_heading(text: Column) -> Column:
    return strip(text).rlike(P.java(P.HEADING_EXEMPT, "(?iuUd)"))


def block_type(label: Column) -> Column:
    """Block type of a layout label; unknown for others."""
    known = F.create_map(*[F.lit(x) for pair in LABEL_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(label, F.lit(""))), F.lit("unknown"))


def is_translatable(kind: Column) -> Column:
    return ~kind.isin(*FIXED_TYPES)


def heading_level(explicit: Column, label: Column) -> Column:
    """The given level within 1 to 6, else 1 for titles, 2 for section headers, 1 otherwise."""
    return F.when(explicit.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(6), explicit))).when(label == "section_header", 2).otherwise(1).cast("int")


def image_alt(caption: Column, text: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(caption, F.lit("")), F.nullif(text, F.lit("")), F.concat(F.lit("image_"), index.cast("string")))


def image_name(stem: Column, index: Column) -> Column:
    return F.format_string("img_%s_%03d.png", stem, index)


def tail(text: Column, most: int = 400) -> Column:
    """The last characters, marked with dots if any were cut."""
    trimmed = strip(text)
    return F.when(F.length(trimmed) > most, F.concat(F.lit("..."), F.right(trimmed, F.lit(most)))).otherwise(trimmed)


def _fenced(language: Column, content: Column) -> Column:
    return F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), content, F.lit("\n```"))


def _image(alt: Column, source: Column) -> Column:
    return F.concat(F.lit("!["), F.coalesce(alt, F.lit("image")), F.lit("]("), F.coalesce(source, F.lit("")), F.lit(")"))


def _heading(level: Column, default: int, content: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(default))))), F.lit(" "), content)


def semantic_markdown(kind: Column, content: Column, block_id: Column, level: Column, language: Column, alt: Column) -> Column:
    """Markdown of a block, by type."""
    item = strip(content)
    return (
        F.when(kind == "heading", _heading(level, 1, content))
        .when(kind == "list_item", F.when(item.rlike(r"(?U)\A(\*|-|\+|\d+\.)\s+"), item).otherwise(F.concat(F.lit("- "), item)))
        .when(kind == "code", _fenced(language, content))
        .when(kind == "image", _image(alt, content))
        .when(kind == "formula", F.concat(F.lit("$$\n"), content, F.lit("\n$$")))
        .when(kind == "footnote", F.concat(F.lit("[^"), block_id, F.lit("]: "), content))
        .otherwise(content)
    )


def naive_markdown(kind: Column, content: Column, level: Column, language: Column, alt: Column) -> Column:
    """The plain variant: headings default to level 2, every list item gets a dash."""
    return (
        F.when(kind == "heading", _heading(level, 2, content))
        .when(kind == "list_item", F.concat(F.lit("- "), content))
        .when(kind == "code", _fenced(language, content))
        .when(kind == "image", _image(alt, content))
        .otherwise(content)
    )


def assembly_markdown(kind: Column, content: Column, language: Column, alt: Column, html: Column, is_complex: Column) -> Column:
    """Markdown of a kept block in the output: merged-cell tables as HTML, wrappers added once."""
    trimmed, table = strip(content), F.coalesce(html, F.lit(""))
    merged = (table != "") & (table.contains("colspan") | table.contains("rowspan") | F.coalesce(is_complex, F.lit(False)))
    return (
        F.when(kind == "table", F.when(merged, html).otherwise(trimmed))
        .when(kind == "image", F.when(trimmed.startswith("![") & trimmed.contains("]("), trimmed).otherwise(_image(alt, trimmed)))
        .when(kind == "code", F.when(trimmed.startswith("```"), trimmed).otherwise(_fenced(language, trimmed)))
        .when(kind == "formula", F.when(trimmed.startswith("$$"), trimmed).otherwise(F.concat(F.lit("$$\n"), trimmed, F.lit("\n$$"))))
        .otherwise(trimmed)
    )


def format_name(given: Column) -> Column:
    """pdf, md or epub from a name or suffix; null if it is none of them."""
    name = F.regexp_replace(strip(F.lower(given)), r"^\.+", "")
    return F.when(name.isin("md", "markdown"), "md").when(name.isin("pdf", "epub"), name)


def target_path(source_dir: Column, stem: Column, destination: Column, suffix: Column) -> Column:
    """The destination if it has the suffix, else a file of the source's stem in it or beside the source."""
    name = F.concat(stem, suffix)
    return F.when(destination.isNull(), F.concat_ws("/", source_dir, name)).when(F.lower(destination).endswith(F.lower(suffix)), destination).otherwise(F.concat_ws("/", destination, name))


def default_output_path(sha: Column, stem: Column) -> Column:
    return F.concat_ws("/", F.lit(".cache"), sha, F.lit("output"), F.concat(stem, F.lit(".pt-BR.md")))


def markdown_title(text: Column, default: str = "Documento") -> Column:
    """Title from front matter, else the first heading of level 1, else of level 2."""
    found = [
        F.regexp_extract(text, r"(?sU)\A---\s*\n.*?title:\s*[\"']?([^\"'\n]+)[\"']?.*?\n---", 1),
        F.regexp_extract(text, r"(?mUd)^#\s+([^\n#]+)", 1),
        F.regexp_extract(text, r"(?mUd)^##\s+([^\n#]+)", 1),
    ]
    return F.coalesce(*[F.when(x != "", strip(x)) for x in found], F.lit(default))


def eta(seconds: Column) -> Column:
    """Remaining time as people read it."""
    total = F.bround(seconds).cast("long")
    minutes, rest = F.floor(total / 60), total % 60
    hours, rest_minutes = F.floor(total / 3600), F.floor(total % 3600 / 60)

    def put(template: str, *parts: Column) -> Column:
        return F.format_string(template, *[p.cast("long") for p in parts])

    return (
        F.when(seconds.isNull(), "")
        .when(seconds <= 0, "concluído")
        .when(total < 60, put("~%d s", F.greatest(F.lit(1), total)))
        .when(minutes < 60, F.when(rest > 0, put("~%d min %d s", minutes, rest)).otherwise(put("~%d min", minutes)))
        .otherwise(F.when(rest_minutes > 0, put("~%d h %d min", hours, rest_minutes)).otherwise(put("~%d h", hours)))
    )


def progress(stage: Column, page: Column, pages: Column, done: Column, chunks: Column) -> tuple[Column, Column]:
    """(percent, label) of a running job."""
    name = F.when(F.coalesce(stage, F.lit("")) == "", "Processando").otherwise(stage)
    paged = (pages > 0) & (page > 0)
    where = F.format_string("Página %d de %d", page, pages)
    by_chunk, by_page = F.floor(done * 100 / chunks).cast("int"), F.floor(page * 100 / pages).cast("int")
    translating = (name == "Traduzindo") & (chunks > 0)
    percent = F.when(translating, by_chunk).when(paged, by_page).when(chunks > 0, by_chunk).otherwise(0)
    counted = F.format_string("%s (%d%%)", name, by_chunk)
    label = (
        F.when(translating & paged, F.concat(where, F.lit(" — "), counted))
        .when(translating, counted)
        .when(paged, F.concat(where, F.lit(" — "), name))
        .when(chunks > 0, counted)
        .otherwise(F.concat(name, F.lit("…")))
    )
    return percent.cast("int"), label


# Marks of each error class in a message, in order, with its title.
ERROR_CLASSES = [
    ("PDF com senha", ["password", "senha", "encrypted", "fpdf_err_password"]),
    ("Arquivo não é PDF", ["não é um documento pdf", "não é um pdf", "not a pdf", "extensão .pdf"]),
    ("PDF corrompido", ["data format error", "corrupt", "corrompido", "cabeçalho pdf não encontrado", "header not found", "vazio (0 bytes)", "fpdf_err_format", "syntax error"]),
    ("Disco cheio", ["no space left on device", "disk full", "out of disk space", "espaço insuficiente", "disco cheio"]),
    ("Sem permissão na pasta de destino", ["permission denied", "permissão negada"]),
    ("Arquivo não encontrado", ["não encontrado"]),
]
SERVICE_DOWN = ["não está em execução", "connection refused", "failed to connect", "cannot connect"]


# Message and advice by class of error.
ERROR_ADVICE = {
    "PDF com senha": ("O arquivo PDF está protegido por senha e não pode ser lido.", "Remova a proteção por senha do PDF antes de tentar traduzi-lo."),
    "Arquivo não é PDF": ("O arquivo selecionado não é um documento PDF válido.", "Selecione um arquivo com extensão .pdf (ou use 'Converter arquivo…' no menu para outros formatos)."),
    "PDF corrompido": ("O arquivo PDF está corrompido, incompleto ou com formato inválido.", "Verifique a integridade do arquivo ou gere/baixe o documento novamente."),
    "Disco cheio": ("Espaço insuficiente em disco para concluir a operação.", "Libere espaço na partição do sistema e tente novamente."),
    "Sem permissão na pasta de destino": ("Permissão negada para acessar ou gravar arquivos na pasta de destino.", "Escolha outra pasta com permissão de escrita ou ajuste as permissões de acesso do diretório."),
    "Arquivo não encontrado": ("O arquivo selecionado não foi encontrado.", "Verifique se o arquivo ainda existe no caminho indicado e tente novamente."),
    "Serviço de tradução indisponível": ("O serviço de tradução local (Ollama) não está em execução.", "Execute `./scripts/run.sh` no terminal para iniciar o serviço."),
    "Erro na operação": ("Ocorreu um erro durante o processamento: ", "Consulte os logs em `logs/app.log` para obter mais detalhes sobre o erro."),
}


def error_title(message: Column, service: str = "ollama") -> Column:
    """The class of an error message: the first whose marks it has."""
    low = F.lower(message)

    def has(marks: list[str]) -> Column:
        return reduce(Column.__or__, [low.contains(m) for m in marks])

    out = F
    for title, marks in ERROR_CLASSES:
        out = out.when(has(marks), title)
    return out.when(low.contains(service) & has(SERVICE_DOWN), "Serviço de tradução indisponível").otherwise("Erro na operação")


def error_report(message: Column, service: str = "ollama") -> Column:
    """struct<title, message, action> for the user; an error of no known class is quoted."""
    title = error_title(message, service)
    told, advice = (F.create_map(*[F.lit(x) for k, v in ERROR_ADVICE.items() for x in (k, v[i])])[title] for i in range(2))
    return F.struct(title.alias("title"), F.when(title == "Erro na operação", F.concat(told, message)).otherwise(told).alias("message"), advice.alias("action"))


def strip_code_fence(text: Column) -> Column:
    """The inside of a fence around the whole text."""
    t = strip(text)
    closed = t.endswith("\n```")

    def inside(opening: str) -> Column:
        return strip(F.substring(t, F.lit(len(opening) + 1), F.length(t) - len(opening) - 4))

    fences = F.regexp_count(t, F.lit("```"))
    return (
        F.when(closed & t.startswith("```markdown\n"), inside("```markdown\n"))
        .when(closed & t.startswith("```md\n"), inside("```md\n"))
        .when(closed & t.startswith("```\n") & (fences == 2), inside("```\n"))
        .otherwise(t)
    )


# Headings of the prompt that an answer may repeat.
ECHO_START = r"(?iuUd)\A[#\s]*(?:Glossary|Glossário|Previous Context|Contexto Anterior|Correction Required)[^\n]*\n"
ECHO_TEXT = r"[#\s]*(?:Text to Translate|Texto a Traduzir|Texto para Traduzir)[^\n]*\n+"


def strip_echo(text: Column) -> Column:
    """Off with the prompt's own headings at the start; in one pass without nested repetition, which long texts can't overflow."""
    plain = rf"(?iuUd)\A{ECHO_TEXT}"
    after = ECHO_START + rf"(?s:.*?)(?<=\n){ECHO_TEXT}"
    return strip(F.when(text.rlike(after), F.regexp_replace(text, after, "")).otherwise(F.regexp_replace(text, plain, "")))
