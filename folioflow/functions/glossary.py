"""Glossary: which terms a text has, correcting a translation by them, and violations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Wrong renderings of terms to keep, in order, with what they become.
MISTRANSLATIONS: dict[str, dict[str, str]] = {
    "bug": {"insetos": "bugs", "inseto": "bug", "defeitos": "bugs", "defeito": "bug"},
    "pipeline": {
        "esteiras de integração": "pipelines",
        "esteira de integração": "pipeline",
        "esteiras de entrega": "pipelines",
        "esteira de entrega": "pipeline",
        "esteiras": "pipelines",
        "esteira": "pipeline",
        "encanamentos": "pipelines",
        "encanamento": "pipeline",
        "dutos": "pipelines",
        "duto": "pipeline",
        "canalizações": "pipelines",
        "canalização": "pipeline",
    },
    "deploy": {"implantações": "deploys", "implantação": "deploy", "desdobramentos": "deploys", "desdobramento": "deploy"},
    "commit": {"confirmações": "commits", "confirmação": "commit", "submissões": "commits", "submissão": "commit"},
    "framework": {
        "arcabouços": "frameworks",
        "arcabouço": "framework",
        "quadros de trabalho": "frameworks",
        "quadro de trabalho": "framework",
        "estruturas de software": "frameworks",
        "estrutura de software": "framework",
    },
}
# Other renderings of fixed translations.
VARIANTS: dict[str, list[str]] = {"aprendizado de máquina": ["aprendizagem de máquina", "aprendizado automático", "aprendizagem automática"]}
THREAD_VARIANTS = r"(?iuU)\b(fios? de execução|linhas? de execução)\b"


@dataclass(frozen=True)
class Glossary:
    """Terms to keep as they are, and fixed translations, both in order."""

    preserve: Sequence[str] = ()
    translate: dict[str, str] = field(default_factory=dict)


def quote(term: str) -> str:
    """A literal as a regular expression."""
    return "".join(c if c.isalnum() or c in "_ " else "\\" + c for c in term)


def term_pattern(term: str, plural: bool = True) -> str:
    """Java pattern of a term as a word of its own, with an optional plural for plain words."""
    word = lambda c: c.isalnum() or c == "_"
    before = r"\b" if term and word(term[0]) else r"(?:\B|^)"
    after = r"\b" if term and word(term[-1]) else r"(?:\B|$)"
    return rf"(?iuU){before}{quote(term)}{'(?:s|es)?' if plural and term.isalnum() else ''}{after}"


def has_term(text: Column, term: str) -> Column:
    return text.rlike(term_pattern(term))


def glossary_table(spark: SparkSession, glossary: Glossary) -> DataFrame:
    """(ord, kind, src, dst, pattern_src, pattern_dst), one row per term: small and made on the driver."""
    rows = [(i, "preserve", t, None, term_pattern(t), term_pattern(t)) for i, t in enumerate(glossary.preserve)]
    rows += [(len(rows) + i, "translate", s, d, term_pattern(s), term_pattern(d)) for i, (s, d) in enumerate(glossary.translate.items())]
    return spark.createDataFrame(rows, "ord int, kind string, src string, dst string, pattern_src string, pattern_dst string")


def applicable_terms(chunks: DataFrame, glossary: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """One row per chunk with the arrays preserve and translate (src, dst) of the terms its text has, in glossary order.

    The glossary is a configuration file of some hundred terms at most, so it
    is broadcast; the terms of a chunk are gathered in a single aggregation.
    """
    hits = chunks.select(*keys, text_col).join(F.broadcast(glossary), F.rlike(F.col(text_col), F.col("pattern_src")), "left")
    terms = F.array_sort(F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("ord", "kind", "src", "dst"))))
    found = hits.groupBy(*keys).agg(terms.alias("_terms"))
    kept = F.transform(F.filter("_terms", lambda t: t.kind == "preserve"), lambda t: t.src)
    fixed = F.transform(F.filter("_terms", lambda t: t.kind == "translate"), lambda t: F.struct(t.src.alias("src"), t.dst.alias("dst")))
    return found.select(*keys, kept.alias("preserve"), fixed.alias("translate"))


def correct(translation: Column, original: Column, glossary: Glossary) -> Column:
    """Ordered corrections, each seeing what the one before left: fixed translations first, then terms to keep."""

    def replaced(text: Column, pattern: str, by: str) -> Column:
        return F.regexp_replace(text, pattern, by.replace("\\", "\\\\").replace("$", "\\$"))

    out = translation
    for src, dst in glossary.translate.items():
        if src.strip().lower() == dst.strip().lower():
            if src.lower() == "thread":
                out = F.when(has_term(original, src) & ~has_term(out, src), F.regexp_replace(out, THREAD_VARIANTS, "thread")).otherwise(out)
            continue
        fixed = out
        for variant in VARIANTS.get(dst.lower(), []):
            fixed = replaced(fixed, rf"(?iuU)\b{quote(variant)}\b", dst)
        word = rf"(?iuU)\b{quote(src)}\b"
        fixed = F.when(fixed.rlike(word) & ~has_term(fixed, dst), replaced(fixed, word, dst)).otherwise(fixed)
        out = F.when(has_term(original, src), fixed).otherwise(out)
    for term in glossary.preserve:
        fixed = out
        for wrong, right in MISTRANSLATIONS.get(term.lower(), {}).items():
            fixed = replaced(fixed, rf"(?iuU)\b{quote(wrong)}\b", right)
        out = F.when(has_term(original, term) & ~has_term(out, term), fixed).otherwise(out)
    return out


def violations(translation: Column, original: Column, glossary: Glossary) -> Column:
    """Messages of terms that the original has and the translation lacks."""
    kept = [F.when(has_term(original, t) & ~has_term(translation, t), F.lit(f"Preserved term '{t}' is missing from translation.")) for t in glossary.preserve]
    fixed = [F.when(has_term(original, s) & ~has_term(translation, d), F.lit(f"Translation target '{d}' for source '{s}' is missing from translation.")) for s, d in glossary.translate.items()]
    return F.array_compact(F.array(*kept, *fixed)) if kept or fixed else F.array().cast("array<string>")
