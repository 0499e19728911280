"""Prompts and the retry loop around a text generator.

The generator is an adapter: any ``generate(prompt, system, temperature)``.
Chunks of one document depend on each other through the context of the chunk
before, so a document is one sequence; documents run in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import glossary as G
from ..functions import text as T
from ..functions.validation import demote_headings
from .assembly import UNTRANSLATED

PROMPT_VERSION = "1.0.0"
RETRY_STEP = 0.2
MAX_TEMPERATURE = 0.8

# The wording of the system prompt and of the prompt's sections.
SYSTEM_PROMPT = """You are a professional technical translator specializing in translating technical documents into Brazilian Portuguese ({target_language}).

Strict rules:
1. Translate the provided text accurately and fluently into {target_language}.
2. Preserve all Markdown structure, syntax, and formatting exactly (headings #, bullet/numbered lists, emphasis, links, table structure).
3. Do NOT translate or modify placeholders (e.g. __PH_0__, __PH_1__, §§...§§). Keep all placeholder tokens exactly as they are in the translated text.
4. Adhere strictly to the provided glossary rules:
   - Terms under "Do not translate" MUST be kept verbatim in their original form.
   - Terms under "Translate as" MUST use the exact specified translation.
5. Do NOT add any comments, notes, conversational text, pleasantries, or markdown wrappers like ```markdown ... ``` around your entire answer.
6. Translate ONLY the document content under "### Text to Translate to {target_language}:". Never repeat, translate, or include prompt section headers such as "### Glossary Rules" or "### Text to Translate" in your output.
7. Output ONLY the translated Markdown text."""
CONTEXT_HEAD = "### Previous Context (for continuity and style only; do NOT re-translate):"
GLOSSARY_HEAD = "### Glossary Rules:"
KEEP_HEAD = "Do not translate (preserve verbatim):"
FIXED_HEAD = "Translate as specified:"
RETRY_HEAD = "### Correction Required (your previous translation was rejected):"
RETRY_TAIL = "Keep exactly the same Markdown structure as the source text: the same headings (lines starting with #) and the same list items. Do not turn plain lines into headings and do not add or remove list items."
TEXT_HEAD = "### Text to Translate to {target_language}:"


def system_prompt(language: str = "pt-BR") -> str:
    return SYSTEM_PROMPT.replace("{target_language}", language)


def prompt_column(text: Column, language: str, preserve: Column, translate: Column, previous_original: Column, previous_translation: Column, feedback: Column) -> Column:
    """The prompt from its parts: arrays preserve, translate (src, dst) and feedback, and the chunk before; absent parts are left out."""

    def quoted(head: str, context: Column) -> Column:
        return F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(head + '\n"""\n'), T.tail(context), F.lit('\n"""')))

    before = F.array_compact(F.array(quoted("Original:", previous_original), quoted(f"Translated ({language}):", previous_translation)))
    context = F.when(F.size(before) > 0, F.array_join(F.concat(F.array(F.lit(CONTEXT_HEAD)), before), "\n\n"))

    def listed(head: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(head)), lines)).otherwise(F.array().cast("array<string>"))

    kept = listed(KEEP_HEAD, F.transform(preserve, lambda t: F.concat(F.lit("- "), t)))
    fixed = listed(FIXED_HEAD, F.transform(translate, lambda t: F.concat(F.lit('- "'), t["src"], F.lit('" -> "'), t["dst"], F.lit('"'))))
    terms = F.concat(kept, fixed)
    rules = F.when(F.size(terms) > 0, F.concat(F.lit(GLOSSARY_HEAD + "\n"), F.array_join(terms, "\n")))
    retry = F.when(F.size(feedback) > 0, F.array_join(F.concat(F.array(F.lit(RETRY_HEAD)), F.transform(feedback, lambda r: F.concat(F.lit("- "), r)), F.array(F.lit(RETRY_TAIL))), "\n"))
    main = F.concat(F.lit(TEXT_HEAD.replace("{target_language}", language) + "\n"), text)
    return F.array_join(F.array_compact(F.array(context, rules, retry, main)), "\n\n")


def with_context(chunks: DataFrame) -> DataFrame:
    """Add previous (original, translated): the document's last translated chunk before each one, over finished chunks."""
    before = Window.partitionBy("doc_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    done = F.when(F.col("status") == "translated", F.struct(F.col("original_text").alias("original"), F.col("translated_text").alias("translated")))
    return chunks.withColumn("previous", F.last(done, ignorenulls=True).over(before))


class Generator(Protocol):
    """A text generator, such as a client of a language model's service."""

    def generate(self, prompt: str, system: str, temperature: float) -> str: ...


class EchoGenerator:
    """A deterministic stand-in that answers with the text to translate."""

    def generate(self, prompt: str, system: str, temperature: float) -> str:
        return prompt.split("### Text to Translate to ", 1)[-1].split(":\n", 1)[-1]


def attempt_temperature(base: float, attempt: int) -> float:
    return base if attempt == 1 else max(base, min(base + RETRY_STEP * (attempt - 1), MAX_TEMPERATURE))


class Translator:
    """One document's chunks in sequence: protect, ask, check, correct, with feedback on rejected answers."""

    def __init__(self, generator: Generator, glossary: G.Glossary, language: str = "pt-BR", retries: int = 3, temperature: float = 0.2):
        self.generator, self.glossary, self.language = generator, glossary, language
        self.retries, self.temperature = retries, temperature
        self.before: tuple[str, str] | None = None

    def chunk(self, text: str, status: str) -> tuple[str, str, str | None, int]:
        """(translated text, status, error, attempts)."""
        from . import local as L

        if not text.strip():
            return "", "translated", None, 0
        if status == "skipped":
            return text, "skipped", None, 0
        protected, found = L.protect(text)
        kept, fixed = L.applicable(text, self.glossary)
        feedback, error = [], None
        for attempt in range(1, self.retries + 1):
            prompt = L.prompt(protected, self.language, kept, fixed, self.before, feedback)
            try:
                answer = L.strip_answer(self.generator.generate(prompt, system_prompt(self.language), attempt_temperature(self.temperature, attempt)))
            except Exception as e:  # the adapter's own errors are results here: they end as the chunk's error
                error = str(e)
                continue
            reasons = L.reasons(answer, protected, found)
            if reasons:
                error, feedback = "Validation failed: " + "; ".join(reasons), reasons
                continue
            out = L.correct(L.restore(demote_headings(answer, protected), found), text, self.glossary)
            self.before = (text, out)
            return out, "translated", None, attempt
        return f"{UNTRANSLATED}\n\n{text}", "error", error or f"Translation failed after {self.retries} attempts", self.retries


def translate(chunks: DataFrame, generator: Callable[[], Generator], glossary: G.Glossary, language: str = "pt-BR", retries: int = 3, temperature: float = 0.2) -> DataFrame:
    """Translate chunks (doc_id, chunk_idx, original_text, status) document by document; one generator per group of rows.

    Where chunks have the columns done_before and translated_text, those done
    before give no row: their texts are the context of the chunks after them, as
    they would have been in a run without a break. text_key is the hash of the
    original text. Persist the result before using it twice: a generator may answer otherwise the next time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = generator()
        translator, document = None, object()
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                if r.doc_id != document:
                    translator, document = Translator(client, glossary, language, retries, temperature), r.doc_id
                if r.done_before:
                    if r.status == "translated" and r.translated_text:
                        translator.before = (r.original_text, r.translated_text)
                    continue
                rows.append((r.doc_id, r.chunk_idx, *translator.chunk(r.original_text, r.status), hashlib.sha256(r.original_text.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "translated_text", "status", "error_message", "attempts", "text_key"])

    kind = chunks.schema["doc_id"].dataType.simpleString()
    before = ["translated_text", "done_before"] if "done_before" in chunks.columns else [F.lit(None).cast("string").alias("translated_text"), F.lit(False).alias("done_before")]
    ordered = chunks.select("doc_id", "chunk_idx", "original_text", "status", *before).repartition("doc_id").sortWithinPartitions("doc_id", "chunk_idx")
    return ordered.mapInPandas(run, f"doc_id {kind}, chunk_idx int, translated_text string, status string, error_message string, attempts int, text_key string")
