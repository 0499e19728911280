"""Checks of a generated text against its original, with reasons."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P
from .text import strip


# The wording of the reasons, here and in validate().
COUNT_REASON = "Quantidade de {label} diverge: original tem %d, tradução tem %d"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(P.java(pattern, "(?mUd)"))).cast("int")


def _list(items: Column) -> Column:
    """Strings as a list in square brackets."""
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def _two_places(number: Column) -> Column:
    """A number with two decimals: its exact binary value is rounded, ties to the even digit, as C and Python do; format_string rounds the shortest decimal form half up."""
    return F.call_function("format_number", number, F.lit("0.00"))


def _brackets(items: Column) -> Column:
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(_list(items))


def chat_phrase(text: Column) -> Column:
    """The first phrase of a conversation in a text, null if it has none."""
    found = []
    for pattern in P.CHAT:
        hit = F.regexp_extract(text, P.java(pattern), 0)
        found.append(F.when(text.rlike(P.java(pattern)), strip(hit)))
    return F.coalesce(*found)


def _counted(label: str, original: Column, response: Column, extra: float) -> Column:
    most = F.greatest(F.lit(1), F.floor(original * extra + 1e-9).cast("int"))
    wrong = (response < original) | (response - original > most)
    return F.when(wrong, F.format_string(COUNT_REASON.format(label=label), original, response))


def validate(response: Column, original: Column, placeholders: Column | None = None, least: float = 0.4, most: float = 2.5, extra: float = 0.1) -> Column:
    """struct<is_valid, reasons>: all reasons against a response, in a fixed order.

    An empty response has that reason alone. With the array of placeholders
    every one of them has to occur; without, their numbers have to agree. A
    few extra headings and list items pass, lost ones don't.
    """
    text = strip(response)
    chat = F.concat(F.lit("Frase de chat detectada: '"), chat_phrase(text), F.lit("'"))
    if placeholders is not None:
        keys = F.transform(F.sequence(F.lit(0), F.size(placeholders) - 1), lambda i: F.concat(F.lit("__PH_"), i.cast("string"), F.lit("__")))
        keys = F.when(F.size(placeholders) > 0, keys).otherwise(F.array().cast("array<string>"))
        present = F.transform(F.regexp_extract_all(text, F.lit(r"(?iuU)__\s*PH_(\d+)\s*__"), F.lit(1)), lambda n: F.concat(F.lit("__PH_"), n, F.lit("__")))
        missing = F.array_except(keys, present)
        lost = F.when(F.size(missing) > 0, F.concat(F.lit("Divergência de placeholders: esperado "), _brackets(F.array_sort(keys)), F.lit(", ausente(s): "), _brackets(missing)))
    else:
        before, after = (F.array_sort(F.regexp_extract_all(x, F.lit(P.java(P.PLACEHOLDER, "(?iuU)")), F.lit(0))) for x in (original, text))
        lost = F.when(F.size(before) != F.size(after), F.concat(F.lit("Divergência de placeholders: esperado "), _brackets(before), F.lit(", encontrado "), _brackets(after)))
    headings = _counted("títulos", _count(original, P.HEADING), _count(text, P.HEADING), extra)
    items = _counted("itens de lista", _count(original, P.LIST_ITEM), _count(text, P.LIST_ITEM), extra)
    long_, own = F.length(strip(original)), F.length(text)
    ratio = own / long_
    shown = _two_places(ratio)
    size = F.when(
        long_ >= 30,
        F.when(ratio < least, F.format_string(f"Tamanho muito curto: razão %s < mínimo {least}", shown)).when(ratio > most, F.format_string(f"Tamanho muito longo: razão %s > máximo {most}", shown)),
    ).otherwise(F.when(own > long_ * 4 + 25, F.format_string("Tamanho excedeu limite para texto curto: %d caracteres", own)))
    reasons = F.when(text == "", F.array(F.lit("A resposta do modelo veio vazia."))).otherwise(F.array_compact(F.array(chat, lost, headings, items, size)))
    return F.struct((F.size(reasons) == 0).alias("is_valid"), reasons.alias("reasons"))


_HEADING_LINE = re.compile(r"^(#{1,6})\s+(.*)$", re.MULTILINE)


def demote_headings(text: str, original: str) -> str:
    """Headings beyond the original's as plain lines: in order, the original's are aligned at the least cost of level and place."""
    wanted = [(len(m[1]), m.start() / max(1, len(original))) for m in _HEADING_LINE.finditer(original)]
    given = list(_HEADING_LINE.finditer(text))
    spare = len(given) - len(wanted)
    if spare <= 0:
        return text
    places = [(len(m[1]), m.start() / max(1, len(text))) for m in given]
    # cost[k][j]: least cost of the first j wanted ones among the first j + k given ones, k of them left out.
    cost = [[0.0] * (len(wanted) + 1) for _ in range(spare + 1)]
    match: dict[tuple[int, int], bool] = {}
    for k in range(spare + 1):
        for j in range(1, len(wanted) + 1):
            (level, at), (own_level, own_at) = wanted[j - 1], places[j + k - 1]
            taken = cost[k][j - 1] + (level != own_level) + abs(own_at - at)
            skipped = cost[k - 1][j] if k else float("inf")
            cost[k][j] = min(taken, skipped)
            match[k, j] = taken <= skipped
    extra, k, j = set(), spare, len(wanted)
    while k or j:
        if j and match[k, j]:
            j -= 1
        else:
            extra.add(j + k - 1)
            k -= 1
    numbers = iter(range(len(given)))
    return _HEADING_LINE.sub(lambda m: m[2] if next(numbers) in extra else m[0], text)


@F.pandas_udf(StringType())
def demote_extra_headings(text: pd.Series, original: pd.Series) -> pd.Series:
    """demote_headings by row: the alignment depends on data in two dimensions, beyond column expressions."""
    return pd.Series([None if t is None or pd.isna(t) else demote_headings(t, o if isinstance(o, str) else "") for t, o in zip(text, original)])
