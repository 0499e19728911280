"""Protecting inline code, URLs and paths by placeholders, and restoring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P

_PASSES = [P.INLINE_CODE, P.URL, P.FILE_PATH]


def _token(n: Column) -> Column:
    return F.concat(F.lit("__PH_"), n.cast("string"), F.lit("__"))


def protect(df: DataFrame, text_col: str = "text", protected_col: str = "protected", found_col: str = "placeholders") -> DataFrame:
    """Add the text with placeholders and the array of what they stand for, numbered pass by pass from 0.

    Each pass replaces its matches in order of appearance; the text between
    matches and the tokens are put together again, so nothing is matched twice.
    A null text gives null and an empty array.
    """
    df = df.withColumn(protected_col, F.col(text_col)).withColumn(found_col, F.array().cast("array<string>"))
    for pattern in _PASSES:
        now, found = F.col(protected_col), F.col(found_col)
        matches = F.coalesce(F.regexp_extract_all(now, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
        offset = F.size(found)
        parts = F.split(now, pattern, -1)
        put = F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(_token(offset + i - 1), x))), "")
        df = df.withColumns({protected_col: F.when(F.size(matches) == 0, now).otherwise(put), found_col: F.concat(found, matches)})
    return df


def restore(text: Column, found: Column) -> Column:
    """Put back what placeholders stand for, tolerating case and spaces inside; unknown numbers stay. A single pass."""
    pattern = r"(?iuU)__\s*PH_(\d+)\s*__"
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)

    def original(i: Column) -> Column:
        n = F.try_element_at(numbers, i).try_cast("int") if hasattr(Column, "try_cast") else F.try_element_at(numbers, i).cast("int")
        return F.coalesce(F.try_element_at(found, n + 1), F.try_element_at(tokens, i))

    return F.when(F.size(numbers) == 0, text).otherwise(F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(original(i), x))), ""))
