"""Column forms of the flat parts of JSON repair and validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textward.operators import repair as R


def strip_fence(text: Column) -> Column:
    pattern = "(?s)" + R.FENCE
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def mend(text: Column) -> Column:
    text = F.translate(text, "".join(R.QUOTES), "".join(R.QUOTES.values()))
    for word, json_word in R.WORDS.items():
        text = F.regexp_replace(text, rf'(?<!["\p{{L}}\p{{N}}_]){word}(?!["\p{{L}}\p{{N}}_])', json_word)
    text = F.regexp_replace(text, R.BARE_KEY, '$1"$2"$3')
    return F.regexp_replace(text, R.TRAILING, "$1")


def double_quotes(text: Column) -> Column:
    return F.when(text.contains('"'), text).otherwise(F.replace(text, F.lit("'"), F.lit('"')))


def coerce_scalar(text: Column, kind: str) -> Column:
    """The one reading of a string as integer, number or boolean; null if there is none."""
    s = F.trim(text)
    if kind == "boolean":
        return F.when(F.lower(s).isin("true", "yes"), True).when(F.lower(s).isin("false", "no"), False)
    return s.try_cast("bigint" if kind == "integer" else "double")


def missing_required(text: Column, names: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, names)), F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))))


def extra_properties(text: Column, names: list[str]) -> Column:
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*map(F.lit, names))))
