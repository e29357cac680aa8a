"""Columns derived from a single fact, computed once before facts are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .text import stripped

_TOKEN = "[a-z0-9]+"
#: What counts as a number, as a day.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$|^[+-]?(?i:inf|infinity|nan)$"
DAY = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s*(?:19|20)\d{2}\b|\b\d{1,2}(?:st|nd|rd|th)?\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?\s*(?:19|20)\d{2}\b"


def _none(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(_none(text)), F.lit(_TOKEN), F.lit(0))


def _without(tokens: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop))


def entity_key(name: Column) -> Column:
    """Lower-cased words without titles and company forms; names of those alone share the empty key."""
    return F.array_join(_without(words(name), S.ENTITY_STOP), " ")


def metric_tokens(metric: Column) -> Column:
    return F.array_distinct(_without(F.regexp_extract_all(F.replace(F.lower(_none(metric)), F.lit("-"), F.lit("")), F.lit(_TOKEN), F.lit(0)), S.METRIC_STOP))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard of two token sets: 0 with an empty one, 1 if equal, 0 if the union has fewer than three."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when((both == F.size(a)) & (both == F.size(b)), 1.0).when(either < S.LEAST_UNION, 0.0).otherwise(both / either)


def number_of(value: Column) -> Column:
    """A figure as a double: parentheses negate; commas, rupee and percent signs go; null if it is no number."""
    t = stripped(value)
    inner = F.regexp_replace(t, r"^[()]+|[()]+$", "")
    inner = stripped(F.regexp_replace(inner, "[,₹%]", ""))
    plain = F.when(inner.rlike(NUMBER), F.regexp_replace(F.regexp_replace(inner, "_", ""), r"^\+", ""))
    figure = plain.try_cast("double")
    return F.when(t.startswith("(") & t.endswith(")"), -figure).otherwise(figure)


def values_match(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(S.TOLERANCE)


def year_of(period: Column) -> Column:
    full = F.nullif(F.regexp_extract(period, r"(20\d{2})", 1), F.lit(""))
    short = F.nullif(F.regexp_extract(period, r"(?i)\bFY\s?(\d{2})\b", 1), F.lit(""))
    return F.coalesce(full.cast("int"), short.cast("int") + 2000)


def names_day(period: Column) -> Column:
    return F.coalesce(period.rlike(DAY), F.lit(False))


def is_percentage(unit: Column, metric: Column) -> Column:
    u = F.lower(_none(unit))
    by_unit = F.contains(u, F.lit(S.PERCENT_UNITS[0]))
    for x in S.PERCENT_UNITS[1:]:
        by_unit = by_unit | F.contains(u, F.lit(x))
    return by_unit | F.arrays_overlap(words(metric), F.array(*[F.lit(x) for x in S.PERCENT_WORDS]))


def value_form(value: Column) -> Column:
    """Semantic values and quotes in the form in which they are compared."""
    return F.trim(F.regexp_replace(F.lower(stripped(_none(value))), r"[,\s]+", " "))


def same_meaning(a: Column, b: Column) -> Column:
    """Of two value forms: equal, one inside the other, or three quarters of at least five words in common."""
    x, y = F.array_distinct(F.regexp_extract_all(a, F.lit(_TOKEN), F.lit(0))), F.array_distinct(F.regexp_extract_all(b, F.lit(_TOKEN), F.lit(0)))
    either = F.size(F.array_union(x, y))
    jaccard = F.when(either >= S.VALUE_TOKENS, F.size(F.array_intersect(x, y)) / either).otherwise(0.0)
    return (a == b) | F.contains(a, b) | F.contains(b, a) | (jaccard >= S.VALUE_OVERLAP)


def flat(col: Column) -> Column:
    return F.lower(stripped(_none(col)))


def with_claims(facts: DataFrame) -> DataFrame:
    """Adds entity_key, tokens, num, year, day, pct, basis_key, meaning and quote_form."""
    return facts.withColumns(
        {
            "entity_key": entity_key(F.col("entity")),
            "tokens": metric_tokens(F.col("metric")),
            "num": number_of(F.col("value")),
            "year": year_of(F.col("period_label")),
            "day": names_day(F.col("period_label")),
            "pct": is_percentage(F.col("unit"), F.col("metric")),
            "basis_key": flat(F.col("basis")),
            "meaning": value_form(F.col("value")),
            "quote_form": value_form(F.col("quote")),
        }
    )
