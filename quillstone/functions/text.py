"""Text normalisation, token estimates and predicates with the semantics of the query surface."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that vanish, and those folded to ', " and -.
GONE = "​‌‍⁠﻿­"
FOLDED = {"‘’‚‛": "'", "“”„‟": '"', "‐‑‒–—―−": "-"}
#: Texts of these characters alone need no Unicode rules.
ASCII = r"^[\t-\r -~]*$"
#: White space that Python's strip() takes off, as a Java class.
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0  -     　]+"

_FOLD = {ord(c): None for c in GONE} | {ord(c): to for some, to in FOLDED.items() for c in some}
_RUN = re.compile(r"\s+")


def fold(text: str) -> str:
    """Compatibility forms, typographic marks and runs of white space in one canonical spelling."""
    return _RUN.sub(" ", unicodedata.normalize("NFKC", text).translate(_FOLD)).strip()


@F.pandas_udf(StringType())
def _folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(fold, na_action="ignore")


@F.pandas_udf(StringType())
def _matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: fold(t).casefold(), na_action="ignore")


def _simple(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\t-\r ]+", " "))


def normalized(text: Column) -> Column:
    """Plain ASCII stays in the JVM; only other rows reach Python."""
    plain = text.rlike(ASCII)
    return F.when(plain, _simple(text)).otherwise(_folded(F.when(~plain, text)))


def spaced(text: Column) -> Column:
    """Runs of blanks, tabs and line ends are one blank; letters stay as they are."""
    return F.trim(F.regexp_replace(text, r"[\t\n\f\r ]+", " "))


def match_form(text: Column) -> Column:
    plain = text.rlike(ASCII)
    return F.when(plain, F.lower(_simple(text))).otherwise(_matched(F.when(~plain, text)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{_BLANK}", ""), f"{_BLANK}$", "")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def _small(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_anywhere(col: Column, needle: str) -> Column:
    """col LIKE %needle%: case counts for none of A-Z, % and _ in the needle are wildcards, nothing escapes."""
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in needle)
    return _small(col).like("%" + small.replace("\\", "\\\\") + "%")


def holds(col: Column, needle: str) -> Column:
    """Substring regardless of case, without wildcards; null holds only the empty string."""
    return F.contains(F.lower(F.coalesce(col, F.lit(""))), F.lit(needle.lower()))
