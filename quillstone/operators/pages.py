"""Page metrics and the page numbers printed on pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import stripped

#: No offset; a number beyond all pages and offsets, to code them in one.
NONE, BASE = -(1 << 40), 1 << 30
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def with_metrics(pages: DataFrame) -> DataFrame:
    n = F.length(stripped(F.coalesce("text", F.lit(""))))
    return pages.withColumn("char_count", n).withColumn("low_text", n < S.LOW_TEXT_CHARS)


def printed_candidates(text: Column) -> Column:
    """Distinct numbers up to 3000 of one to four digits in short lines at the page's edges, in order."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), _LINES), stripped), lambda x: x != "")
    n = F.size(lines)
    # of few lines some are both first and last; distinct() below makes that harmless
    edge = F.concat(F.slice(lines, 1, S.EDGE_LINES), F.slice(lines, F.greatest(F.lit(1), n - S.EDGE_LINES + 1), F.lit(S.EDGE_LINES)))
    short = F.filter(edge, lambda x: F.length(x) <= S.EDGE_LINE_CHARS)
    found = F.flatten(F.transform(short, lambda x: F.regexp_extract_all(x, F.lit(r"(?<!\d)(\d{1,4})(?!\d)"), F.lit(1))))
    return F.filter(F.array_distinct(F.transform(found, lambda x: x.cast("int"))), lambda v: (v > 0) & (v <= S.MOST_PRINTED))


def _offsets(found: list[list[int]], k: int) -> np.ndarray:
    """For each page the offset that most pages around it share at k printed pages a sheet, if a page beside it agrees; else NONE."""
    out = np.full(len(found), NONE)
    size = np.array([len(x) for x in found], np.int64)
    place, shown = np.repeat(np.arange(len(found)), size), np.array([v for x in found for v in x], np.int64)
    if not len(shown):
        return out
    # one row for each number and each of the k pages of the sheet that it may stand on
    i = np.repeat(place, k)
    o = (np.repeat(shown, k) - k * i) - np.tile(np.arange(k), len(shown))
    coded, fit = np.unique((o + BASE) * BASE + i, return_counts=True)  # by offset, then page
    o, i = coded // BASE - BASE, coded % BASE
    votes = np.searchsorted(coded, coded + S.VOTE_WINDOW, "right") - np.searchsorted(coded, coded - np.minimum(i, S.VOTE_WINDOW)) - 1
    best = np.lexsort((o, -np.abs(o), fit, votes, i))
    last = best[np.append(i[best][1:] != i[best][:-1], True)]
    last = last[votes[last] >= S.LEAST_VOTES]
    picked = np.full(len(found) + 2, NONE)
    picked[i[last] + 1] = o[last]
    own = picked[1:-1]
    agreed = (own != NONE) & ((picked[:-2] == own) | (picked[2:] == own))
    out[agreed] = own[agreed]
    return out


def printed_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, printed_page (a label like 43 or 42-43, or null) and printed_last of every page.

    Each candidate votes, for one or two printed pages a sheet, for the offset between its number and
    the page's place; offsets are counted over neighbouring pages, the best one of a page stands if a
    page beside it agrees, and two pages a sheet win only by a clear margin. Numbers are found in the
    JVM; the votes of one document are counted together, which takes its pages' numbers alone.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("page_number")
        found = table["found"].to_pylist()
        one, two = (_offsets(found, k) for k in S.SHEET_FACTORS)
        wide = int((two != NONE).sum()) > S.SHEET_PREFERENCE * int((one != NONE).sum())
        offset, k = (two, 2) if wide else (one, 1)
        low = k * np.arange(len(found)) + offset
        known = (offset != NONE) & (low >= 1)
        label = [None if not ok else f"{n}-{n + 1}" if wide else str(n) for n, ok in zip(low.tolist(), known.tolist(), strict=True)]
        return pa.table({"doc_id": table["doc_id"], "page_number": table["page_number"], "printed_page": pa.array(label, pa.string()), "printed_last": pa.array(np.where(known, low + k - 1, 0), pa.int32(), mask=~known)})

    spine = pages.select("doc_id", "page_number", printed_candidates(F.col("text")).alias("found"))
    return spine.groupBy("doc_id").applyInArrow(run, f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, page_number {pages.schema['page_number'].dataType.simpleString()}, printed_page string, printed_last int")


def page_spans(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, start, end: half-open places in the document that joins its pages by a blank line."""
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce("text", F.lit("")))
    start = F.coalesce(F.sum(size + len(S.PAGE_BREAK)).over(before), F.lit(0))
    return pages.select("doc_id", "page_number", start.alias("start"), (start + size).alias("end"))
