"""Quotes must stand on a page of their chunk's range."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import match_form, stripped


def quote_on_page(quote: Column, page: Column) -> Column:
    return F.contains(match_form(page), match_form(quote))


def ground(quotes: DataFrame, pages: DataFrame, key: str, form: Callable[[Column], Column] = match_form, strip: Callable[[Column], Column] = stripped) -> DataFrame:
    """Adds grounded, page_number, printed_page and reason to quotes (key, doc_id, page_start, page_end, quote).

    The first page in order that contains the normalised quote counts. Pages are normalised once, and
    quotes are joined to the pages of their range alone; only the key travels through the aggregate.
    form is the spelling in which quotes and pages are compared, strip what a quote's length leaves out.
    """
    own = quotes.withColumn("__long", F.length(strip(F.coalesce("quote", F.lit("")))) >= S.QUOTE_CHARS)
    asked = own.where("__long").select(key, F.col("doc_id"), "page_start", "page_end", form(F.col("quote")).alias("__quote"))
    shown = pages.select("doc_id", "page_number", "printed_page", form(F.coalesce("text", F.lit(""))).alias("__page"))
    inside = (asked["doc_id"] == shown["doc_id"]) & shown["page_number"].between(asked["page_start"], asked["page_end"])
    pairs = asked.join(shown, inside).select(key, "page_number", "printed_page", F.contains("__page", "__quote").alias("__hit"))
    found = pairs.groupBy(key).agg(F.min(F.when(F.col("__hit"), F.struct("page_number", "printed_page"))).alias("__first"))
    out = own.join(found.withColumn("__seen", F.lit(True)), key, "left")
    grounded = F.coalesce(F.col("__first").isNotNull(), F.lit(False))
    reason = F.when(~F.col("__long"), "quote too short to be evidence").when(F.col("__seen").isNull(), "no pages in chunk range").when(~grounded, "quote not found on any page in range")
    return out.withColumns({"grounded": grounded, "page_number": F.col("__first.page_number"), "printed_page": F.col("__first.printed_page"), "reason": reason}).drop("__first", "__seen", "__long")


def split_outcome(grounded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts, and rejections with their stage."""
    bad = grounded.where("NOT grounded").select("doc_id", "chunk_id", F.lit("grounding").alias("stage"), "reason", F.to_json(F.struct("entity", "metric", "quote")).alias("raw_json"))
    return grounded.where("grounded").drop("reason"), bad


def _runs(words: Column, n: int) -> Column:
    """All runs of n neighbouring words, joined by blanks."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i + 1, n), " "))


def holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id and doc_id of every document (doc_id, page) that holds an item (item_id, quote), both in match form.

    They meet through a key that no cut at the quote's ends touches: up to three of its inner words, for
    two words the letters around the blank, for one word its first twelve characters. Documents make
    keys of those kinds alone that some item has; the quote itself then decides.
    """
    n = F.size(F.split("quote", " "))
    w = F.split("quote", " ")
    near = lambda left, right, a, b: F.concat(F.right(left, a), F.lit(" "), F.left(right, b))
    reach = lambda i: F.least(F.length(F.get(w, F.lit(i))), F.lit(4))
    inner = F.least(n - 2, F.lit(3))
    kind = F.when(n >= 3, inner.cast("string")).when(n == 2, F.concat_ws("+", reach(0), reach(1))).otherwise("0")
    key = F.when(n >= 3, F.array_join(F.slice(w, 2, inner), " ")).when(n == 2, near(F.get(w, F.lit(0)), F.get(w, F.lit(1)), reach(0), reach(1))).otherwise(F.left("quote", F.lit(S.QUOTE_CHARS)))
    asked = items.withColumns({"kind": kind, "key": F.concat_ws(":", kind, key)})
    kinds = [r["kind"] for r in asked.select("kind").distinct().collect()]  # twenty at most
    words = docs.select("doc_id", F.split("page", " ").alias("w"))
    parts = []
    for k in kinds:
        if "+" in k:
            a, b = (F.lit(int(x)) for x in k.split("+"))
            found = F.transform(_runs(F.col("w"), 2), lambda x: near(F.substring_index(x, " ", 1), F.substring_index(x, " ", -1), a, b))  # noqa: B023
        elif k == "0":
            long = F.filter("w", lambda x: F.length(x) >= S.QUOTE_CHARS)
            found = F.flatten(F.transform(long, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - (S.QUOTE_CHARS - 1)), lambda i: x.substr(i, F.lit(S.QUOTE_CHARS)))))
        else:
            found = _runs(F.col("w"), int(k))
        parts.append(words.select("doc_id", F.explode(F.array_distinct(found)).alias("key")).select("doc_id", F.concat_ws(":", F.lit(k), "key").alias("key")))
    if not parts:
        return docs.join(items, F.lit(False)).select("item_id", "doc_id")
    pairs = reduce(DataFrame.unionByName, parts).join(asked.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    return pairs.join(items.select("item_id", "quote"), "item_id").join(docs, "doc_id").where(F.contains("page", "quote")).select("item_id", "doc_id")
