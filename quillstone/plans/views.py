"""The public query surface: summaries, filtered and paged lists, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import holds, like_anywhere
from ..operators.relate import relationships as relate
from ..operators.relate import with_evidence


def _limits(limit: int, offset: int = 0, most: int = 1000) -> None:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def _per_document(documents: DataFrame, *counts: tuple[DataFrame, Column, str]) -> DataFrame:
    out = documents
    for table, expr, name in counts:
        out = out.join(table.groupBy("doc_id").agg(expr.alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def documents_summary(documents: DataFrame, pages: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    got = _per_document(documents, (chunks, F.count("*"), "n_chunks"), (facts, F.count("*"), "n_facts"), (pages, F.count_if("low_text"), "n_low_text"))
    return got.select("doc_id", "filename", "n_chunks", "n_facts", "n_low_text").orderBy("filename")


def stats(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    got = _per_document(documents, (pages, F.count("*"), "n_pages"), (chunks, F.count("*"), "n_chunks"), (pages, F.count_if("low_text"), "n_low_text"), (pages, F.count("printed_page"), "n_printed"))
    return got.select("doc_id", "filename", "n_pages", "n_chunks", "n_low_text", "n_printed").orderBy("filename")


def page_map(pages: DataFrame, doc_id: str) -> DataFrame:
    return pages.where(F.col("doc_id") == doc_id).select("doc_id", "page_number", "printed_page", "char_count", "low_text").orderBy("page_number")


def page_text(pages: DataFrame, doc_id: str, page: int) -> DataFrame:
    return pages.where((F.col("doc_id") == doc_id) & (F.col("page_number") == page)).select("text")


def pages_in_range(pages: DataFrame, doc_id: str, first: int, last: int) -> DataFrame:
    return pages.where((F.col("doc_id") == doc_id) & F.col("page_number").between(first, last)).orderBy("page_number")


def matching_facts(facts: DataFrame, doc_id: str = "", entity: str = "", metric: str = "", fact_type: str = "") -> DataFrame:
    """Filters that are given, all at once; an empty string is no filter."""
    out = facts
    for col, value in (("doc_id", doc_id), ("fact_type", fact_type)):
        out = out.where(F.col(col) == value) if value else out
    for col, value in (("entity", entity), ("metric", metric)):
        out = out.where(like_anywhere(F.col(col), value)) if value else out
    return out


def facts_page(facts: DataFrame, limit: int = 100, offset: int = 0, **filters: str) -> tuple[DataFrame, DataFrame]:
    """The total of the matching facts, and one page of them in a total order."""
    _limits(limit, offset)
    found = matching_facts(facts, **filters)
    return found.agg(F.count("*").alias("total")), found.orderBy("doc_id", "page_number", "id").offset(offset).limit(limit)


def fact(facts: DataFrame, fact_id: str) -> DataFrame:
    return facts.where(F.col("id") == fact_id)


def existing(found: DataFrame, what: str) -> DataFrame:
    """The same rows, or a LookupError if there are none: the answer for an unknown document or fact."""
    if found.isEmpty():
        raise LookupError(f"no such {what}")
    return found


def existence(asked: DataFrame, table: DataFrame, key: str, of: str = "id") -> DataFrame:
    """asked's rows with known: whether the table has a row whose `of` is asked's key."""
    have = table.select(F.col(of).alias(key)).distinct().withColumn("known", F.lit(True))
    return asked.join(have, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def relationships(facts: DataFrame, relation_type: str = "", entity: str = "", limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """The number of each type after the filters, and the first relations in order."""
    _limits(limit, most=2000)
    if relation_type and relation_type not in S.RELATIONS:
        raise ValueError(f"relation_type must be one of {S.RELATIONS}")
    found = relate(facts)
    found = found.where(F.col("relation_type") == relation_type) if relation_type else found
    if entity:
        of = facts.where(holds(F.col("entity"), entity)).select(F.col("id").alias("__id"))
        found = found.withColumn("__id", F.explode("fact_ids")).join(of, "__id", "left_semi").select(*found.columns).distinct()
    # evidence is attached to the page alone
    page = with_evidence(found.orderBy("order_key").limit(limit), facts)
    return found.groupBy("relation_type").agg(F.count("*").alias("n")), page.orderBy("order_key")


def rejections(table: DataFrame, doc_id: str = "", limit: int = 200) -> DataFrame:
    _limits(limit, most=2000)
    found = table.where(F.col("doc_id") == doc_id) if doc_id else table
    return found.orderBy(F.desc("created_at"), "chunk_id", "stage", "reason", "raw_json").limit(limit)


def covering_chunks(chunks: DataFrame, required: DataFrame) -> DataFrame:
    """chunk id and rank, by the order (rank) of the required pages (rank, doc_id, page_number) and the chunk's place; the first rank counts."""
    hit = chunks.join(required.select("rank", F.col("doc_id").alias("__doc"), "page_number"), (F.col("doc_id") == F.col("__doc")) & F.col("page_number").between(F.col("page_start"), F.col("page_end")))
    return hit.groupBy("id").agg(F.min(F.struct("rank", "chunk_index")).alias("__at")).select("id", F.col("__at.rank").alias("rank"), F.col("__at.chunk_index").alias("chunk_index"))


def first_covering_chunk(chunks: DataFrame, required: DataFrame) -> DataFrame:
    """rank and id of the first chunk, in the document's order, that covers each required page (rank, doc_id, page_number)."""
    hit = chunks.join(required.select("rank", F.col("doc_id").alias("__doc"), "page_number"), (F.col("doc_id") == F.col("__doc")) & F.col("page_number").between(F.col("page_start"), F.col("page_end")))
    return hit.groupBy("rank").agg(F.min_by("id", "chunk_index").alias("id"))


def sampled_chunks(chunks: DataFrame, per_doc: int, exclude: DataFrame | None = None) -> DataFrame:
    """Evenly spaced chunks of each document, per_doc at most."""
    from pyspark.sql import Window

    left = chunks.join(exclude.select("id"), "id", "left_anti") if exclude is not None else chunks
    doc = Window.partitionBy("doc_id")
    ranked = left.select("id", "doc_id", "chunk_index", (F.row_number().over(doc.orderBy("chunk_index")) - 1).alias("r"), F.count("*").over(doc).alias("n"))
    ranked = ranked.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / per_doc))).where(F.col("r") % F.col("step") == 0)
    return ranked.where(F.col("r") / F.col("step") < per_doc).select("id", "doc_id", "chunk_index")
