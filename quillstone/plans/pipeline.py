"""Ingest and extraction as compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_form
from ..operators import chunks as C
from ..operators import grounding as G
from ..operators import identity as I
from ..operators import pages as P
from ..operators import responses as R
from . import views as V


def ingest(files: DataFrame, pages: DataFrame, stored: DataFrame | None = None, order: str = "filename") -> dict[str, DataFrame]:
    """documents, pages and chunks of files (doc_id, filename, content_hash) not stored yet; the first file in order of each content counts."""
    new = I.first_of_each(files, order)
    new = I.unseen(new, stored) if stored is not None else new
    own = pages.join(new.select("doc_id"), "doc_id", "left_semi").select("doc_id", "page_number", "text")
    labels = P.printed_pages(own).select("doc_id", "page_number", "printed_page")
    own = P.with_metrics(own.join(labels, ["doc_id", "page_number"], "left"))
    count = own.groupBy("doc_id").agg(F.count("*").alias("num_pages"))
    documents = new.select("doc_id", "filename", "content_hash").join(count, "doc_id", "left").withColumn("status", F.lit("chunked"))
    return {"documents": documents, "pages": own, "chunks": C.chunk_pages(own)}


def ingest_summary(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["pages"].agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("pages"), F.count_if("low_text").alias("low_text_pages"), F.count("printed_page").alias("printed_pages"))


def ingest_report(files: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each file: filename, doc_id, ingested (else it was there before, or its content under another name), pages, chunks, low_text_pages and printed_pages."""
    pages = tables["pages"].groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.when(F.col("low_text"), F.col("page_number")))).alias("low_text_pages"), F.count("printed_page").alias("printed_pages"))
    chunks = tables["chunks"].groupBy("doc_id").agg(F.count("*").alias("chunks"))
    new = tables["documents"].select("doc_id", "filename").withColumn("ingested", F.lit(True)).join(pages, "doc_id", "left").join(chunks, "doc_id", "left")
    told = files.select("filename", "doc_id").join(new, ["doc_id", "filename"], "left")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("pages", "chunks", "printed_pages")}
    return told.select("filename", "doc_id", F.coalesce("ingested", F.lit(False)).alias("ingested"), zero["pages"], zero["chunks"], F.coalesce("low_text_pages", F.array().cast("array<int>")).alias("low_text_pages"), zero["printed_pages"])


def outcomes(chunks: DataFrame, pages: DataFrame, cache: DataFrame, form: Callable[[Column], Column] = match_form) -> dict[str, DataFrame]:
    """facts (in good shape and grounded in that form, each id once) and rejections (parse, shape and grounding) of the chunks' stored responses."""
    answered = R.cached(chunks, cache).where("response_text IS NOT NULL")
    rows = R.candidates(answered.select("doc_id", F.col("id").alias("chunk_id"), "response_text"))
    ranges = chunks.select(F.col("id").alias("chunk_id"), "page_start", "page_end", "chunk_index")
    good = R.shaped(rows).join(ranges, "chunk_id").withColumn("__key", F.concat_ws("#", "chunk_id", "pos"))
    facts, bad = G.split_outcome(G.ground(good, pages, "__key", form))
    return {"facts": I.first_of_each(facts.drop("__key"), "pos", "id"), "rejections": R.rejections_of(rows).unionByName(bad)}


def extract(chunks: DataFrame, pages: DataFrame, cache: DataFrame, call: Callable[[str], str], form: Callable[[Column], Column] = match_form) -> dict[str, DataFrame]:
    """facts, rejections and the new cache rows (answers), all lazy. run_extraction() stores the answers first, so that each is paid once."""
    answers = R.answered(R.misses(chunks, cache), call)
    return {"answers": answers} | outcomes(chunks, pages, R.stored(cache, answers), form)


def run_extraction(chunks: DataFrame, pages: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], call: Callable[[str], str], keep: Callable[[dict[str, DataFrame]], None], slices: int = 1, on_progress: Callable[[int, int], None] | None = None) -> dict[str, int]:
    """Answers, checks and keeps the chunks, a slice at a time; returns the counts of chunks, calls_made, facts and rejections.

    load reads the stored responses and save adds answers to them; keep gets a slice's facts and rejections. A text that is
    answered, in this run or an earlier one, is not sent again. on_progress is told the chunks done, and all, after each slice.
    """
    told = dict.fromkeys(("chunks", "calls_made", "facts", "rejections"), 0)
    total = chunks.count()
    for i in range(slices):
        part = chunks.where(F.pmod(F.xxhash64("content_hash"), F.lit(slices)) == i) if slices > 1 else chunks
        missing = R.misses(part, load())
        told["calls_made"] += (calls := missing.count())
        if calls:
            save(R.answered(missing, call))
        got = {k: v.persist() for k, v in outcomes(part, pages, load()).items()}
        told["chunks"] += part.count()
        for k in ("facts", "rejections"):
            told[k] += got[k].count()
        keep(got)
        for v in got.values():
            v.unpersist()
        if on_progress:
            on_progress(told["chunks"], total)
    return told


def priority_chunks(chunks: DataFrame, required: DataFrame, extra: int = 0) -> DataFrame:
    """Chunks that cover a required page (rank, doc_id, page_number), and up to `extra` evenly spaced others of each document."""
    first = V.covering_chunks(chunks, required).select("id")
    ids = first.unionByName(V.sampled_chunks(chunks, extra, first).select("id")) if extra else first
    return chunks.join(ids, "id", "left_semi")


def numbered(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """Facts with fact_seq, in order of document, chunk and place, behind all that is stored."""
    last = stored.agg(F.max("fact_seq").alias("m")).first()["m"]
    ordered = facts.orderBy("doc_id", "chunk_index", "pos", "id")
    return ordered.drop("chunk_index", "pos").withColumn("fact_seq", F.lit((last if last is not None else -1) + 1) + F.monotonically_increasing_id())
