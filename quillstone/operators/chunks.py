"""Overlapping chunks with page provenance.

Where a chunk ends depends on where the one before it ended, so a document is cut by one pass of
plain Python; documents are independent and dealt by their id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


class Spine:
    """A document's pages as one text; `start` and `end` are sorted arrays of the pages' places in it."""

    def __init__(self, pages: list[tuple[int, str]]) -> None:
        self.numbers = [n for n, _ in pages]
        self.text = S.PAGE_BREAK.join(t for _, t in pages)
        size = np.array([len(t) for _, t in pages], np.int64)
        self.start = np.cumsum(size + len(S.PAGE_BREAK)) - size - len(S.PAGE_BREAK)
        self.end = self.start + size

    def pages_of(self, a: int, b: int) -> tuple[int, int]:
        """The first and last page (by place) that text from a to b touches; text of page breaks alone belongs to the page before."""
        first, last = int(np.searchsorted(self.end, a, "right")), int(np.searchsorted(self.start, b, "left")) - 1
        if first > last:  # between pages, or at empty ones
            first = last = max(0, int(np.searchsorted(self.start, a, "right")) - 1)
        return first, last

    def stop(self, hard: int) -> int:
        """Where a chunk that may reach to `hard` stops: behind the latest of the best kind of break within reach, else there."""
        reach = self.text[max(0, hard - S.BOUNDARY_REACH) + 1 : hard]
        tails = ((reach.rpartition(mark), mark) for mark in S.BOUNDARIES)
        return next((hard - len(tail) for (_, found, tail), _ in tails if found), hard)

    def cuts(self, target: int, overlap: int) -> Iterator[tuple[int, int]]:
        """Starts and ends of the chunks, blank ones included; each starts `overlap` before the last one's end, and further on than it."""
        size, a, b = len(self.text), 0, 0
        while b < size:
            b = size if size - a <= target else self.stop(a + target)
            b = b if b > a else a + target
            yield a, b
            a = max(a + 1, b - overlap)


def cut(pages: list[tuple[int, str]], target: int = S.CHUNK_CHARS, overlap: int = S.CHUNK_OVERLAP) -> list[dict]:
    """The chunks of one document's pages (number, text) in order; pages without any text have none."""
    if overlap >= target:
        raise ValueError("the overlap must be smaller than the chunk")
    spine = Spine(pages)
    kept = [(a, b) for a, b in spine.cuts(target, overlap) if not spine.text[a:b].isspace()] if spine.text.strip() else []
    touched = [spine.pages_of(a, b) for a, b in kept]
    return [
        {"chunk_index": i, "page_start": spine.numbers[p], "page_end": spine.numbers[q], "char_offset": max(0, a - int(spine.start[p])), "text": spine.text[a:b], "token_count": max(1, (b - a) // 4)}
        for i, ((a, b), (p, q)) in enumerate(zip(kept, touched, strict=True))
    ]


def chunk_pages(pages: DataFrame, target: int = S.CHUNK_CHARS, overlap: int = S.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of every document (a document's pages are in one task): id, doc_id, chunk_index, page_start, page_end, char_offset, text, token_count, content_hash."""
    if overlap >= target:
        raise ValueError("the overlap must be smaller than the chunk")
    names = ["id", "doc_id", "chunk_index", "page_start", "page_end", "char_offset", "text", "token_count", "content_hash"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        doc = key[0].as_py()
        rows = sorted(zip(table["page_number"].to_pylist(), (t or "" for t in table["text"].to_pylist()), strict=True))
        return pa.Table.from_pylist([c | {"doc_id": doc, "id": f"{doc}:{c['chunk_index']}", "content_hash": hashlib.sha256(c["text"].encode()).hexdigest()} for c in cut(rows, target, overlap)], schema)

    return pages.select(F.col("doc_id").cast("string").alias("doc_id"), "page_number", "text").groupBy("doc_id").applyInArrow(run, S.CHUNKS)


def chunk_page_map(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each chunk and each page that its range covers."""
    c = chunks.select(F.col("id").alias("chunk_id"), "doc_id", "page_start", "page_end")
    return c.join(pages.select(F.col("doc_id").cast("string").alias("doc_id"), "page_number"), "doc_id").where("page_number BETWEEN page_start AND page_end").select("chunk_id", "doc_id", "page_number")
