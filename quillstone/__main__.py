"""python -m quillstone --store DIR ingest|stats|pages|extract|priority|relationships ..."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .plans import pipeline, views
from .sources import files


class Store:
    """Tables in a folder; one that was never written is empty."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str, schema: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self.path(name)) if there else self.spark.createDataFrame([], schema)


_DOCUMENTS = "doc_id string, filename string, content_hash string, num_pages long, status string"
_CHUNKS = S.CHUNKS
_PARSERS = {"pdf": files.pdf_pages, "txt": files.form_feed_pages}


def _told(line: str) -> None:
    print(line, file=sys.stderr)


def ingest(store: Store, args: argparse.Namespace) -> int:
    found = files.read_files(store.spark, args.paths, f"*.{args.kind}", _told)
    if found.isEmpty():
        _told(f"no *.{args.kind} files in {', '.join(args.paths)}")
        return 1
    new = files.extract_pages(found.dropDuplicates(["doc_id"]), _PARSERS[args.kind])
    tables = {k: v.persist() for k, v in pipeline.ingest(found, new, store.table("documents", _DOCUMENTS)).items()}
    report = pipeline.ingest_report(found, tables).orderBy("filename")
    report.show(args.limit, truncate=False)
    pipeline.ingest_summary(tables).show()
    # documents last: a run that breaks off before leaves no document without its pages and chunks
    for name in ("pages", "chunks", "documents"):
        files.append(tables[name], store.path(name))
    for table in tables.values():
        table.unpersist()
    return 0


def stats(store: Store, args: argparse.Namespace) -> int:
    views.stats(store.table("documents", _DOCUMENTS), store.table("pages", S.PAGES), store.table("chunks", _CHUNKS)).show(args.limit, truncate=False)
    return 0


def pages(store: Store, args: argparse.Namespace) -> int:
    found = views.page_map(store.table("pages", S.PAGES), args.doc_id)
    found.show(args.limit, truncate=False)
    return int(found.isEmpty())


def _extracted(store: Store, args: argparse.Namespace, chunks: DataFrame) -> int:
    """Runs the model over the chunks, keeps facts and rejections, and prints the counts."""
    module, _, name = args.model.partition(":")
    call = getattr(importlib.import_module(module), name)

    def keep(got: dict[str, DataFrame]) -> None:
        facts = pipeline.numbered(got["facts"], store.table("facts", S.FACTS))
        files.upsert_table(store.spark, facts, store.path("facts"), "id")
        files.append(got["rejections"].withColumn("created_at", F.current_timestamp()), store.path("rejections"))

    told = pipeline.run_extraction(
        chunks, store.table("pages", S.PAGES), lambda: store.table("responses", S.RESPONSES), lambda new: files.upsert_table(store.spark, new, store.path("responses"), "content_hash", "prompt_version"),
        call, keep, args.slices, lambda done, all_: _told(f"  [{done}/{all_}] extracted"),
    )
    print(f"chunks processed: {told['chunks']}   calls: {told['calls_made']}   facts: {told['facts']}   rejections: {told['rejections']}")
    return 0


def extract(store: Store, args: argparse.Namespace) -> int:
    chunks = store.table("chunks", _CHUNKS)
    chunks = chunks.where(F.col("doc_id") == args.doc_id) if args.doc_id else chunks
    chunks = chunks.orderBy("doc_id", "chunk_index").limit(args.limit) if args.limit else chunks
    if chunks.isEmpty():
        _told("no chunks; ingest first")
        return 1
    return _extracted(store, args, chunks)


def priority(store: Store, args: argparse.Namespace) -> int:
    """Extracts from the chunks of the given pages first, and from some more of each document."""
    asked = [(i, *x.rpartition(":")[::2]) for i, x in enumerate(args.pages)]
    wanted = store.spark.createDataFrame([(i, name, int(page)) for i, name, page in asked], "rank int, filename string, page_number int")
    documents = store.table("documents", _DOCUMENTS).select("doc_id", "filename")
    required = wanted.join(documents, "filename", "left")
    for r in required.where("doc_id IS NULL").orderBy("rank").collect():  # of the pages asked for
        _told(f"  {r['filename']} is not ingested, page {r['page_number']} is skipped")
    chunks = pipeline.priority_chunks(store.table("chunks", _CHUNKS), required.where("doc_id IS NOT NULL"), args.extra)
    if chunks.isEmpty():
        _told("no chunks selected; ingest first")
        return 1
    return _extracted(store, args, chunks)


def relationships(store: Store, args: argparse.Namespace) -> int:
    """The number of each type, then the relations of each type in the fixed order of the types, with their evidence."""
    facts = store.table("facts", S.FACTS)
    if facts.isEmpty():
        _told("no facts; extract first")
        return 1
    most = args.limit or 200
    counts = {r["relation_type"]: r["n"] for r in views.relationships(facts)[0].collect()}
    print(f"{facts.count()} facts analysed, {sum(counts.values())} relationships found:")
    for kind in S.RELATIONS:
        print(f"  {kind}: {counts.get(kind, 0)}")
    for kind in (k for k in S.RELATIONS if counts.get(k)):
        print(f"\n=== {kind.upper()} ({counts[kind]}) ===")
        for r in views.relationships(facts, kind, limit=most)[1].collect():  # `most` rows
            print(f"  {r['explanation']}")
            for e in r["evidence"]:
                print(f"    - {e['entity']} | {e['metric']} = {e['value']}  (doc {e['doc_id']}, page {e['page_number']}, printed {e['printed_page']})")
                print(f"      quote: {e['quote']!r}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillstone")
    parser.add_argument("--store", default="store")
    commands = parser.add_subparsers(required=True)
    for f in (ingest, stats, pages, extract, priority, relationships):
        p = commands.add_parser(f.__name__)
        p.set_defaults(run=f)
        p.add_argument("--limit", type=int, default=0 if f in (extract, priority, relationships) else 100)
        if f is ingest:
            p.add_argument("paths", nargs="+", help="files and folders")
            p.add_argument("--kind", choices=sorted(_PARSERS), default="pdf")
        if f is pages:
            p.add_argument("doc_id")
        if f is extract:
            p.add_argument("--doc-id", default="")
        if f is priority:
            p.add_argument("pages", nargs="+", help="file name:page number")
            p.add_argument("--extra", type=int, default=0, help="more chunks of each document")
        if f in (extract, priority):
            p.add_argument("--slices", type=int, default=1, help="parts after each of which progress is told")
            p.add_argument("--model", required=True, help="module:function from a prompt to a response")
    args = parser.parse_args(argv)
    return args.run(Store(SparkSession.builder.getOrCreate(), args.store), args)


if __name__ == "__main__":
    sys.exit(main())
