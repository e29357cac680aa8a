"""Files in and tables out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import upsert, with_identity
from ..operators.pages import with_metrics


def input_paths(spark: SparkSession, inputs: list[str], ending: str = ".pdf", warn: Callable[[str], None] | None = None) -> tuple[list[str], list[str]]:
    """Of files and folders the folders, and the files with the ending in any case; others are told to warn."""
    folders, own = [], []
    for raw in inputs:
        path = spark._jvm.org.apache.hadoop.fs.Path(raw)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.getFileStatus(path).isDirectory():
            folders.append(raw)
        elif raw.lower().endswith(ending) and fs.exists(path):
            own.append(raw)
        elif warn:
            warn(f"skipped (no {ending} file): {raw}")
    return folders, own


def read_files(spark: SparkSession, path: str | list[str], pattern: str = "*.pdf", warn: Callable[[str], None] | None = None) -> DataFrame:
    """doc_id, filename, file_path, content_hash, content of every file: named ones, and those under folders that fit the pattern.

    A file counts once, however often it is named.
    """
    folders, own = input_paths(spark, [path] if isinstance(path, str) else path, pattern.removeprefix("*").lower(), warn)
    reader = lambda: spark.read.format("binaryFile")
    parts = [reader().option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folders)] if folders else []
    parts += [reader().load(own)] if own else []
    if not parts:
        return spark.createDataFrame([], "doc_id string, filename string, file_path string, content_hash string, content binary")
    named = reduce(DataFrame.unionByName, parts).select(F.substring_index("path", "/", -1).alias("filename"), F.col("path").alias("file_path"), "content")
    named = named.dropDuplicates(["file_path"]) if len(parts) > 1 or len(folders) > 1 else named
    return with_identity(named).select("doc_id", "filename", "file_path", "content_hash", "content")


def form_feed_pages(content: bytes) -> list[str]:
    """A parser for plain text whose pages end with form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def pdf_pages(content: bytes) -> list[str]:
    """Pages of a PDF, where a PDF library is installed."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("no PDF library is installed; pass a parser of your own") from e
    with fitz.open(stream=content, filetype="pdf") as doc:
        return [page.get_text() for page in doc]


def extract_pages(files: DataFrame, parser: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """doc_id, page_number, text, char_count, low_text; the parser runs on the executors, a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts = parser(content.as_py())
                yield pa.record_batch({"doc_id": pa.array([doc] * len(texts), pa.string()), "page_number": pa.array(range(1, len(texts) + 1), pa.int32()), "text": pa.array(texts, pa.string())})

    return with_metrics(files.select("doc_id", "content").mapInArrow(run, "doc_id string, page_number int, text string"))


def save_uploads(files: DataFrame, folder: str) -> DataFrame:
    """Copies each file to folder/doc_id with its own ending (.pdf without one), on the executors; gives doc_id and file_path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, at = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            paths = []
            for doc, name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ending = "." + name.rpartition(".")[2].lower() if "." in name else ".pdf"
                with fs.open_output_stream(f"{at}/{doc}{ending}.tmp") as out:
                    out.write(content.as_buffer())
                fs.move(f"{at}/{doc}{ending}.tmp", f"{at}/{doc}{ending}")
                paths.append(f"{folder}/{doc}{ending}")
            yield pa.record_batch({"doc_id": batch.column(0), "file_path": pa.array(paths, pa.string())})

    return files.select("doc_id", "filename", "content").mapInArrow(run, "doc_id string, file_path string")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """Writes beside the old table and swaps the folders by renaming, the old one going last."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old, new, here = fs_path(f"{path}.old"), fs_path(f"{path}.new"), fs_path(path)
    fs.delete(old, True)
    if fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(new, here):
        fs.rename(old, here)
        raise OSError(f"{path} could not be published")
    fs.delete(old, True)


def upsert_table(spark: SparkSession, new: DataFrame, path: str, *keys: str) -> None:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    have = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    publish(upsert(spark.read.parquet(path) if have else new.limit(0), new, *keys), path)
