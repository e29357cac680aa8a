"""Content identity: ids, hashes, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def short_id(digest: Column) -> Column:
    return F.substring(digest, 1, 16)


def with_identity(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("content_hash", content_hash(F.col(content))).withColumn("doc_id", short_id(F.col("content_hash")))


def first_of_each(files: DataFrame, order: str, hash_col: str = "content_hash") -> DataFrame:
    """The first row, in the given order, of each content; one partial aggregate, so copies do not pile up in a task."""
    rest = [c for c in files.columns if c != hash_col]
    best = files.groupBy(hash_col).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("__row"))
    return best.select(hash_col, "__row.*").select(*files.columns)


def unseen(files: DataFrame, stored: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    return files.join(stored.select(hash_col).distinct(), hash_col, "left_anti")


def fact_id(doc_id: Column, chunk_id: Column, entity: Column, metric: Column, quote: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", doc_id, chunk_id, F.lower(entity), F.lower(metric), quote), 256), 1, 20)


def upsert(stored: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new replace those of stored with equal keys; of repeated new keys that of the smallest hash of its columns stays."""
    rows = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), F.xxhash64(*[F.col(c) for c in rows.columns])))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__new", "__nth")


def dangling(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is gone, for explicit cascades."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
