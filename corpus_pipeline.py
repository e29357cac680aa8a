"""A training-data pipeline over `documents`: classify, deduplicate, cut repeats, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last
one returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import jaccard, mixing, packing, quality, substring
from quillstone.llm.common import WORD, few_files, load, shared_dir


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with __key, one number a row: doc_id where every row has its own, else a hash of id and text (equal rows share it)."""
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NULL OR n > 1")
    return docs.withColumn("__key", F.col("doc_id").cast("long") if shared.isEmpty() else F.xxhash64("doc_id", "text"))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the co-trained classifier finds neither low in quality nor toxic."""
    models = quality.train(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, models, carry=True).where("keep").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id (null first) of each component. Rows link by their texts alone, also those that share an id or have none."""
    keyed = _keyed(docs)
    found = jaccard.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), "component_id").distinct()
    ids = keyed.select("__key", "doc_id").distinct().join(found, "__key")
    kept = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "__key")).alias("least")).select(F.col("least.__key").alias("__key"))
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns).coalesce(few_files(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words and more that an earlier document has out of the texts; texts without any stay as they are."""
    found = substring.dedup(docs, carry=tuple(docs.columns))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as often as the mix takes them: whole times on lines of their own, then the first words of the last time."""
    keyed = _keyed(docs)
    taken = mixing.mix(keyed.withColumn("doc_id", F.col("__key"))).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("epochs").alias("__epochs"), F.col("extra").alias("__extra"))
    rows = keyed.join(taken, F.col("__key") == F.col("__id"))
    part = F.when(F.col("__extra") > 0, F.array(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("__extra").cast("int")), " "))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.array_repeat("text", F.col("__epochs").cast("int")), part), "\n")
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark))


STAGES = [("quality", classify), ("near_copies", near_copies), ("repeats", cut_repeats), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are a table in the shared folder, which goes with the session."""
    work = shared_dir(spark)
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{work}/{i}-{name}")
        docs = spark.read.parquet(f"{work}/{i}-{name}")
    return docs


#: A classifier and a lexical packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None
