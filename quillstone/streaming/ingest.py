"""An extension: documents that arrive as a stream are deduplicated and appended in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.identity import content_hash, first_of_each, unseen


def ingest_stream(spark: SparkSession, source: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """source has doc_id, filename and text. A batch that is repeated after a failure adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        new = first_of_each(batch.withColumn("content_hash", content_hash(F.coalesce("text", F.lit("")))), "filename")
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = unseen(new, spark.read.parquet(table))
        new.write.mode("append").parquet(table)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
