"""Structured Streaming: incremental ingest by content hash, session expiry, windowed usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import ingest as ingest_into
from ..operators.ingest import knowledge_base
from ..sources.store import content_hash


def ingest(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str) -> StreamingQuery:
    """Reads new document files and appends the versions (doc_id, text hash) that the store doesn't have yet.

    A batch that is run again after a failure finds its own versions there and appends nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = batch.withColumn("content_hash", content_hash("doc_id", "text")).dropDuplicates(["doc_id", "content_hash"])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(store)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            new = new.join(spark.read.parquet(store).select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti").select(*new.columns)
        new.write.mode("append").parquet(store)

    files = spark.readStream.schema(schema).parquet(source)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserts(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, name: str = "documents") -> StreamingQuery:
    """Takes new document files (doc_id, text) into the knowledge base in ``store``: each batch is one commit of documents, chunks and vectors.

    A changed document's rows take the place of its old ones; a batch that is run again after a failure finds its number in the manifest.
    """

    def take_in(batch: DataFrame, number: int) -> None:
        ingest_into(knowledge_base(spark, store), batch, stream=name, batch=number)

    files = spark.readStream.schema(schema).parquet(source)
    return files.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expiring_sessions(events: DataFrame, late: str = "1 hour", gap: str = "12 hours") -> DataFrame:
    """Sessions of users in a stream of (ts, user_id): closed ``gap`` after the last event, state dropped when the watermark passes."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("begins"), F.col("s.end").alias("expires"), "n")


def windowed_usage(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Calls and cost by type and window of a stream of (ts, event_type, value)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("calls"), F.sum("value").alias("cost")).select("event_type", F.col("w.start").alias("begins"), "calls", "cost")
