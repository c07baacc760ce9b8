"""Incremental graph building from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.entities import extract_entities
from graphloom.operators.relations import extract_relations


class GraphStream:
    """Keeps node and edge tables up to date with a stream of documents(doc_id, text).

    Each micro-batch is extracted once and appended, under its batch id, as partial sums: mentions per text and type,
    with counts, sums and firsts that combine in any order, and relations. A batch that is run again overwrites its
    own partition, so results are exactly-once; nodes() is the same however the documents were split into batches.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        docs = batch.select("doc_id", "text")
        rows = extract_entities(docs)
        partial = rows.groupBy(F.lower(F.trim("text")).alias("key"), "type").agg(
            F.count("*").alias("n"),
            F.sum("confidence").alias("total"),
            F.min(F.struct("doc_id", "seq")).alias("first"),
            F.min(F.struct((-F.col("confidence")).alias("c"), "doc_id", "seq", "text")).alias("base"),
        )
        partial.write.mode("overwrite").parquet(f"{self.path}/mentions/batch={batch_id}")
        extract_relations(docs).write.mode("overwrite").parquet(f"{self.path}/relations/batch={batch_id}")

    def start(self, docs: DataFrame, checkpoint: str):
        """The running query over a streaming DataFrame."""
        return docs.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def nodes(self) -> DataFrame:
        """key, text, type, confidence, n_mentions over all batches so far."""
        rows = self.spark.read.parquet(f"{self.path}/mentions")
        by_type = rows.groupBy("key", "type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("first").alias("first"), F.min("base").alias("base"))
        merged = by_type.groupBy("key").agg(
            F.min(F.struct((-F.col("n")).alias("c"), "first", "type")).alias("t"),
            F.min("base").alias("base"), (F.sum("total") / F.sum("n")).alias("confidence"), F.sum("n").alias("n_mentions"),
        )
        return merged.select("key", F.col("base.text").alias("text"), F.col("t.type").alias("type"), F.round("confidence", 9).alias("confidence"), "n_mentions")

    def relations(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/relations").drop("batch")


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total of events(ts, event_type, value) in tumbling windows; with a watermark, so a
    streaming plan drops its state."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", length).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )
