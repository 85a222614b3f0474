"""Windows over events and the arrival of new documents, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.operators.chunking import chunks
from docweave.operators.extraction import graph_of
from docweave.operators.store import temporary_tables
from docweave.sources.files import write_graph_batch


def _timed(events: DataFrame, late: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total`` of tumbling or sliding windows; a stream drops what comes later than ``late``."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = _timed(events, late).groupBy(window.alias("_w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("_w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """``user_id, start, n`` of sessions that end after a gap."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("_w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("_w.start").alias("start"), "n")


def first_arrivals(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key, as far as the watermark remembers."""
    timed = _timed(events, late)
    return timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)


def ingest(spark: SparkSession, source: str, schema: str, target: str, limit: int = 650, entities: bool = False) -> StreamingQuery:
    """New Parquet files of documents as Document and Chunk nodes with CONTAINS edges, added to a graph; with ``entities``, as all that ``graph_of`` finds in their chunks.

    Takes what is there and ends; a checkpoint beside the graph remembers which files were taken. Each batch of
    files is one numbered batch of the graph, so a run that fails and starts again adds nothing twice.
    """
    arriving = spark.readStream.schema(schema).parquet(source)

    def plain(docs: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        key = F.concat(F.lit("document_"), F.col("doc_id").cast("string"))
        chunk = F.concat(F.lit("chunk_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("chunk_id").cast("string"))
        nothing = F.lit(None).cast("string")
        nodes = docs.select(key.alias("id"), F.lit("Document").alias("label"), F.col("source").alias("name"), nothing.alias("text"))
        nodes = nodes.unionByName(parts.select(chunk.alias("id"), F.lit("Chunk").alias("label"), nothing.alias("name"), F.col("content").alias("text")))
        return nodes, parts.select(key.alias("src"), chunk.alias("dst"), F.lit("CONTAINS").alias("type"))

    def add(docs: DataFrame, batch: int) -> None:
        with temporary_tables():
            parts = chunks(docs.select("doc_id", "text"), limit)
            found = graph_of(parts.select(F.col("doc_id").cast("string").alias("document"), "chunk_id", "content")) if entities else plain(docs, parts)
            write_graph_batch(*found, target, batch)

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", f"{target}/_arrivals").trigger(availableNow=True).start()
