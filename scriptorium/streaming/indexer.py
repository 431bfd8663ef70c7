"""Incremental indexing of a directory of markdown files by Structured Streaming.

Every micro-batch replaces the chunks of the files it brings. A batch is written under its
id, and replaying one writes the same rows again, so that a restart after a failure leaves
the table as if each batch had run once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators import segments
from scriptorium.operators.chunking import Strategy, chunk_files

STREAM_SCHEMA = "path string, markdown string"


def read_files(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """A stream of whole files: path (relative) and markdown."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), f"^(?:file:/+)?/*{root.strip('/')}/", "")
    return raw.select(path.alias("path"), F.col("value").alias("markdown"))


def start(files: DataFrame, target: str, checkpoint: str, strategy: Strategy = Strategy(), **trigger: object) -> StreamingQuery:
    """Chunk a stream of files (path, markdown) into batches below target."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        chunk_files(batch, strategy).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_index(files: DataFrame, base: str, checkpoint: str, name: str, strategy: Strategy = Strategy(), **trigger: object) -> StreamingQuery:
    """Publish every micro-batch of a stream of files (path, markdown) as a segment of the index at `base`.

    Of several versions of a file in one batch the last counts, by the column `modified` if there is one,
    else the greatest text; files with `deleted` true are removed. A batch takes effect once: its number goes
    into the version that it makes, under the stream's name, and a replay finds it there. Segments are merged
    as they come due. `segments.SegmentedIndex(spark, base)` is a version to search.
    """
    order = F.struct(*(F.col(c) for c in ("modified", "markdown") if c in files.columns))

    def take(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
        off = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        kept = last.where(~off)
        plan = F.struct(F.lit(strategy.chunk_by).alias("chunk_by"), F.lit(strategy.max_chunk_size).cast("int").alias("max_chunk_size"), F.lit(strategy.min_chunk_size).cast("int").alias("min_chunk_size"))
        own = [F.col(c) if c in batch.columns else v.alias(c) for c, v in (("strategy", plan), ("metadata", F.create_map().cast("map<string,string>")))]
        segments.sync(batch.sparkSession, base, kept.select("path", "markdown", *own), False, last.where(off).select("path"), name, batch_id)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """Chunks of the latest version of each file."""
    rows = spark.read.parquet(target)
    latest = rows.groupBy("filepath").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["filepath", "batch"], "left_semi").drop("batch")


def tool_event_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events (ts, event_type) by type and window, late ones up to the watermark."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


__all__ = ["current", "read_files", "start", "start_index", "tool_event_counts"]
