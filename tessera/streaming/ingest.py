"""Streaming: incremental registration of new files, and windowed statistics of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ids import content_hash, file_id
from ..operators import cache as caching
from ..operators import delta
from ..sources import tables
from ..sources.layers import Layout, Store


#: The registry that a stream keeps: a batch adds a layer of its own keys.
REGISTRY = {"registry": Layout(delta.REGISTRY, ("doc_id",), ("doc_id",))}


def registered(spark: SparkSession, registry_path: str) -> DataFrame:
    return Store(spark, registry_path, REGISTRY).snapshot().table("registry")


def register_batch(batch: DataFrame, registry_path: str) -> None:
    """Brings a registry up to (repo_name, file_path, content, and ts if there is one): of a file's versions the latest by ts counts.

    A version older than the registered one is ignored, so batches may come late, again or in any order.  Only the
    batch's own keys are read, where buckets allow it, and written.
    """
    store = Store(batch.sparkSession, registry_path, REGISTRY)
    empty = F.array().cast("array<string>")
    when = F.col("ts").cast("timestamp") if "ts" in batch.columns else F.current_timestamp()
    rows = batch.select(
        file_id("repo_name", "file_path").alias("doc_id"), "file_path", "repo_name", content_hash("content").alias("content_hash"),
        empty.alias("chunk_ids"), empty.alias("graph_node_ids"), when.alias("last_indexed_at"),
    )
    rows = delta.last_of(rows, "doc_id", F.desc_nulls_last("last_indexed_at"), F.desc_nulls_last("content_hash")).persist()
    change = store.begin()
    known = change.lookup("registry", rows.select("doc_id")).persist()
    try:
        before = known.select("doc_id", F.col("last_indexed_at").alias("_at"), F.col("content_hash").alias("_hash"))
        later = (F.col("last_indexed_at") > F.col("_at")) | ((F.col("last_indexed_at") == F.col("_at")) & (F.col("content_hash") >= F.col("_hash")))
        rows_now = rows.join(before, "doc_id", "left").where(F.col("_at").isNull() | later).drop("_at", "_hash")
        merged = delta.upsert(known.join(rows_now.select("doc_id"), "doc_id", "left_semi"), rows_now)
        change.replace_groups("registry", merged.select("doc_id"), merged)
        change.commit()
    except BaseException:
        change.abort()
        raise
    finally:
        rows.unpersist()
        known.unpersist()


def register_stream(files: DataFrame, registry_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a registry up to a stream of files; replayed batches change nothing."""
    stream = files.writeStream.foreachBatch(lambda batch, _: register_batch(batch, registry_path))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cached_answers(questions: DataFrame, cache: DataFrame, threshold: float | None = None) -> DataFrame:
    """(query_id, id, similarity, answer) of questions (query_id, query, embedding) that the cache answers."""
    hits = caching.lookup(cache, questions, threshold)
    return hits.join(cache.select("id", "answer"), "id").select("query_id", "id", "similarity", "answer")


def answer_stream(questions: DataFrame, cache_path: str, out_path: str, checkpoint: str, threshold: float | None = None) -> StreamingQuery:
    """A stream of questions against the stored cache as it is when a batch comes; a replayed batch overwrites its own answers."""

    def apply(batch: DataFrame, number: int) -> None:
        cache = tables.open_table(batch.sparkSession, cache_path, caching.ENTRY)
        cached_answers(batch, cache, threshold).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return questions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) in windows of event time; works on streams and tables."""
    by = events.withColumn("ts", F.col("ts").cast("timestamp"))
    by = by.withWatermark("ts", late) if events.isStreaming else by
    return by.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, n) of sessions that end after a gap."""
    by = events.withColumn("ts", F.col("ts").cast("timestamp"))
    by = by.withWatermark("ts", late) if events.isStreaming else by
    return by.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
