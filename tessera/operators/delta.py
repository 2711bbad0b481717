"""Registry of indexed files: change detection, upsert, deletion, statistics. Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import content_hash, file_id

REGISTRY = "doc_id string, file_path string, repo_name string, content_hash string, chunk_ids array<string>, graph_node_ids array<string>, last_indexed_at timestamp"


def with_ids(files: DataFrame) -> DataFrame:
    """Adds _doc_id and _content_hash to files (repo_name, file_path, content or content_hash)."""
    given = F.col("content_hash") if "content_hash" in files.columns else content_hash("content")
    return files.withColumn("_doc_id", file_id("repo_name", "file_path")).withColumn("_content_hash", given)


def filter_changed(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files that the registry doesn't have with the same hash."""
    known = registry.select(F.col("doc_id").alias("_doc_id"), F.col("content_hash").alias("_known"))
    changed = with_ids(files).join(known, "_doc_id", "left").where(~F.col("_known").eqNullSafe(F.col("_content_hash")))
    return changed.drop("_known")


def unchanged(files: DataFrame, registry: DataFrame) -> DataFrame:
    known = registry.select(F.col("doc_id").alias("_doc_id"), F.col("content_hash").alias("_content_hash"))
    return with_ids(files).join(known, ["_doc_id", "_content_hash"], "left_semi")


def last_of(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """Inserts or updates by doc_id. Paths and repositories of known rows stay; null arrays leave what is there.

    Of rows with one doc_id the last by last_indexed_at counts, then the one with the greatest hash.
    """
    empty = F.array().cast("array<string>")
    r, n = registry.alias("r"), last_of(rows, "doc_id", F.desc_nulls_last("last_indexed_at"), F.desc_nulls_last("content_hash")).alias("n")
    both = r.join(n, F.col("r.doc_id") == F.col("n.doc_id"), "full_outer")
    old_wins = lambda c: F.coalesce(F.col(f"r.{c}"), F.col(f"n.{c}")).alias(c)
    new_wins = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"r.{c}")).alias(c)
    return both.select(
        old_wins("doc_id"),
        old_wins("file_path"),
        old_wins("repo_name"),
        new_wins("content_hash"),
        *[F.coalesce(F.col(f"n.{c}"), F.col(f"r.{c}"), empty).alias(c) for c in ("chunk_ids", "graph_node_ids")],
        new_wins("last_indexed_at"),
    )


def set_graph_nodes(registry: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replaces graph_node_ids of known files by (doc_id, graph_node_ids); unknown ids are ignored."""
    new = nodes.select("doc_id", F.col("graph_node_ids").alias("_new"))
    return registry.join(new, "doc_id", "left").withColumn("graph_node_ids", F.coalesce("_new", "graph_node_ids")).drop("_new").select(*registry.columns)


def deregister(registry: DataFrame, gone: DataFrame) -> DataFrame:
    """The registry without the doc_ids given."""
    return registry.join(gone.select("doc_id"), "doc_id", "left_anti")


def vanished(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Registered files that are no longer there."""
    return registry.join(with_ids(files).select(F.col("_doc_id").alias("doc_id")), "doc_id", "left_anti")


def ids_of(registry: DataFrame, doc_id: str, column: str = "chunk_ids") -> list[str]:
    """A point lookup; [] for an unknown file."""
    row = registry.where(F.col("doc_id") == doc_id).select(column).first()
    return list(row[0] or []) if row else []


def stats(registry: DataFrame) -> DataFrame:
    """Per repository and, under a null one, in total: files and last_indexed_at. One pass."""
    return registry.rollup("repo_name").agg(F.count("*").alias("files"), F.max("last_indexed_at").alias("last_indexed_at"))


def clear(registry: DataFrame) -> DataFrame:
    return registry.limit(0)
