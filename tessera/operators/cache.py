"""The semantic query cache as a table: lookup by cosine, store, eviction, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import get_settings
from . import dense

ENTRY = (
    "id string, query string, embedding array<double>, answer string, relevant_files array<string>, input_tokens int, output_tokens int, vector_count int, bm25_count int, "
    "graph_count int, query_entities array<string>, retrieval_ms double, hit_count int, created_at timestamp, last_hit_at timestamp"
)


def lookup(cache: DataFrame, queries: DataFrame, threshold: float | None = None) -> DataFrame:
    """(query_id, id, similarity): the nearest entry of each query (query_id, query, embedding), if it is near enough.

    Blank queries and queries without a vector miss.  Ties: the oldest entry, then the least id.
    """
    threshold = get_settings().semantic_cache_threshold if threshold is None else threshold
    q = queries.where("embedding is not null" + (" and trim(query) <> ''" if "query" in queries.columns else ""))
    found = dense.nearest(cache, q, 1, F.struct(F.col("created_at"), F.col("id")))  # one entry for each query and pair of blocks
    best = found.groupBy("query_id").agg(F.min(F.struct((-F.round("score", dense.DIGITS)).alias("far"), "key", "score")).alias("b"))
    return best.select("query_id", F.col("b.key.id").alias("id"), F.col("b.score").alias("similarity")).where(F.col("similarity") >= threshold)


def record_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """The cache with hit_count and last_hit_at of the entries hit (id) brought up."""
    n = hits.groupBy("id").agg(F.count("*").cast("int").alias("_n"))
    out = cache.join(n, "id", "left")
    out = out.withColumn("hit_count", (F.col("hit_count") + F.coalesce("_n", F.lit(0))).cast("int"))
    return out.withColumn("last_hit_at", F.when(F.col("_n").isNotNull(), F.current_timestamp()).otherwise(F.col("last_hit_at"))).select(*cache.columns)


def evict(cache: DataFrame, max_size: int | None = None) -> DataFrame:
    """The newest ``max_size`` entries; ties by id. The bound is a setting, so the kept rows are few."""
    max_size = get_settings().semantic_cache_max_size if max_size is None else max_size
    return cache.orderBy(F.desc("created_at"), F.desc("id")).limit(max_size)


def store(cache: DataFrame, rows: DataFrame, max_size: int | None = None) -> DataFrame:
    """Appends answered queries (without a vector they are left out) and evicts. Repeated queries are entries of their own."""
    default = {"hit_count": F.lit(0), "created_at": F.current_timestamp(), "id": F.expr("uuid()")}
    kinds = dict(c.split() for c in ENTRY.split(", "))
    ready = rows.where("embedding is not null").select(*[(F.col(c) if c in rows.columns else default.get(c, F.lit(None))).cast(kinds[c]).alias(c) for c in kinds])
    return evict(cache.unionByName(ready), max_size)


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("total_entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits"))


def invalidate(cache: DataFrame) -> tuple[DataFrame, int]:
    """(an empty cache, how many entries were deleted)."""
    return cache.limit(0), cache.count()

