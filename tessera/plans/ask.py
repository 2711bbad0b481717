"""Answering: cache, hybrid retrieval, reranking, curation, prompt, answer, trace. A batch of questions is one plan."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import Embedder, extractive_answer, hashing_embedder, overlap_reranker
from ..logs import cut, get_logger
from ..operators import cache as caching
from ..operators import search, traverse
from ..settings import get_settings
from ..sources import tables
from .index import Index

#: Answers of a batch that are logged.
LOGGED = 20
log = get_logger("ask")
NOTHING = "No relevant code was found for this question."


def retrieve(index: Index, queries: DataFrame, top_k: int | None = None, repo: str | None = None, use_graph: bool = True, use_bm25: bool = True, key: str = "content_hash", embedder: Embedder | None = None) -> DataFrame:
    """Fused results (query_id, rank, score, found, chunk columns) of queries (query_id, query): up to three lists of one plan, all from stored tables.

    found: how many rows the dense, the sparse and the graph's list have, 0 for a list that isn't asked for.
    """
    s = get_settings()
    top_k, embedder = top_k or s.top_k_results, embedder or hashing_embedder()
    chunks = index.table("chunks")
    scope = None if repo is None else F.col("repo_name") == repo
    lists = [search.vector_search(chunks, queries.withColumn("embedding", embedder(F.col("query"))), s.vector_top_k, scope=scope)]
    if use_bm25:
        lists.append(search.bm25_search(index.bm25(), queries, s.bm25_top_k, None if scope is None else chunks.where(scope)))
    if use_graph:
        g, edges = index.graph(), index.table("edges")
        matches = traverse.find_nodes(traverse.extract_entities(queries, index.table("names")), g["classes"], g["functions"], g["endpoints"])
        related = traverse.related_files(matches, g["files"], edges, s.graph_max_hops)
        lists.append(search.graph_chunks(chunks if scope is None else chunks.where(scope), related, top_k))
    keyed = chunks.select("chunk_id", (F.col("chunk_id") if key == "chunk_id" else search.fusion_key(key)).alias("key"))
    # what was found is small beside the chunks, which stay where they are
    fused = search.rrf_fuse([keyed.join(search._bounded(d), "chunk_id") for d in lists], top_k, counts=True)
    asked = [True, use_bm25, use_graph]
    spread = [F.col("found")[sum(asked[:i])] if asked[i] else F.lit(0) for i in range(3)]
    fused = fused.withColumn("found", F.array(*[c.cast("int") for c in spread]))
    shown = chunks.select("chunk_id", "repo_name", "file_path", "content")
    return shown.join(search._bounded(fused), "chunk_id").join(queries.select("query_id", "query"), "query_id")


def graph_context(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, query_entities, graph_summary) of the graph's findings."""
    g, edges = index.graph(), index.table("edges")
    entities = traverse.extract_entities(queries, index.table("names"))
    matches = traverse.find_nodes(entities, g["classes"], g["functions"], g["endpoints"])
    summary = traverse.summarise(matches, traverse.methods_of(matches, g["functions"], edges))
    named = entities.groupBy("query_id").agg(F.array_sort(F.collect_set("entity")).alias("query_entities"))
    return named.join(summary.withColumnRenamed("summary", "graph_summary"), "query_id", "left")


def curate(results: DataFrame, kept: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, summary, relevant_files, chunk_count). kept(chunk list) gives a curator's raw JSON; what it names is kept, or all."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "file_path", "content")))
    found = F.first("found") if "found" in results.columns else F.lit(None).cast("array<int>")
    by = results.groupBy("query_id").agg(rows.alias("r"), F.first("query").alias("query"), found.alias("found"))
    files = F.array_distinct(F.transform("r", lambda x: x["file_path"]))
    plain = F.array_join(F.transform("r", lambda x: x["content"]), "\n\n")
    if kept is None:
        return by.select("query_id", "query", plain.alias("summary"), files.alias("relevant_files"), F.size("r").alias("chunk_count"), "found")
    from ..functions.text import json_object

    shape = "summary string, relevant_files array<string>, kept_chunk_indices array<int>"
    out = by.withColumn("j", F.from_json(json_object(kept(chunk_list(F.col("r")))), shape))
    chosen = F.filter(F.col("r"), lambda x, i: F.array_contains(F.col("j.kept_chunk_indices"), i))
    return out.select(
        "query_id",
        "query",
        F.when(F.col("j").isNull(), plain).otherwise(F.coalesce("j.summary", F.lit(""))).alias("summary"),
        F.when(F.col("j").isNull(), files).otherwise(F.coalesce("j.relevant_files", F.array().cast("array<string>"))).alias("relevant_files"),
        F.when(F.col("j.kept_chunk_indices").isNull(), F.size("r")).otherwise(F.size(chosen)).alias("chunk_count"),
        "found",
    )


def chunk_list(rows: Column) -> Column:
    """Numbered chunks as a curator reads them: at most 600 characters of each."""
    one = lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] ("), x["file_path"], F.lit(")\n"), F.substring(x["content"], 1, 600))
    return F.array_join(F.transform(rows, one), "\n\n---\n\n")


def prompt(question: Column, summary: Column, graph: Column, files: Column) -> Column:
    """What an answering model is given: the question, where to look, and the material."""
    part = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), body))
    return F.concat_ws("\n\n", part("Question", question), part("Files", F.array_join(files, "\n")), part("Known from the graph", graph), part("Code", summary))


def token_count(text: Column) -> Column:
    """An estimate of a text's tokens, for models that don't report them: its runs of letters, digits and other characters."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\w+|[^\w\s]+"), 0))


def run(index: Index, queries: DataFrame, cache: DataFrame | None = None, top_k: int | None = None, repo: str | None = None, use_graph: bool | None = None, use_bm25: bool | None = None, embedder: Embedder | None = None, reranker=overlap_reranker, answer=extractive_answer) -> DataFrame:
    """One row for each query (query_id, query): answer, relevant_files, counts, cache_hit, prompt."""
    s = get_settings()
    use_graph, use_bm25 = s.use_graph if use_graph is None else use_graph, s.use_bm25 if use_bm25 is None else use_bm25
    top_k, embedder = top_k or s.top_k_results, embedder or hashing_embedder()
    asked = queries.select("query_id", "query").withColumn("embedding", embedder(F.col("query")))
    hits = None
    if cache is not None and s.use_semantic_cache:
        hits = caching.lookup(cache, asked).join(cache.select("id", "answer", "relevant_files"), "id").persist()
        todo = asked.join(hits.select("query_id"), "query_id", "left_anti")
    else:
        todo = asked
    found = retrieve(index, todo, top_k, repo, use_graph, use_bm25, embedder=embedder)
    curated = curate(search.rerank(found, reranker if s.use_reranker else None, top_k))
    full = todo.join(curated.drop("query"), "query_id", "left")
    full = full.join(graph_context(index, todo), "query_id", "left") if use_graph else full.withColumns({"query_entities": F.lit(None).cast("array<string>"), "graph_summary": F.lit(None).cast("string")})
    return _answers(full, hits, asked, answer)


def _answers(full: DataFrame, hits: DataFrame | None, asked: DataFrame, answer) -> DataFrame:
    none = F.array().cast("array<string>")
    got = F.col("chunk_count").isNotNull()
    graph = F.col("graph_summary")
    count = lambda i: F.coalesce(F.col("found")[i], F.lit(0))
    out = full.select(
        "query_id",
        "query",
        F.when(got, answer(F.col("query"), F.col("summary"))).otherwise(F.lit(NOTHING)).alias("answer"),
        F.coalesce("relevant_files", none).alias("relevant_files"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunks"),
        F.coalesce("query_entities", none).alias("query_entities"),
        *[count(i).alias(f"{n}_count") for i, n in enumerate(("vector", "bm25", "graph"))],
        F.lit(False).alias("cache_hit"),
        F.when(got, prompt(F.col("query"), F.col("summary"), graph, F.col("relevant_files"))).alias("prompt"),
        "embedding",
        F.lit(None).cast("string").alias("cache_id"),
    )
    out = out.withColumns({"input_tokens": token_count(F.col("prompt")), "output_tokens": F.when(got_answer(), token_count(F.col("answer"))).otherwise(F.lit(0))})
    if hits is None:
        return out
    zero, null = F.lit(0), F.lit(None).cast("string")
    kept = hits.join(asked, "query_id").select(
        "query_id", "query", "answer", "relevant_files", zero.alias("chunks"), none.alias("query_entities"), *[zero.alias(f"{n}_count") for n in ("vector", "bm25", "graph")],
        F.lit(True).alias("cache_hit"), null.alias("prompt"), "embedding", F.col("id").alias("cache_id"), zero.alias("input_tokens"), zero.alias("output_tokens"),
    )
    return out.unionByName(kept)


def got_answer() -> Column:
    return ~F.col("cache_hit") & (F.col("chunks") > 0)


def answer(index: Index, queries: DataFrame, repo: str | None = None, trace_path: str | None = None, **options) -> DataFrame:
    """Answers through the stored cache and brings it up: hits are counted, new answers stored, the oldest entries go; what was answered is traced."""
    s, began = get_settings(), time.perf_counter()
    cache = index.table("cache") if s.use_semantic_cache else None
    rows = run(index, queries, cache, repo=repo, **options).persist()
    rows.count()
    spent = F.lit(1000 * (time.perf_counter() - began))
    rows = rows.withColumns({"retrieval_ms": F.when(got_answer(), spent).otherwise(F.lit(0.0)), "llm_ms": F.lit(0.0)})
    if cache is not None:
        counted = caching.record_hits(cache, rows.where("cache_hit").select(F.col("cache_id").alias("id")))
        index.put_cache(caching.store(counted, rows.where(got_answer())))
    tables.append_traces(traces(rows, repo), trace_path or f"{index.path}/traces")
    for r in rows.select("query", "answer", "cache_hit", "chunks").limit(LOGGED).collect():
        log.info("answered", extra={"query": cut(r["query"], 80), "answer": cut(r["answer"]), "cache_hit": r["cache_hit"], "chunks": r["chunks"]})
    return rows


def traces(results: DataFrame, repo: str | None = None) -> DataFrame:
    """What a trace records of answered queries; cache hits and empty results aren't traced. Times are rounded to hundredths."""
    number = lambda c, default="0": F.coalesce(F.col(c), F.expr(default)) if c in results.columns else F.expr(default)
    return results.where(got_answer()).select(
        F.expr("uuid()").alias("query_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        "query",
        F.lit(repo).cast("string").alias("repo_name"),
        *[number(c).cast("int").alias(c) for c in ("vector_count", "bm25_count", "graph_count")],
        F.col("chunks").alias("total_fused_chunks"),
        F.col("query_entities").alias("graph_entities"),
        "relevant_files",
        *[F.round(number(c, "0.0").cast("double"), 2).alias(c) for c in ("retrieval_ms", "llm_ms")],
        *[number(c).cast("int").alias(c) for c in ("input_tokens", "output_tokens")],
    )
