"""The engine's service functions, without HTTP: health, readiness, statistics, traversal, cache, viewer, authorisation."""

from __future__ import annotations

import hmac
import time

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache as caching
from ..operators import chunks, graph, traverse, viewer
from ..settings import get_settings
from .index import Index, IndexResult
from .index import run as run_index
from .jobs import Jobs

_JOBS: dict[str, Jobs] = {}


def health() -> dict:
    return {"status": "ok"}


def ready(index: Index) -> dict:
    found = index.exists()
    return {"status": "ready" if found else "not_ready", "checks": {"index": found}}


def authorise(header: str | None, key: str | None = None) -> int:
    """200 if the bearer token is the key (by default the settings' one) or no key is set, 401 without a token, 403 with a wrong one."""
    key = key or get_settings().api_key
    if not key:
        return 200
    if not header or not header.startswith("Bearer "):
        return 401
    return 200 if hmac.compare_digest(header[7:].encode(), key.encode()) else 403


def index_stats(index: Index) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, chunks by repository in order)."""
    table = index.table("chunks")
    return chunks.index_stats(table), table.groupBy("repo_name").agg(F.count("*").alias("chunks")).orderBy("repo_name")


def graph_stats(index: Index) -> DataFrame:
    return graph.graph_stats(index.graph(), index.table("edges"))


def start_index(spark: SparkSession, **options) -> str:
    """Starts an indexing job in the background and returns its id for :func:`index_status`; :class:`.jobs.Busy` while another runs.

    The job's record is beside the index, so other drivers see it too (:meth:`.jobs.Jobs.status`).
    """
    jobs = Jobs(spark, options.get("index_dir") or get_settings().index_dir)
    job = jobs.claim()
    _JOBS[job] = jobs
    over = jobs.renewing(job)

    def work() -> None:
        try:
            result: IndexResult = run_index(spark, **options)
            jobs.end(job, status="completed", result=vars(result))
        except Exception as e:  # the job's record tells; callers poll
            jobs.end(job, status="failed", error=str(e))
        finally:
            over.set()

    InheritableThread(target=work, name=f"index-{job[:8]}", daemon=True).start()
    return job


def wait(job: str, seconds: float = 600.0) -> dict:
    """The job's record once it has ended, or as it is after so many seconds."""
    end = time.monotonic() + seconds
    while index_status(job)["status"] == "running" and time.monotonic() < end:
        time.sleep(0.1)
    return index_status(job)


def index_status(job: str) -> dict:
    if job not in _JOBS:
        raise KeyError(f"unknown job {job}")
    found = _JOBS[job].status(job)
    return found | {"result": IndexResult(**found["result"])} if "result" in found else found


def graph_traverse(index: Index, entity: str, hops: int = 2) -> dict[str, DataFrame]:
    """Matches, related files and summary of one entity; at most three hops are asked for, and two are taken."""
    spark = index.spark
    g, edges = index.graph(), index.table("edges")
    asked = spark.createDataFrame([("0", entity)], "query_id string, entity string")
    matches = traverse.find_nodes(asked, g["classes"], g["functions"], g["endpoints"])
    files = traverse.related_files(matches, g["files"], edges, min(hops, 3))
    return {"matches": matches, "related_files": files.orderBy("file_path"), "summary": traverse.summarise(matches, traverse.methods_of(matches, g["functions"], edges))}


def viewer_nodes(index: Index) -> DataFrame:
    """(id, type, label, repo_name, file_path) of all vertices."""
    g, null = index.graph(), F.lit(None).cast("string")
    rows = [
        g["repos"].select(F.col("repo_id").alias("id"), F.lit("Repo").alias("type"), F.col("name").alias("label"), F.col("name").alias("repo_name"), null.alias("file_path")),
        g["files"].select(F.col("file_id").alias("id"), F.lit("File").alias("type"), F.col("file_name").alias("label"), "repo_name", "file_path"),
        g["classes"].select(F.col("class_id").alias("id"), F.lit("Class").alias("type"), F.col("name").alias("label"), "repo_name", "file_path"),
        g["functions"].select(F.col("function_id").alias("id"), F.lit("Function").alias("type"), F.col("qualified_name").alias("label"), "repo_name", "file_path"),
        g["endpoints"].select(F.col("endpoint_id").alias("id"), F.lit("APIEndpoint").alias("type"), F.concat_ws(" ", "http_method", "path_pattern").alias("label"), "repo_name", "file_path"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def graph_data(index: Index, max_nodes: int = 200, repo: str | None = None) -> dict[str, DataFrame]:
    nodes, edges = viewer.subgraph(viewer_nodes(index), index.table("edges").select("type", "src", "dst"), max_nodes, repo)
    return {"nodes": nodes, "edges": edges, "stats": viewer.stats(nodes, edges)}


def invalidate_cache(index: Index) -> int:
    """Empties the stored cache; how many entries went."""
    empty, n = caching.invalidate(index.table("cache"))
    index.put_cache(empty)
    return n
