"""Indexing: files to registry, chunks with vectors, graph and links; incremental by content hash.

All tables but the cache are under one manifest (:mod:`..sources.layers`): a run's changes appear together or not
at all, and a run writes in proportion to the files that changed.  Edges are resolved by delta joins: stored tables of
the names and paths that files look for tell which unchanged files a change can affect, and only these are resolved again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.models import Embedder, hashing_embedder
from ..operators import cache as caching
from ..operators import chunks as chunking
from ..operators import delta, drift, graph, linker, search, symbols, traverse
from ..settings import get_settings
from ..sources import repos, tables
from ..sources.layers import Change, Layout, Snapshot, Store


@dataclass(frozen=True)
class IndexResult:
    total_files: int
    changed_files: int
    removed_files: int
    total_chunks: int
    graph_nodes: int
    graph_edges: int
    drift: str

    def counters(self) -> dict[str, int]:
        """The batch's totals by name."""
        return {k: v for k, v in vars(self).items() if isinstance(v, int)}


CHUNKS = (
    "repo_name string, file_path string, file_name string, file_type string, language string, content_hash string, size_bytes long, git_commit_sha string, git_last_modified_at string, "
    "git_last_modified_by string, chunk_index int, content string, start_index int, symbol_name string, symbol_type string, start_line int, end_line int, docstring string, sub_chunk int, "
    "chunk_id string, embedding array<double>"
)


SYMBOLS = f"repo_name string, file_path string, language string, seq int, {symbols.RECORD}"
FILE = ("repo_name", "file_path")


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


_FILE = "repo_name string, file_path string"
#: Each table, the columns whose rows change together, and those that a row is found by.
LAYOUTS = {
    "chunks": Layout(CHUNKS, FILE, FILE),
    "postings": Layout(f"term string, chunk_id string, tf long, dl long, head boolean, {_FILE}", FILE, ("term",), search.BUCKETS),
    "terms": Layout("term string, df long", ("term",), ("term",)),
    "bm25_stats": Layout("n_chunks long, total_length long, mean_idf double", (), ("n_chunks",)),
    "symbols": Layout(SYMBOLS, FILE, FILE),
    "classes": Layout(graph.SCHEMAS["classes"], FILE, FILE),
    "functions": Layout(graph.SCHEMAS["functions"], FILE, FILE),
    "endpoints": Layout(graph.SCHEMAS["endpoints"], FILE, FILE),
    "files": Layout(graph.SCHEMAS["files"], FILE, FILE),
    "repos": Layout(graph.SCHEMAS["repos"], ("repo_id",), ("repo_id",)),
    "edges": Layout(f"{graph.EDGE}, owner string, part string", ("owner", "part"), ("owner",)),
    "names": Layout(f"kind string, name string, {_FILE}", FILE, FILE),
    "class_names": Layout("repo_name string, name string, class_id string, file_path string", FILE, ("repo_name", "name")),
    "parents": Layout("repo_name string, parent string, file_path string", FILE, ("repo_name", "parent")),
    "tails": Layout("repo_name string, tail string, file_path string", FILE, ("repo_name", "tail")),
    "imports": Layout("repo_name string, tail string, file_path string", FILE, ("repo_name", "tail")),
    "calls": Layout(f"{_FILE}, kind string, value string", FILE, FILE),
    "registry": Layout(delta.REGISTRY, ("doc_id",), ("doc_id",)),
    "fingerprint": Layout(drift.FINGERPRINT, (), ("model_name",)),
}


class Index:
    """The stored tables below one directory, as they were when they were first read; :meth:`refresh` sees later changes."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or get_settings().index_dir).rstrip("/")
        self.store = Store(spark, self.path, LAYOUTS)
        self._seen: Snapshot | None = None

    def refresh(self) -> Index:
        self._seen = None
        return self

    @property
    def snapshot(self) -> Snapshot:
        if self._seen is None or not self._seen.number:
            self._seen = self.store.snapshot()
        return self._seen

    def table(self, name: str) -> DataFrame:
        if name == "cache":  # answers come and go between indexing runs
            return tables.open_table(self.spark, f"{self.path}/cache", caching.ENTRY)
        found = self.snapshot.table(name)
        if name == "names":
            return found.select("kind", "name").distinct()
        return found.select(*columns(graph.EDGE)) if name == "edges" else found

    def exists(self) -> bool:
        return self.snapshot.has("chunks")

    def graph(self) -> dict[str, DataFrame]:
        return {k: self.table(k) for k in graph.SCHEMAS}

    def put_cache(self, df: DataFrame) -> None:
        tables.publish(df, f"{self.path}/cache")

    def bm25(self) -> search.Bm25Index:
        """The stored postings and terms: a question reads its own terms' buckets."""
        stats = self.table("bm25_stats").first()
        if stats is None:
            raise FileNotFoundError(f"no index at {self.path}; build the index first")
        terms = self.table("terms").select("term", "df", search.lifted(search.raw_idf(stats["n_chunks"]), stats["mean_idf"] or 0.0).alias("idf"))
        return search.Bm25Index(self.snapshot.table("postings", with_bucket="bucket"), terms, stats["n_chunks"], stats["total_length"] / stats["n_chunks"] if stats["n_chunks"] else 0.0)

    def file_counters(self) -> DataFrame:
        """(repo_name, file_path, classes, functions, endpoints, edges): what each file gave to the graph; their sums are the graph's totals but for repositories and files."""
        count = lambda rows, name, *by: rows.groupBy(*by).agg(F.count("*").alias(name))
        out = self.table("files").select(*FILE, "file_id")
        for kind in ("classes", "functions", "endpoints"):
            out = out.join(count(self.table(kind), kind, *FILE), [*FILE], "left")
        out = out.join(count(self.snapshot.table("edges"), "edges", F.col("owner").alias("file_id")), "file_id", "left")
        return out.select(*FILE, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("classes", "functions", "endpoints", "edges")])


def put_bm25(change: Change, fresh: DataFrame, gone: DataFrame, stale: DataFrame, hold: Callable[[DataFrame], DataFrame], files: int = 0) -> None:
    """Postings of the files in ``stale`` (about so many) are now those of the fresh chunks; gone: the chunks that these files had. Terms and totals follow by difference."""
    postings = search.postings_of(fresh, keep=FILE).select(*LAYOUTS["postings"].columns)
    df = lambda rows, sign: rows.where("term is not null").select("term", F.lit(sign).alias("d"))
    each = lambda rows, sign: rows.where("head").select(F.lit(sign).alias("n"), (F.col("dl") * sign).alias("dl"))
    totals = lambda rows: rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    if not change.has("postings"):  # texts are read once, and the rest follows from what was written
        change.replace("postings", postings, files)
        new = change.table("postings")
        terms = hold(df(new, 1).groupBy("term").agg(F.sum("d").alias("df")))
        change.replace("terms", terms, groups=terms.count())
        n, total = totals(each(new, 1))
    else:
        new, old = postings, search.postings_of(gone, keep=FILE)
        touched = hold(df(new, 1).unionByName(df(old, -1)).groupBy("term").agg(F.sum("d").alias("d")).where("d <> 0"))
        n, total = totals(each(new, 1).unionByName(each(old, -1)))
        before = change.table("bm25_stats").first()
        n, total = n + before["n_chunks"], total + before["total_length"]
        change.replace_groups("postings", stale, postings)
        known = change.lookup("terms", touched.select("term"))
        now = touched.join(known, "term", "left").select("term", (F.coalesce("df", F.lit(0)) + F.col("d")).alias("df")).where("df > 0")
        change.replace_groups("terms", touched, now)
    mean = change.table("terms").agg(F.avg(search.raw_idf(n))).first()[0] or 0.0
    change.replace("bm25_stats", change.spark.createDataFrame([(n, total, float(mean))], LAYOUTS["bm25_stats"].schema))


def run(spark: SparkSession, files: DataFrame | None = None, index_dir: str | None = None, reindex: bool = False, use_graph: bool | None = None, embedder: Embedder | None = None, model_name: str = "hashing-64") -> IndexResult:
    """Brings the index up to the files: only changed ones are parsed, chunked, embedded and posted, vanished ones go.

    A run that fails leaves the index as it was; of two runs that overlap the later to end fails with a
    :class:`..sources.layers.Conflict`, and may be run again.
    """
    store = Store(spark, (index_dir or get_settings().index_dir).rstrip("/"), LAYOUTS)
    change = store.begin()
    if reindex:
        change = Change(store, change.number, {k: v for k, v in change._tables.items() if k == "fingerprint"})
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    try:
        result = _bring_up(change, repos.load_repos(spark) if files is None else files, hold, get_settings().use_graph if use_graph is None else use_graph, embedder or hashing_embedder(), model_name, reindex)
        change.commit()
    except BaseException:
        change.abort()
        raise
    finally:
        for df in held:
            df.unpersist()
    return result


def _bring_up(change: Change, files: DataFrame, hold: Callable[[DataFrame], DataFrame], use_graph: bool, embedder: Embedder, model_name: str, reindex: bool) -> IndexResult:
    spark = change.spark
    probe = spark.range(1).select(embedder(F.lit(drift.PROBE)).alias("probe_embedding"))
    verdict = drift.check(change.table("fingerprint"), probe, model_name).first()["reason"]

    registry = change.table("registry")
    listed = hold(delta.with_ids(files).select(*FILE, "content_hash"))
    changed = hold(delta.filter_changed(files, registry))
    gone = hold(delta.vanished(registry, listed).select("doc_id", *FILE))
    n_files, n_changed, n_gone = listed.count(), changed.count(), gone.count()
    if not (n_changed or n_gone) and change.has("chunks") and (change.has("files") or not use_graph):
        return _result(change, n_files, 0, 0, use_graph, verdict)
    stale = hold(changed.select(*FILE).unionByName(gone.select(*FILE)).distinct())

    def put(name: str, rows: DataFrame, groups: DataFrame = stale) -> None:
        """What the stale files have in a table; the first time, all of it."""
        if change.has(name):
            change.replace_groups(name, groups, rows)
        else:
            change.replace(name, rows, groups=n_changed)

    fresh = hold(chunking.split_documents(changed).drop("_doc_id", "_content_hash").withColumn("embedding", embedder(F.col("content"))))
    old = hold(change.lookup("chunks", stale).select("chunk_id", "content", *FILE))
    fresh.count()  # once, for the tables that are written side by side
    change.together(lambda: put_bm25(change, fresh, old, stale, hold, n_changed), lambda: put("chunks", fresh.select(*columns(CHUNKS))))

    node_ids = None
    if use_graph:
        node_ids = _graph(change, changed, gone, stale, fresh, registry, put, hold)

    rows = changed.select(F.col("_doc_id").alias("doc_id"), "file_path", "repo_name", F.col("_content_hash").alias("content_hash"))
    rows = rows.join(chunking.chunk_ids_per_file(fresh), "doc_id", "left").withColumn("last_indexed_at", F.current_timestamp())
    rows = rows.join(node_ids, "doc_id", "left") if node_ids is not None else rows.withColumn("graph_node_ids", F.lit(None).cast("array<string>"))
    touched = hold(changed.select(F.col("_doc_id").alias("doc_id")).unionByName(gone.select("doc_id")).distinct())
    known = delta.deregister(change.lookup("registry", touched), gone)
    put("registry", delta.upsert(known, rows), touched)
    if reindex or verdict == "no_fingerprint":
        change.replace("fingerprint", drift.record(probe, model_name))
    return _result(change, n_files, n_changed, n_gone, use_graph, verdict)


def _result(change: Change, n_files: int, n_changed: int, n_gone: int, use_graph: bool, verdict: str) -> IndexResult:
    nodes = sum(change.table(k).count() for k in graph.SCHEMAS) if use_graph else 0
    edges = change.table("edges").count() if use_graph else 0
    return IndexResult(n_files, n_changed, n_gone, change.table("chunks").count(), nodes, edges, verdict)


def _graph(change: Change, changed: DataFrame, gone: DataFrame, stale: DataFrame, fresh: DataFrame, registry: DataFrame, put: Callable, hold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Symbols, vertices and edges of the stale files, and the edges of other files that they affect; (doc_id, graph_node_ids) of changed files."""
    parsed = hold(symbols.extract_symbols(changed))
    was = hold(change.lookup("classes", stale).select("repo_name", F.col("name").alias("parent")))
    parsed.count()
    was.count()
    vertices = {kind: hold(graph.upsert_vertices(change.table(kind).limit(0), rows, kind)) for kind, rows in graph.vertices_of(parsed).items()}
    classes, functions, endpoints = (vertices[k] for k in ("classes", "functions", "endpoints"))
    rows = changed.select(F.col("_doc_id").alias("file_id"), *FILE, "file_name", "language", "content_hash", "size_bytes")
    rows = rows.join(chunking.chunk_ids_per_file(fresh).withColumnRenamed("doc_id", "file_id"), "file_id", "left").withColumn("last_indexed_at", F.current_timestamp())
    seen = changed.select(ids.repo_id("repo_name").alias("repo_id"), F.col("repo_name").alias("name"), F.lit(None).cast("string").alias("local_path")).distinct().withColumn("last_indexed_at", F.current_timestamp())
    named = lambda rows, kind, name: rows.where(F.col(name).isNotNull()).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), *FILE)
    made = {
        **vertices,
        "files": rows.select(*columns(graph.SCHEMAS["files"])),
        "symbols": parsed.select(*columns(SYMBOLS)),
        "names": named(classes, "Class", "name").unionByName(named(functions, "Function", "name")).unionByName(named(endpoints, "APIEndpoint", "path_pattern")).distinct(),
        "class_names": classes.select(*LAYOUTS["class_names"].columns),
        "parents": graph.parents_wanted(parsed),
        "tails": graph.path_tails(changed),
        "imports": graph.imports_wanted(parsed),
        "calls": linker.calls_of(changed),
    }
    put_repos = lambda: put("repos", graph.upsert_vertices(change.lookup("repos", seen.select("repo_id")), seen, "repos"), seen.select("repo_id"))
    change.together(put_repos, *[partial(put, name, own) for name, own in made.items()])

    # whose edges may differ: those of changed files, and of files that look for a name or a path that came or went
    now = changed.select(*FILE)
    names = was.unionByName(classes.select("repo_name", F.col("name").alias("parent"))).distinct()
    heirs = hold(now.unionByName(change.lookup("parents", names).select(*FILE)).distinct())
    known = registry.select(*FILE)
    moved = now.join(known, [*FILE], "left_anti").unionByName(gone.select(*FILE))
    importers = hold(now.unionByName(change.lookup("imports", graph.path_tails(moved).select("repo_name", "tail")).select(*FILE)).distinct())

    pairs = hold(change.lookup("symbols", heirs).where("kind = 'inherits'"))
    inherits = graph.inherits_edges(pairs, change.lookup("class_names", pairs.select("repo_name", F.col("parent").alias("name"))), owned=True)
    imports = hold(change.lookup("symbols", importers).where("kind = 'import'"))
    tails = change.lookup("tails", graph.imports_wanted(imports).select("repo_name", "tail"))
    own = graph.containment_edges(parsed, owned=True).dropDuplicates(["type", "src", "dst"])
    ends = classes.select(F.col("class_id").alias("dst")).unionByName(functions.select(F.col("function_id").alias("dst"))).unionByName(endpoints.select(F.col("endpoint_id").alias("dst")))
    own = own.join(ends, "dst", "left_semi").unionByName(graph.repo_edges(changed.withColumn("file_id", F.col("_doc_id")), owned=True))
    found = {"own": own, "inherits": inherits, "imports": graph.import_edges(imports, tails=tails, owned=True)}
    whose = {"own": stale, "inherits": heirs.unionByName(gone.select(*FILE)), "imports": importers.unionByName(gone.select(*FILE))}

    cols = LAYOUTS["edges"].columns
    calls = linker.links_of(change.table("calls"), change.table("endpoints"), owned=True) if get_settings().use_cross_repo_linking else change.table("edges").limit(0)
    calls = hold(calls.withColumn("part", F.lit("calls")).select(*cols))
    before = change.table("edges").where("part = 'calls'").select(*cols)
    differ = hold(calls.exceptAll(before).unionByName(before.exceptAll(calls)).select("owner", "part").distinct())
    groups = [w.distinct().select(ids.file_id(*FILE).alias("owner"), F.lit(part).alias("part")) for part, w in whose.items()] + [differ]
    edges = [e.withColumn("part", F.lit(part)).select(*cols) for part, e in found.items()] + [calls.join(differ, ["owner", "part"], "left_semi").select(*cols)]
    put("edges", reduce(DataFrame.unionByName, edges), reduce(DataFrame.unionByName, groups))
    return graph.node_ids_per_file(parsed)
