"""The property graph: typed vertex tables, one edge table, upserts, resolution and statistics.

Vertices: ``repos, files, classes, functions, endpoints`` with the columns of SCHEMAS.
Edges: (type, src, dst, symbols, line, signal, confidence), unique by (type, src, dst).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import parent

SCHEMAS = {
    "repos": "repo_id string, name string, local_path string, last_indexed_at timestamp",
    "files": "file_id string, repo_name string, file_path string, file_name string, language string, content_hash string, size_bytes long, chunk_ids array<string>, last_indexed_at timestamp",
    "classes": "class_id string, name string, qualified_name string, file_path string, repo_name string, start_line int, end_line int, docstring string, language string",
    "functions": "function_id string, name string, qualified_name string, file_path string, repo_name string, start_line int, end_line int, is_async boolean, is_method boolean, docstring string, language string",
    "endpoints": "endpoint_id string, http_method string, path_pattern string, full_path string, framework string, file_path string, repo_name string",
}
KEYS = {"repos": "repo_id", "files": "file_id", "classes": "class_id", "functions": "function_id", "endpoints": "endpoint_id"}
#: What an upsert changes in a vertex that is there; everything else keeps its first value.
UPDATED = {
    "repos": ("local_path", "last_indexed_at"),
    "files": ("content_hash", "chunk_ids", "size_bytes", "last_indexed_at"),
    "classes": ("start_line", "end_line", "docstring"),
    "functions": ("start_line", "end_line", "is_async", "docstring"),
    "endpoints": (),
}
EDGE = "type string, src string, dst string, symbols array<string>, line int, signal string, confidence double"
EDGE_TYPES = {
    "BELONGS_TO_REPO": ("files", "repos"), "CONTAINS_CLASS": ("files", "classes"), "CONTAINS_FUNCTION": ("files", "functions"),
    "METHOD_OF": ("functions", "classes"), "IMPORT_DEP": ("files", "files"), "CALLS": ("functions", "functions"), "EXPOSES": ("files", "endpoints"),
    "HANDLES": ("endpoints", "functions"), "INHERITS": ("classes", "classes"), "CROSS_REPO_CALL": ("files", "files"),
}


def upsert_vertices(old: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Inserts, or updates by key the columns that UPDATED names. Of equal keys in ``new`` the last in order of position wins."""
    key, updated = KEYS[kind], UPDATED[kind]
    cols = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
    if "start_line" in cols:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("start_line")))).where("_n = 1")
    n = new.dropDuplicates([key]).alias("n")
    both = old.alias("o").join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in updated else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
    return both.select(*[pick(c).alias(c) for c in cols])


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds edges that aren't there by (type, src, dst); of equal new ones the first by line stays."""
    # the hash leads, so that sorting compares numbers and looks at names only where they agree
    first = F.row_number().over(Window.partitionBy("_h", "type", "src", "dst").orderBy(F.col("line").asc_nulls_last()))
    fresh = new.withColumn("_h", F.xxhash64("type", "src", "dst")).withColumn("_n", first).where("_n = 1").drop("_h", "_n")
    return old.unionByName(fresh.join(old, ["type", "src", "dst"], "left_anti"))


def keep_whole(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose both ends are in vertices (id)."""
    have = vertices.select("id").distinct()
    return edges.join(have.select(F.col("id").alias("src")), "src", "left_semi").join(have.select(F.col("id").alias("dst")), "dst", "left_semi")


def all_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, kind) of every vertex."""
    return reduce(DataFrame.unionByName, [t.select(F.col(KEYS[k]).alias("id"), F.lit(k).alias("kind")) for k, t in tables.items()])


def vertices_of(symbols: DataFrame) -> dict[str, DataFrame]:
    """Class, function and endpoint vertices of extracted symbol records."""
    where = (F.col("repo_name"), F.col("file_path"))
    c = symbols.where("kind = 'class'").select(ids.class_id(*where, F.col("name")).alias("class_id"), "name", "qualified_name", "file_path", "repo_name", "start_line", "end_line", "docstring", "language")
    f = symbols.where("kind = 'function'").select(
        ids.function_id(*where, F.col("qualified_name")).alias("function_id"), "name", "qualified_name", "file_path", "repo_name", "start_line", "end_line", "is_async", "is_method", "docstring", "language"
    )
    e = symbols.where("kind = 'endpoint'").select(
        ids.endpoint_id(*where, F.col("http_method"), F.col("path")).alias("endpoint_id"), "http_method", F.col("path").alias("path_pattern"), F.col("path").alias("full_path"), "framework", "file_path", "repo_name"
    )
    return {"classes": c, "functions": f, "endpoints": e}


def _edge(rows: DataFrame, kind: str, src: Column, dst: Column, symbols: Column | None = None, line: Column | None = None, signal: Column | None = None, confidence: Column | None = None, owned: bool = False) -> DataFrame:
    """owned: with the file (repo_name, file_path) that the edge was found in."""
    null = F.lit(None)
    return rows.select(
        F.lit(kind).alias("type"),
        src.alias("src"),
        dst.alias("dst"),
        (null if symbols is None else symbols).cast("array<string>").alias("symbols"),
        (null if line is None else line).cast("int").alias("line"),
        (null if signal is None else signal).cast("string").alias("signal"),
        (null if confidence is None else confidence).cast("double").alias("confidence"),
        *([ids.file_id("repo_name", "file_path").alias("owner")] if owned else []),
    )


def repo_edges(files: DataFrame, owned: bool = False) -> DataFrame:
    return _edge(files, "BELONGS_TO_REPO", F.col("file_id"), ids.repo_id("repo_name"), owned=owned)


def containment_edges(symbols: DataFrame, owned: bool = False) -> DataFrame:
    """CONTAINS_CLASS, CONTAINS_FUNCTION, METHOD_OF, EXPOSES and HANDLES: both ends are in the record itself."""
    where = (F.col("repo_name"), F.col("file_path"))
    file = ids.file_id(*where)
    of = lambda k: symbols.where(F.col("kind") == k)
    function = ids.function_id(*where, F.col("qualified_name"))
    endpoint = ids.endpoint_id(*where, F.col("http_method"), F.col("path"))
    parts = [
        _edge(of("class"), "CONTAINS_CLASS", file, ids.class_id(*where, F.col("name")), owned=owned),
        _edge(of("function"), "CONTAINS_FUNCTION", file, function, owned=owned),
        _edge(of("function").where("is_method"), "METHOD_OF", function, ids.class_id(*where, F.col("parent")), owned=owned),
        _edge(of("endpoint"), "EXPOSES", file, endpoint, owned=owned),
        _edge(of("endpoint").where("handler is not null"), "HANDLES", endpoint, ids.function_id(*where, F.col("handler")), owned=owned),
    ]
    return reduce(DataFrame.unionByName, parts)


def inherits_edges(symbols: DataFrame, classes: DataFrame, owned: bool = False) -> DataFrame:
    """Parent names to classes: in the same file, else the first by id in the same repository."""
    pairs = symbols.where("kind = 'inherits'").select("repo_name", "file_path", "name", "parent").distinct()
    same = classes.select("repo_name", "file_path", F.col("name").alias("parent"), F.col("class_id").alias("near")).dropDuplicates(["repo_name", "file_path", "parent"])
    far = classes.groupBy("repo_name", F.col("name").alias("parent")).agg(F.min("class_id").alias("far"))
    found = pairs.join(same, ["repo_name", "file_path", "parent"], "left").join(far, ["repo_name", "parent"], "left")
    found = found.withColumn("dst", F.coalesce("near", "far")).where("dst is not null")
    return _edge(found, "INHERITS", ids.class_id("repo_name", "file_path", "name"), F.col("dst"), owned=owned)


def parents_wanted(symbols: DataFrame) -> DataFrame:
    """(repo_name, parent, file_path): the names that a file's classes inherit from."""
    return symbols.where("kind = 'inherits'").select("repo_name", "parent", "file_path").distinct()


def normal_path(path: Column) -> Column:
    """The path without '.' and with '..' resolved; what climbs above the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.array_join(fold, "/")


def import_candidates(module: Column, path: Column) -> Column:
    """File paths that a module may stand for, best first."""
    here = parent(path)
    join = lambda a, b: normal_path(F.concat_ws("/", a, b))
    base = join(here, module)
    script = F.array(*[F.concat(base, F.lit(e)) for e in ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")])
    dots = F.length(module) - F.length(F.ltrim(module, F.lit(".")))
    name = F.replace(F.ltrim(module, F.lit(".")), F.lit("."), F.lit("/"))
    up = join(here, F.repeat(F.lit("../"), (dots - 1).cast("int")))
    inside = join(up, name)
    package = F.when(name == "", F.array(join(up, F.lit("__init__.py")))).otherwise(F.array(F.concat(inside, F.lit(".py")), F.concat(inside, F.lit("/__init__.py"))))
    dotted = F.replace(module, F.lit("."), F.lit("/"))
    plain = F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")))
    return F.when(module.startswith("./") | module.startswith("../"), script).when(module.startswith("."), package).otherwise(plain)


def path_suffixes(path: Column) -> Column:
    """The path and every tail of it that starts after a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def path_tails(files: DataFrame) -> DataFrame:
    """(repo_name, tail, file_path): each path and its tails at directory boundaries."""
    return files.select("repo_name", F.explode(path_suffixes(F.col("file_path"))).alias("tail"), "file_path")


def imports_wanted(symbols: DataFrame) -> DataFrame:
    """(repo_name, tail, file_path): the path tails that a file's imports may stand for."""
    imports = symbols.where("kind = 'import'")
    return imports.select("repo_name", F.explode(import_candidates(F.col("module"), F.col("file_path"))).alias("tail"), "file_path").distinct()


def import_edges(symbols: DataFrame, files: DataFrame | None = None, tails: DataFrame | None = None, owned: bool = False) -> DataFrame:
    """IMPORT_DEP: the first candidate that is a file's path, or a tail of one at a directory boundary, in the same repository.

    Tails of paths (given, or those of files) are joined by equality, so there is no nested loop over files.
    """
    imports = symbols.where("kind = 'import'").select("repo_name", "file_path", "module", "symbols", F.col("start_line").alias("line"))
    imports = imports.withColumn("src", ids.file_id("repo_name", "file_path"))
    wanted = imports.select("*", F.posexplode(import_candidates(F.col("module"), F.col("file_path"))).alias("choice", "tail"))
    have = (path_tails(files) if tails is None else tails).select("repo_name", "tail", ids.file_id("repo_name", "file_path").alias("dst"))
    best = F.row_number().over(Window.partitionBy("src", "module", "line").orderBy("choice", "dst"))
    found = wanted.join(have, ["repo_name", "tail"]).withColumn("_n", best).where("_n = 1").where("src <> dst")
    first = F.row_number().over(Window.partitionBy("src", "dst").orderBy("line", "module"))
    return _edge(found.withColumn("_n", first).where("_n = 1"), "IMPORT_DEP", F.col("src"), F.col("dst"), F.col("symbols"), F.col("line"), owned=owned)


def symbol_edges(symbols: DataFrame, files: DataFrame, classes: DataFrame) -> DataFrame:
    parts = [containment_edges(symbols), inherits_edges(symbols, classes), import_edges(symbols, files)]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["type", "src", "dst"])


def node_ids_per_file(symbols: DataFrame) -> DataFrame:
    """(doc_id, graph_node_ids): classes, then functions, then endpoints, each in order of position."""
    where = (F.col("repo_name"), F.col("file_path"))
    node = (
        F.when(F.col("kind") == "class", F.struct(F.lit(0).alias("k"), "seq", ids.class_id(*where, F.col("name")).alias("id")))
        .when(F.col("kind") == "function", F.struct(F.lit(1).alias("k"), "seq", ids.function_id(*where, F.col("qualified_name")).alias("id")))
        .when(F.col("kind") == "endpoint", F.struct(F.lit(2).alias("k"), "seq", ids.endpoint_id(*where, F.col("http_method"), F.col("path")).alias("id")))
    )
    found = symbols.select(ids.file_id(*where).alias("doc_id"), node.alias("n")).where("n is not null")
    return found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("n")), lambda x: x["id"]).alias("graph_node_ids"))


def delete_file_symbols(tables: dict[str, DataFrame], edges: DataFrame, files: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Without the symbols of the files (repo_name, file_path) and every edge that touches them."""
    gone = files.select("repo_name", "file_path").distinct()
    out, lost = dict(tables), []
    for kind in ("classes", "functions", "endpoints"):
        lost.append(tables[kind].join(gone, ["repo_name", "file_path"], "left_semi").select(F.col(KEYS[kind]).alias("id")))
        out[kind] = tables[kind].join(gone, ["repo_name", "file_path"], "left_anti").select(*tables[kind].columns)
    dead = reduce(DataFrame.unionByName, lost)
    kept = edges.join(dead.select(F.col("id").alias("src")), "src", "left_anti").join(dead.select(F.col("id").alias("dst")), "dst", "left_anti")
    return out, kept.select(*edges.columns)


def graph_stats(tables: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """(element, name, count) for every vertex and edge type, zeros included."""
    spark = edges.sparkSession
    names = [("node", k) for k in SCHEMAS] + [("edge", t) for t in EDGE_TYPES]
    every = spark.createDataFrame(names, "element string, name string")
    counted = all_ids(tables).select(F.lit("node").alias("element"), F.col("kind").alias("name")).unionByName(edges.select(F.lit("edge").alias("element"), F.col("type").alias("name")))
    counted = counted.groupBy("element", "name").agg(F.count("*").alias("n"))
    return every.join(counted, ["element", "name"], "left").select("element", "name", F.coalesce("n", F.lit(0)).cast("long").alias("count"))
