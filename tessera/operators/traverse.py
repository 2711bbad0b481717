"""Questions against the graph: entities, matching nodes, related files, k hops, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_entities


def known_names(classes: DataFrame, functions: DataFrame, endpoints: DataFrame, per_kind: int | None = None) -> DataFrame:
    """(kind, name): distinct names; with per_kind the first so many of each kind."""
    every = classes.select(F.lit("Class").alias("kind"), "name").unionByName(functions.select(F.lit("Function").alias("kind"), "name"))
    every = every.unionByName(endpoints.select(F.lit("APIEndpoint").alias("kind"), F.col("path_pattern").alias("name"))).where("name is not null").distinct()
    if per_kind is None:
        return every
    return every.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("name"))).where(F.col("_n") <= per_kind).drop("_n")


def extract_entities(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, entity): names by their shape, and known names that stand in the query as whole words.

    A known name meets the queries that hold its first word, by equality, however many names there are; names of
    several words or with other characters are then looked for as a whole.
    """
    shaped = queries.select("query_id", F.explode(text_entities("query")).alias("entity"))
    first = F.regexp_extract(F.lower("name"), r"\w+", 0)
    n = names.where(F.length("name") > 3).select("name", first.alias("_word")).distinct()
    words = queries.select("query_id", "query", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"\w+"), 0))).alias("_word"))
    whole = F.expr(r"lower(name) = _word or query rlike concat('(?i)(?<!\\w)\\Q', name, '\\E(?!\\w)')")
    known = words.join(n.where("_word <> ''"), "_word").where(whole).select("query_id", F.col("name").alias("entity"))
    return shaped.unionByName(known).distinct()


def grams(text: Column, size: int) -> Column:
    """The different runs of so many characters in a text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, F.lit(size))))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, text): which different texts hold which different needles (entity), whole and by case, by an index of runs of up to three characters.

    A needle meets only texts that hold its rarest run, by equality, and is then looked for as a whole: no nested loop,
    however many there are of either.
    """
    texts = texts.where("text is not null").distinct()
    index = texts.select("text", F.explode(F.concat(*[grams(F.col("text"), size) for size in (1, 2, 3)])).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    own = needles.where("entity <> ''").distinct()
    each = F.when(F.length("entity") >= 3, grams(F.col("entity"), 3)).otherwise(F.array("entity"))
    runs = own.select("entity", F.explode(each).alias("gram")).join(often, "gram", "left")  # a run that no text has is the rarest
    rarest = runs.groupBy("entity").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("entity", "r.gram")
    return rarest.join(index, "gram").where(F.contains("text", "entity")).select("entity", "text")


def find_nodes(entities: DataFrame, classes: DataFrame, functions: DataFrame, endpoints: DataFrame, limits: tuple[int, int, int] = (5, 10, 5)) -> DataFrame:
    """(query_id, kind, id, name, ...) of nodes that the entities (query_id, entity) name, at most so many for each entity."""
    first = lambda df, key, n: df.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "entity").orderBy(key))).where(F.col("_n") <= n)
    null = lambda t: F.lit(None).cast(t)
    cols = lambda kind, key, name, **more: [
        "query_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(name).alias("name"), "file_path", "repo_name",
        more.get("qualified", null("string")).alias("qualified_name"), more.get("is_async", null("boolean")).alias("is_async"), more.get("is_method", null("boolean")).alias("is_method"),
        more.get("method", null("string")).alias("http_method"), more.get("framework", null("string")).alias("framework"),
    ]
    c = first(entities.join(classes, F.col("entity") == F.col("name")), "class_id", limits[0]).select(*cols("Class", "class_id", "name"))
    f = first(entities.join(functions, F.col("entity") == F.col("name")), "function_id", limits[1])
    f = f.select(*cols("Function", "function_id", "name", qualified=F.col("qualified_name"), is_async=F.col("is_async"), is_method=F.col("is_method")))
    holding = containing(entities.select("entity"), endpoints.select(F.col("path_pattern").alias("text")))
    named = entities.join(holding, "entity").withColumnRenamed("text", "path_pattern")
    e = first(named.join(endpoints, "path_pattern"), "endpoint_id", limits[2])
    e = e.select(*cols("APIEndpoint", "endpoint_id", "path_pattern", method=F.col("http_method"), framework=F.col("framework")))
    return c.unionByName(f).unionByName(e).dropDuplicates(["query_id", "kind", "id"])


def related_files(matches: DataFrame, files: DataFrame, edges: DataFrame, max_hops: int = 2, limits: tuple[int, int, int] = (10, 5, 5)) -> DataFrame:
    """(query_id, repo_name, file_path): files that hold the matches and, from two hops on, files beside them by id.

    Beside: files that those import, files that import those of matched classes, and files whose endpoints matched functions handle.
    """
    own = matches.select("query_id", "kind", F.col("id").alias("node"), "repo_name", "file_path").where("file_path is not null and file_path <> ''")
    hop1 = own.select("query_id", "repo_name", "file_path").distinct()
    if max_hops < 2:
        return hop1
    f = files.select("file_id", "repo_name", "file_path")
    held = own.join(f, ["repo_name", "file_path"]).select("query_id", "kind", "node", "file_id")
    few = lambda df, n: df.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "node").orderBy("found"))).where(F.col("_n") <= n).select("query_id", F.col("found").alias("file_id"))
    imports = edges.where("type = 'IMPORT_DEP'").select("src", "dst")
    forward = few(held.join(imports, F.col("file_id") == F.col("src")).select("query_id", "node", F.col("dst").alias("found")).distinct(), limits[0])
    backward = few(held.where("kind = 'Class'").join(imports, F.col("file_id") == F.col("dst")).select("query_id", "node", F.col("src").alias("found")).distinct(), limits[1])
    handles = edges.where("type = 'HANDLES'").select(F.col("src").alias("_e"), F.col("dst").alias("node"))
    exposes = edges.where("type = 'EXPOSES'").select(F.col("src").alias("found"), F.col("dst").alias("_e"))
    handled = few(held.where("kind = 'Function'").join(handles, "node").join(exposes, "_e").select("query_id", "node", "found").distinct(), limits[2])
    hop2 = forward.unionByName(backward).unionByName(handled).join(f, "file_id").select("query_id", "repo_name", "file_path")
    return hop1.unionByName(hop2).distinct()


def methods_of(matches: DataFrame, functions: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """(query_id, id, methods) of matched classes: names in order, at most so many."""
    m = matches.where("kind = 'Class'").select("query_id", "id")
    of = edges.where("type = 'METHOD_OF'").select(F.col("src").alias("function_id"), F.col("dst").alias("id"))
    named = m.join(of, "id").join(functions.select("function_id", F.col("name").alias("method")), "function_id")
    return named.groupBy("query_id", "id").agg(F.slice(F.array_sort(F.collect_set("method")), 1, most).alias("methods"))


def k_hops(edges: DataFrame, starts: DataFrame, hops: int, undirected: bool = False) -> DataFrame:
    """(start, node, hops): nodes within so many edges (src, dst) of the starts (start), with the fewest hops to each.

    One join and one partial aggregate for each hop; cycles end by keeping the least hops.
    """
    e = edges.select("src", "dst")
    if undirected:
        e = e.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = e.distinct()
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct()
    front = seen
    for h in range(1, hops + 1):
        front = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(h).alias("hops")).distinct()
        front = front.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        seen = seen.unionByName(front)
    return seen


def summarise(matches: DataFrame, methods: DataFrame) -> DataFrame:
    """(query_id, summary): what the graph knows of the matches, a line for each, by kind."""
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    place = F.concat_ws(": ", F.when(has("repo_name"), F.col("repo_name")), F.when(has("file_path"), F.col("file_path")))
    where = F.when(place != "", F.concat(F.lit(" ("), place, F.lit(")"))).otherwise(F.lit(""))
    listed = F.array_join(F.transform(F.slice(F.coalesce("methods", F.array().cast("array<string>")), 1, MOST["methods"]), tick), ", ")
    traits = F.concat_ws(" ", F.when(F.coalesce("is_async", F.lit(False)), "async"), F.when(F.coalesce("is_method", F.lit(False)), "method"))
    line = (
        F.when(F.col("kind") == "Class", F.concat(F.lit("* class "), tick(F.col("name")), where, F.when(listed != "", F.concat(F.lit(" with "), listed)).otherwise(F.lit(""))))
        .when(F.col("kind") == "Function", F.concat(F.lit("* "), F.when(traits != "", F.concat(traits, F.lit(" "))).otherwise(F.lit("function ")), tick(F.coalesce("qualified_name", "name")), where))
        .otherwise(F.concat(F.lit("* route "), tick(F.concat_ws(" ", F.coalesce("http_method", F.lit("any")), "name")), F.when(has("framework"), F.concat(F.lit(" of "), F.col("framework"))).otherwise(F.lit("")), where))
    )
    rows = matches.join(methods, ["query_id", "id"], "left").select("query_id", "kind", F.struct("name", "id", line.alias("line")).alias("x"))
    kinds = ("Class", "Function", "APIEndpoint")
    by = rows.groupBy("query_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("x")))).alias(k) for k in kinds])
    block = lambda k: F.when(F.size(k) > 0, F.array_join(F.transform(F.slice(F.col(k), 1, MOST[k]), lambda x: x["line"]), "\n"))
    return by.select("query_id", F.concat_ws("\n", *[block(k) for k in kinds]).alias("summary"))


#: How many of each a summary shows. Fixed values.
MOST = {"Class": 5, "methods": 8, "Function": 8, "APIEndpoint": 8}
