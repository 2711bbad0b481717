"""The graph as a viewer shows it: capped nodes, edges between them, statistics, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def subgraph(nodes: DataFrame, edges: DataFrame, per_type: int, repo: str | None = None, types: tuple[str, ...] | None = None, hidden: tuple[str, ...] = ("CALLS", "CROSS_REPO_CALL")) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, repo_name), the first of each type, and the edges (type, src, dst) between them."""
    n = nodes if repo is None else nodes.where(F.col("repo_name") == repo)
    n = n if types is None else n.where(F.col("type").isin(*types))
    n = n.dropDuplicates(["id"]).withColumn("_n", F.row_number().over(Window.partitionBy("type").orderBy("id"))).where(F.col("_n") <= per_type).drop("_n")
    return n, trim(edges.where(~F.col("type").isin(*hidden)) if hidden else edges, n)


def trim(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    have = nodes.select("id")
    return edges.join(have.withColumnRenamed("id", "src"), "src", "left_semi").join(have.withColumnRenamed("id", "dst"), "dst", "left_semi")


def faded(nodes: DataFrame, term: str = "", types: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes with a flag: not of an enabled type, or the term is neither in the label nor in the path."""
    low = term.lower()
    shown = F.lit(True) if types is None else F.col("type").isin(*types)
    path = F.col("file_path") if "file_path" in nodes.columns else F.lit("")
    hit = F.contains(F.lower(F.coalesce("label", F.lit(""))), F.lit(low)) | F.contains(F.lower(F.coalesce(path, F.lit(""))), F.lit(low))
    return nodes.withColumn("faded", ~(shown & (hit if low else F.lit(True))))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(element, type, count); a null type is the total."""
    n = nodes.select(F.lit("node").alias("element"), "type").unionByName(edges.select(F.lit("edge").alias("element"), "type"))
    return n.groupBy("element", "type").agg(F.count("*").alias("count")).unionByName(n.groupBy("element").agg(F.count("*").alias("count")).select("element", F.lit(None).cast("string").alias("type"), "count"))


def neighbours(edges: DataFrame, nodes: DataFrame, chosen: DataFrame, most: int = 20) -> DataFrame:
    """(id, direction, type, other, label, total): what each chosen node (id) is joined to, the first so many of a count of all."""
    out = edges.select(F.col("src").alias("id"), F.lit("→").alias("direction"), "type", F.col("dst").alias("other"))
    back = edges.select(F.col("dst").alias("id"), F.lit("←").alias("direction"), "type", F.col("src").alias("other"))
    found = out.unionByName(back).join(chosen.select("id"), "id", "left_semi").join(nodes.select(F.col("id").alias("other"), "label"), "other")
    w = Window.partitionBy("id")
    ranked = found.withColumn("total", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy("direction", "type", "other")))
    return ranked.where(F.col("_n") <= most).select("id", "direction", "type", "other", "label", "total")


def repo_list(nodes: DataFrame) -> DataFrame:
    return nodes.where("coalesce(repo_name, '') <> ''").select("repo_name").distinct().orderBy("repo_name")


def export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line for each node, edge and statistic."""
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json"))
    return line(nodes, "node").unionByName(line(edges, "edge")).unionByName(line(stats(nodes, edges), "stats"))
