"""Approximate nearest vectors by cosine: an inverted file of cells with residual codes, and exact scores at the end.

Centroids are fitted on a bounded sample; every vector is put into the cell of its nearest
centroid.  A cell is a partition that holds its vectors twice: as blocks of 8-bit codes of
what they differ from the centroid by, and in full.  A question reads the blocks of its
nearest cells; the candidates with the best coded scores are then scored in full, so
scores and order are exact and only membership is approximate.  More probes find more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that centroids are fitted on at most, those with the least hashes of their ids, and cells at most.
SAMPLE, MOST_CELLS = 65_536, 4096
#: Vectors in a block of codes at most.
BLOCK = 4096
ROUNDS = 10


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _rows(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from rows at even steps; a centroid that loses its rows stays where it was."""
    u = _unit(sample)
    c = u[np.linspace(0, len(u) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(u, -(-len(u) // BLOCK))])
        total = np.zeros_like(c)
        np.add.at(total, own, u)
        have = np.bincount(own, minlength=cells) > 0
        c[have] = _unit(total[have])
    return c


@dataclass(frozen=True)
class Ivf:
    """centroids [cells, d], and the stored tables: codes (cell, ids, codes, scales) and vectors (cell, id, embedding), both by cell."""

    centres: np.ndarray
    codes: DataFrame
    vectors: DataFrame


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", cells: int | None = None) -> Ivf:
    """Fits, codes and writes an index of (id, embedding) below the path; vectors that are null or zero are in no cell."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.exists("embedding", lambda x: x != 0.0))
    n = rows.count()
    cells = cells or max(1, min(MOST_CELLS, round(n**0.5)))
    sample = rows.withColumn("_h", F.xxhash64("id")).orderBy("_h", "id").limit(SAMPLE).select("embedding")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_rows(b.column("embedding")) for b in batches if b.num_rows]
        if parts:
            x = np.concatenate(parts)
            yield pa.RecordBatch.from_pydict({"centre": pa.array(list(centroids(x, min(cells, len(x)))), pa.list_(pa.float64()))})

    # SAMPLE rows in one task, and MOST_CELLS rows back
    found = sample.repartition(1).mapInArrow(fit, "centre array<double>").toArrow().column("centre").to_pylist()
    centres = np.array(found) if found else np.zeros((0, 0))
    spark.createDataFrame([(k, c) for k, c in enumerate(found)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    held = spark.sparkContext.broadcast(centres)

    @F.arrow_udf("int")
    def nearest(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in columns:
            yield pa.array((_rows(x) @ held.value.T).argmax(axis=1).astype(np.int32) if len(x) else np.zeros(0, dtype=np.int32))

    rows.withColumn("cell", nearest("embedding")).repartition("cell").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors") if n else rows.withColumn("cell", F.lit(0))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of one cell each: for a vector's difference from its centroid 8-bit numbers and a scale."""
        for batch in batches:
            own = batch.column("cell").to_numpy()
            for cell in np.unique(own).tolist():
                at = np.flatnonzero(own == cell)
                for a in range(0, len(at), BLOCK):
                    some = pa.array(at[a : a + BLOCK])
                    rest = _unit(_rows(batch.column("embedding").take(some))) - held.value[cell]
                    scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127.0
                    ids = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), batch.column("id").take(some))
                    columns = [pa.array([cell], pa.int32()), ids, pa.array([np.rint(rest / scale[:, None]).astype(np.int8).tobytes()], pa.binary()), pa.array([scale.astype(np.float32).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "ids", "codes", "scales"])

    kind = stored.schema["id"].dataType.simpleString()
    stored.select("cell", "id", "embedding").mapInArrow(code, f"cell int, ids array<{kind}>, codes binary, scales binary").write.partitionBy("cell").parquet(f"{path}/codes")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Ivf:
    found = sorted(spark.read.parquet(f"{path}/centres").collect())  # MOST_CELLS rows
    return Ivf(np.array([r["centre"] for r in found]), spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors"))


def search(index: Ivf, queries: DataFrame, k: int = 20, probes: int = 8, candidates: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the nearest vectors by cosine; queries: (query_id, embedding) without nulls.

    candidates: how many with the best coded scores are scored in full for each query; 4 * k by default.
    """
    spark, candidates = queries.sparkSession, candidates or 4 * k
    held = spark.sparkContext.broadcast(index.centres)
    probes = min(probes, len(index.centres))

    @F.arrow_udf("array<int>")
    def near_cells(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in columns:
            cos = _rows(x) @ held.value.T if len(x) else np.zeros((0, probes))
            yield pa.array(list(np.argpartition(-cos, probes - 1, axis=1)[:, :probes].astype(np.int32)), pa.list_(pa.int32()))

    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).where(F.exists("q", lambda x: x != 0.0))
    asked = asked.select("query_id", "q", F.explode(near_cells("q")).alias("cell"))
    met = asked.join(index.codes, "cell")  # where the questions are few enough to be sent, only their cells are read

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, q = batch.column("cell").to_pylist(), _unit(_rows(batch.column("q"))) if batch.num_rows else None
            for i in range(batch.num_rows):
                scale = np.frombuffer(batch.column("scales")[i].as_py(), dtype=np.float32)
                codes = np.frombuffer(batch.column("codes")[i].as_py(), dtype=np.int8).reshape(len(scale), -1)
                coded = held.value[cell[i]] @ q[i] + (codes @ q[i]) * scale
                best = np.argsort(-coded, kind="stable")[:candidates]
                ids = batch.column("ids")[i].values.take(pa.array(best))
                n = len(best)
                columns = [batch.column("query_id").take(pa.array(np.full(n, i))), pa.array(np.full(n, cell[i], dtype=np.int32)), ids, pa.array(coded[best])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "cell", "id", "coded"])

    kinds = queries.schema["query_id"].dataType.simpleString(), index.vectors.schema["id"].dataType.simpleString()
    found = met.select("query_id", "cell", "q", "ids", "codes", "scales").mapInArrow(score, f"query_id {kinds[0]}, cell int, id {kinds[1]}, coded double")
    best = Window.partitionBy("query_id").orderBy(F.desc("coded"), "id")
    chosen = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= candidates).select("query_id", "cell", "id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    full = chosen.join(index.vectors, ["cell", "id"]).join(asked.select("query_id", "q").dropDuplicates(["query_id"]), "query_id")
    full = full.withColumn("score", dot("embedding", "q") / F.sqrt(dot("embedding", "embedding") * dot("q", "q")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return full.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")
