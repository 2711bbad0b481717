"""Exact nearest vectors: blocks of queries beside blocks of candidates, scored as matrix products.

Candidates and queries are dealt into blocks by a hash of their ids, and a task gets a
pair of parts (some blocks of either side), so that no key of the join is the same for
all rows and the number of tasks grows with both sides.  Each pair of blocks gives the
best ``k`` of its candidates for each of its queries; the global best are among these.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
METRICS = ("cosine", "l2_relevance")
#: Decimals to which scores must differ to be told apart.
DIGITS = 9


def _blocks(rows: DataFrame, n: int, side: str) -> DataFrame:
    """Blocks of (key, v) by a hash of the key and by length: their keys in order, and their vectors."""
    block = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    listed = F.array_sort(F.collect_list(F.struct("key", "v")), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())
    made = rows.where(sound).groupBy(block.alias(side), F.size("v").alias("d")).agg(listed.alias("rows"))  # BLOCK rows on average
    return made.select(side, "d", F.transform("rows", lambda r: r["key"]).alias(f"{side}_keys"), F.flatten(F.transform("rows", lambda r: r["v"])).alias(f"{side}_v"))


def nearest(candidates: DataFrame, queries: DataFrame, k: int, key: Column, vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """(query_id, key, score): of each pair of blocks the best k candidates of each query, by score and then by the least key.

    queries: (query_id, embedding), in which rows may share an id.  Vectors that are null, empty or hold nulls match
    nothing; a query meets candidates of its own length.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    spark = candidates.sparkSession
    c = candidates.select(key.alias("key"), F.col(vector).cast("array<double>").alias("v"))
    q = queries.select(F.col("query_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"))
    n_c, n_q = (max(1, -(-d.count() // BLOCK)) for d in (c, q))
    if n_c * n_q < spark.sparkContext.defaultParallelism:  # few pairs: smaller blocks give every core one
        n_c = max(n_c, -(-spark.sparkContext.defaultParallelism // n_q))
    parts_c, parts_q = (max(1, n // 4) for n in (n_c, n_q))
    if parts_c * parts_q < spark.sparkContext.defaultParallelism:
        parts_c, parts_q = n_c, n_q
    left = _blocks(q, n_q, "q").select("*", F.pmod("q", F.lit(parts_q)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(parts_c - 1))).alias("j"))
    right = _blocks(c, n_c, "c").select("*", F.pmod("c", F.lit(parts_c)).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(parts_q - 1))).alias("i"))
    cells = left.join(right.hint("merge"), ["i", "j", "d"]).select("d", "q_keys", "q_v", "c_keys", "c_v")
    kinds = cells.schema
    shape = f"query_id {kinds['q_keys'].dataType.elementType.simpleString()}, key {kinds['c_keys'].dataType.elementType.simpleString()}, score double"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                d = batch.column("d")[r].as_py()
                keys_q, keys_c = (batch.column(f"{s}_keys")[r].values for s in "qc")
                q, c = (batch.column(f"{s}_v")[r].values.to_numpy(zero_copy_only=False).reshape(-1, d) for s in "qc")
                scores = _scores(q, c, metric)
                near = np.round(scores, DIGITS)
                if near.shape[1] > k:  # above the k-th value all, of those equal to it the first k
                    least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
                    equal = near == least
                    row, col = np.nonzero((near > least) | (equal & (np.cumsum(equal, axis=1) <= k)))
                else:
                    row, col = (x.ravel() for x in np.indices(near.shape))
                yield pa.RecordBatch.from_arrays([keys_q.take(pa.array(row)), keys_c.take(pa.array(col)), pa.array(scores[row, col])], names=["query_id", "key", "score"])

    return cells.mapInArrow(run, shape)


def _scores(q, c, metric: str):
    import numpy as np

    if metric == "cosine":
        sizes = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((c * c).sum(axis=1))[None, :]
        return np.divide(q @ c.T, sizes, out=np.zeros(sizes.shape), where=sizes > 0)
    out = np.empty((len(q), len(c)))
    for a in range(0, len(q), 16):  # differences, not products: equal vectors are at distance zero exactly
        out[a : a + 16] = np.sqrt(((q[a : a + 16, None, :] - c[None, :, :]) ** 2).sum(axis=2))
    return 1.0 - out / np.sqrt(2.0)
