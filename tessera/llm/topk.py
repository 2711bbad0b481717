"""Operator 9: exact top-k by inner product, by distributed histogram selection.

Vectors become integers (``floor(scale * x)``), so scores are integers.  Queries and
candidates are packed into blocks; every query block meets every candidate block in a
task of its own, and all scores are computed as matrix products.  Each round makes a
histogram of scores for each query over the range that is still open, sums them over
the cluster and narrows the range to the bin with the k-th highest score, until the
k-th value is known.  A last pass keeps scores above it, and of those equal to it the
k smallest ids of each block, which is all that ties can need.  Histograms are cut
below a block's own k-th score, as the global one isn't lower.

Nothing is collected but the number of rounds' worth of scalars; the score matrix is
never stored.  Cost is queries times candidates, as any exact search over a stated
query set has; memory is a block pair.

Cases: vectors that are null, empty or hold a null or non-finite component take no
part; null ids take no part; an inner product needs equal lengths, so a query meets the
candidates of its own length; a candidate with the query's own id is the query; fewer
than k candidates give all; ties go to smaller ids; rows that repeat an id are
candidates and queries each; scores that could leave 62 bits raise an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

BLOCK = 2048
BINS = 512
#: Blocks on either side of a task: it meets so many query blocks with so many candidate blocks.
SIDE = 8


def _blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Packed blocks of (vec_id, v): ids and a matrix of the narrowest integers that hold it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # by length of the vectors

        def full(ids, m):
            nonlocal number
            number += 1
            kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not m.size or (np.iinfo(t).min <= m.min() and m.max() <= np.iinfo(t).max))
            cols = {"number": [number], "ids": [ids.tobytes()], "kind": [np.dtype(kind).name], "m": [m.astype(kind).tobytes()]}
            return pa.RecordBatch.from_pydict(cols, schema=pa.schema([("number", pa.int64()), ("ids", pa.binary()), ("kind", pa.string()), ("m", pa.binary())]))

        for batch in batches:
            if not batch.num_rows:
                continue
            lists, ids = batch.column("v"), batch.column("vec_id").to_numpy()
            wide = lists.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(wide).tolist():
                own = np.flatnonzero(wide == d)
                held.setdefault(d, []).append((ids[own], lists.take(pa.array(own)).flatten().to_numpy().reshape(len(own), d).copy()))
                while sum(len(x) for x, _ in held[d]) >= size:
                    some, m = (np.concatenate(x) for x in zip(*held[d], strict=True))
                    yield full(some[:size], m[:size])
                    held[d] = [(some[size:], m[size:])]
        for parts in held.values():
            some, m = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(some):
                yield full(some, m)

    return scratch.keep(rows.mapInArrow(pack, "number long, ids binary, kind string, m binary"), name)


def _matrix(ids: bytes, kind: str, m: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, dtype=np.int64)
    return own, np.frombuffer(m, dtype=kind).reshape(len(own), -1)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in floats where every partial sum fits their mantissa."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for each row that ``queries`` (a condition on vec_id) selects."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    sound = F.size("x") > 0
    sound = sound & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("v"))
    asked = rows.where(queries)
    square = lambda d: d.agg(F.max(F.aggregate(F.transform("v", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, b: a + b))).first()[0]
    norms = square(rows), square(asked)
    if None in norms:
        return empty
    bound = int(norms[0] ** 0.5 * norms[1] ** 0.5 * (1 + 1e-9)) + 1  # no score is beyond, by Cauchy and Schwarz
    if bound >= 1 << 62:
        raise OverflowError("scores don't fit in 64 bits: use a smaller scale")
    right = _blocks(rows, "candidates", BLOCK)
    left = _blocks(asked.repartition("vec_id"), "queries", BLOCK // 2)
    grid = tuple(max(1, -(-side.count() // SIDE)) for side in (left, right))

    low, width = -bound, 1
    while width * BINS < 2 * bound + 1:
        width *= BINS  # a power of the number of bins, so that a bin's own bins cover it and nothing above it
    state = left.select("number", F.lit(None).cast("array<struct<pos:int,low:long,want:long>>").alias("state"))
    while True:
        found = _cells(left, right, state, grid).mapInArrow(_histograms(low, width, BINS, k), "number long, pos int, bin int, n long, low long, want long")
        found = found.groupBy("number", "pos", "bin", "low", "want").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("number", "pos").orderBy(F.desc("bin")))
        reached = found.withColumn("before", upto - F.col("n")).where("before < want")  # the last of these bins has the k-th score
        state = reached.groupBy("number", "pos", "low", "want").agg(F.min("bin").alias("bin"), F.max("before").alias("before"))
        each = F.struct("pos", (F.col("low") + F.col("bin") * F.lit(width).cast("long")).alias("low"), (F.col("want") - F.col("before")).alias("want"))
        state = scratch.keep(state.groupBy("number").agg(F.collect_list(each).alias("state")), "thresholds")  # a block's own queries
        if width == 1:
            break
        width //= BINS
    chosen = _cells(left, right, state, grid).mapInArrow(_choose(k), "number long, pos int, query_id long, vec_id long, score long")
    rank = Window.partitionBy("number", "pos").orderBy(F.desc("score"), "vec_id")  # a query's own rows
    return chosen.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cells(left: DataFrame, right: DataFrame, state: DataFrame, grid: tuple[int, int]) -> DataFrame:
    """Each query block, with its thresholds, beside each candidate block.

    Both sides are cut in parts of ``SIDE`` blocks on average, and a task gets a pair of parts: the number of tasks grows
    with both sides, and a block is copied once for each part of the other side.
    """
    high, wide = grid
    part = lambda n: F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = left.join(state, "number").select(*(F.col(c).alias("q_" + c) for c in ("ids", "kind", "m")), "number", "state", part(high).alias("i"), every(wide).alias("j"))
    given = right.select("ids", "kind", "m", every(high).alias("i"), part(wide).alias("j"))
    return asked.join(given, ["i", "j"])


def _pairs(batches: Iterator[pa.RecordBatch]):
    """Of each cell: block number, thresholds, query ids, candidate ids, scores; a query's own score is masked."""
    for batch in batches:
        for x in batch.to_pylist():
            q_ids, q = _matrix(x["q_ids"], x["q_kind"], x["q_m"])
            c_ids, c = _matrix(x["ids"], x["kind"], x["m"])
            if q.shape[1] != c.shape[1]:
                continue
            yield x["number"], x["state"], q_ids, c_ids, _scores(q, c), q_ids[:, None] == c_ids[None, :]


def _histograms(first_low: int, width: int, n_bins: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, state, q_ids, _, scores, own in _pairs(batches):
            low, want = np.full(len(q_ids), first_low, dtype=np.int64), np.full(len(q_ids), k, dtype=np.int64)
            if state is not None:
                want[:] = 0
                for s in state:
                    low[s["pos"]], want[s["pos"]] = s["low"], s["want"]
            bins = (scores - low[:, None]) // width
            row, col = np.nonzero((bins >= 0) & (bins < n_bins) & ~own & (want > 0)[:, None])
            counts = np.bincount(row * n_bins + bins[row, col], minlength=len(q_ids) * n_bins).reshape(-1, n_bins)
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            row, col = np.nonzero((counts > 0) & (above < want[:, None]))
            cols = [np.full(len(row), number), row.astype(np.int32), col.astype(np.int32), counts[row, col], low[row], want[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["number", "pos", "bin", "n", "low", "want"])

    return run


def _choose(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, state, q_ids, c_ids, scores, own in _pairs(batches):
            low = np.full(len(q_ids), np.iinfo(np.int64).max)
            for s in state:
                low[s["pos"]] = s["low"]
            order = np.argsort(c_ids, kind="stable")
            equal = ((scores == low[:, None]) & ~own)[:, order]
            few = equal & (np.cumsum(equal, axis=1) <= k)
            row, col = np.nonzero((scores > low[:, None]) & ~own)
            r, c = np.nonzero(few)
            row, col = np.append(row, r), np.append(col, order[c])
            cols = [np.full(len(row), number), row.astype(np.int32), q_ids[row], c_ids[col], scores[row, col]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["number", "pos", "query_id", "vec_id", "score"])

    return run
