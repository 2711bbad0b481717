"""Operator 8: best-fit packing of documents into sequences under several capacities.

Each sequence has capacities of tokens, documents and attention cost (the sum of
squared piece lengths).  Pieces go longest first, each to the open sequence whose
residual capacities it fits best, by weighted norm of what would be left or by
weighted dot product; a new sequence is opened only where none has room.

Pieces of one length are alike, so the driver needs only their count by length: a
histogram of ``max_tokens`` numbers, whatever the data.  It plays best fit on classes
of sequences with equal residuals, which yields a plan of bounded size: "pieces of
length L with ranks a to b go to sequences c to d, k in each, from token t on".  Ranks
within a length come from counts by (part, length) and prefix sums; each piece then
looks its rank up in the plan.  The result is what best fit over the whole table
gives; nothing is packed by shard, and no group of pieces meets in one task.

Cases: a null text is an empty document of one token, the end id; documents longer
than a sequence are cut into full pieces, of which the first may be shorter; rows that
share a doc_id are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .bpe import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ROWS = 256


def cut_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's ids (its end id included) with their checksums, and the part they were made in."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            own, rows = batch.column("doc_id").to_pylist(), []
            for doc, ids in zip(own, enc.encode_many(batch.column("text").to_pylist()), strict=True):
                ids = np.concatenate([ids.astype("<u4"), end])
                head = len(ids) % max_tokens or max_tokens
                bounds = [0, *range(head, len(ids) + 1, max_tokens)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(rows), pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "part"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE + ", part long")


def plan_packing(
    counts: dict[int, int],
    max_tokens: int = 2048,
    max_docs: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.05),
    rule: str = "residual_norm",
) -> np.ndarray:
    """Best fit, longest first, over counts of pieces by length.

    Returns rows (length, first rank, one past the last rank, first sequence, pieces in each sequence, token offset).
    max_docs and max_cost: capacities besides tokens; by default they never bind (a sequence can't have more
    documents than tokens, nor a cost over max_tokens squared).
    """
    if rule not in ("residual_norm", "dot_product"):
        raise ValueError(f"unknown rule {rule!r}")
    caps = np.array([max_tokens, max_docs or max_tokens, max_cost or max_tokens**2], dtype=np.int64)
    w = np.array(weights)
    res = np.zeros((0, 3), dtype=np.int64)  # a residual of each run of sequences: first to first + count, all alike
    first, count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length**2], dtype=np.int64)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        room = (res // need).min(axis=1) if len(res) else np.zeros(0, dtype=np.int64)
        fits = np.flatnonzero(room > 0)
        if len(fits):
            after, item = (res[fits] - need) / caps, need / caps
            score = (w * after**2).sum(axis=1) if rule == "residual_norm" else -(w * item * (res[fits] / caps)).sum(axis=1)
            order = fits[np.lexsort((first[fits], score))]
            total = np.cumsum(room[order] * count[order])
            for i in order[: int(np.searchsorted(total, left)) + 1].tolist():
                k, n = int(room[i]), min(int(count[i]), left // int(room[i]))
                if n:  # whole sequences that take as many as they have room for
                    plan.append((length, rank, rank + n * k, first[i], k, max_tokens - res[i, 0]))
                    left, rank = left - n * k, rank + n * k
                    if n < count[i]:
                        res, first, count = np.vstack([res, res[i]]), np.append(first, first[i] + n), np.append(count, count[i] - n)
                        rest = len(res) - 1
                        count[i] = n
                    else:
                        rest = None
                    res[i] = res[i] - k * need
                else:
                    rest = i
                if left and rest is not None and left < k:  # one more sequence takes what is left
                    plan.append((length, rank, rank + left, first[rest], left, max_tokens - res[rest, 0]))
                    if count[rest] > 1:
                        res, first, count = np.vstack([res, res[rest]]), np.append(first, first[rest] + 1), np.append(count, count[rest] - 1)
                        count[rest] = 1
                    res[rest] = res[rest] - left * need
                    left = 0
                if not left:
                    break
        if left:
            k = int((caps // need).min())
            for n, each in ((left // k, k), (1 if left % k else 0, left % k)):
                if n:
                    plan.append((length, rank, rank + n * each, opened, each, 0))
                    res, first, count = np.vstack([res, caps - each * need]), np.append(first, opened), np.append(count, n)
                    rank, opened = rank + n * each, opened + n
            left = 0
        alive = res[:, 0] > 0
        res, first, count = res[alive], first[alive], count[alive]
    return np.array(plan, dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, max_tokens: int = 2048, **options) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, part); see :func:`plan_packing`."""
    spark = pieces.sparkSession
    table = scratch.keep(pieces, "pieces", _ROWS)
    by_part = scratch.keep(table.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    plan = plan_packing(counts, max_tokens, **options)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32", "start")  # a part's own pieces only
    ranked = table.withColumn("nth", F.row_number().over(within) - 1)
    ranked = ranked.join(bases.hint("merge"), ["part", "length"])  # grows with the parts: never a broadcast
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    held = spark.sparkContext.broadcast(plan)  # its size depends on max_tokens, not on the data
    n_lengths = max_tokens + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        order = np.lexsort((p[:, 1], p[:, 0]))
        length, lo, _, first, each, at = p[order].T
        begin = np.searchsorted(length, np.arange(n_lengths + 1))
        wide = np.int64(1) << 48
        key = length * wide + lo
        for batch in batches:
            own, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(key, own * wide + rank, side="right") - 1
            assert (i >= begin[own]).all()
            nth = rank - lo[i]
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(first[i] + nth // each[i]), pa.array(at[i] + nth % each[i] * own)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """Tokenizes, cuts and packs; one row for each piece."""
    return pack(cut_documents(docs, tokenizer, max_tokens, end_id), max_tokens, **options)
