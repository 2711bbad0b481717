"""Operator 6: SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 bytes; two that differ in at most ``distance`` bits share at least
``8 - distance`` of them in place.  The index lists fingerprints under (positions,
bytes there) for a family of position sets such that any ``8 - distance`` shared
positions hold a set whole: for distance 3, the eight triples inside either half
(any five positions have three in one half), or all 56 quintuples.  Within a list,
pairs are tallied by shared positional bytes, those below the guaranteed minimum are
dropped, and the rest verified by their differing bits.

Equal fingerprints are one entry, so exact copies cost nothing.  The position sets
grow with the number of fingerprints, which keeps lists short; a list that is long
all the same, as of many near copies of one text, is split by further positions
inside its task.  A list gives the links of a spanning forest only: never all its
pairs, yet no two linked fingerprints stay apart.  Components are found over
fingerprints in the cluster and brought back to the documents.

Cases: a null text, or one without words, has fingerprint zero and links like any
other; fewer words than a shingle's make one shingle; equal rows get equal results; a
null doc_id is no candidate for a component's id unless it is alone; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, workers
from .components import components
from .words import Words, slices, utf8

#: Fingerprints in a list up to which all its pairs are compared at once.
DIRECT = 1024
#: Distinct fingerprints up to which triples of bytes index them: a list then has 4 fingerprints on average at most.
#: Beyond, quintuples do: 56 entries a fingerprint instead of 8, and lists shorter by a factor of 2**16.  Either index
#: holds all pairs within the distance, so the result is the same; the tests run both.
FEW = 1 << 26


def fingerprints(column: pa.Array, words: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text: majority of the bits of its shingles' XXH64."""
    from xxhash import xxh64_intdigest

    w = Words(*utf8(column), lower=True)
    data, at = w.spaced()
    raw, n = data.tobytes(), len(w.starts)
    last = np.append(at[1:], len(data)) - 1  # the blank after each word
    first = np.flatnonzero((w.room() >= words) | (w.positions() == 0))  # a shorter text is one shingle
    stop = last[np.minimum(first + words, np.repeat(w.cuts[1:], w.counts)[first]) - 1] if n else first
    h = np.array([xxh64_intdigest(raw[a:b], seed) for a, b in zip(at[first].tolist(), stop.tolist(), strict=True)], dtype=np.uint64)
    out = np.zeros(len(column), dtype=np.uint64)
    own = np.flatnonzero(w.counts > 0)
    if not len(own):
        return out
    heads = np.searchsorted(first, w.cuts[:-1][own])
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    total = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    size = np.diff(np.append(heads, len(h)))
    major = np.packbits(2 * total > size[:, None], axis=1)
    out[own] = np.ascontiguousarray(major).view(">u8").ravel()
    return out


def position_sets(distance: int, many: bool) -> list[tuple[int, ...]]:
    """Sets of byte positions such that fingerprints within the distance agree on one of them."""
    if distance == 3 and not many:
        return [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
    return list(combinations(range(8), 8 - distance))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def link(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among distinct fingerprints."""
    forest, out = _Forest(len(values)), []

    def compare(own: np.ndarray) -> None:
        v = values[own]
        for a in range(0, len(v), 256):
            x = v[a : a + 256, None] ^ v[None, :]
            shared = np.zeros(x.shape, dtype=np.uint8)
            for p in range(8):
                shared += (x >> np.uint64(8 * p)) & np.uint64(255) == 0
            i, j = np.nonzero((shared >= 8 - distance) & (shared < 8))
            near = np.bitwise_count(x[i, j]) <= distance
            for s, t in zip(own[a + i[near]].tolist(), own[j[near]].tolist(), strict=True):
                if forest.join(s, t):
                    out.append((s, t))

    def split(own: np.ndarray, sets: list[np.uint64]) -> None:
        """Lists under each mask; what is still long is split by the next masks."""
        if len(own) <= DIRECT or not sets:
            compare(own)
            return
        for mask in sets[0]:
            key = values[own] & mask
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(own[order], cut):
                if len(part) > 1:
                    split(part, sets[1:])

    byte = [np.uint64(255 << (8 * p)) for p in range(8)]
    fives = [np.bitwise_or.reduce([byte[p] for p in s]) for s in combinations(range(8), 8 - distance)]
    # distance + 1 disjoint bit classes: one of them is equal in any linked pair
    strands = [np.uint64(sum(1 << b for b in range(64) if b % (distance + 1) == k)) for k in range(distance + 1)]
    split(np.arange(len(values)), [fives, strands])
    return out


def near_links(prints: DataFrame, distance: int = 3, column: str = "fp") -> DataFrame:
    """(a, b): links between distinct fingerprints (64-bit integers) that connect all within the distance."""
    with scratch.brief(prints.sparkSession):
        return _near_links(prints, distance, column)


def _near_links(prints: DataFrame, distance: int, column: str) -> DataFrame:
    spark = prints.sparkSession
    distinct = scratch.keep(prints.select(F.col(column).alias("fp")).distinct(), "prints")
    sets = position_sets(distance, distinct.count() > FEW)
    masks = [int(np.array([sum(255 << (8 * p) for p in s)], dtype=np.uint64).view(np.int64)[0]) for s in sets]
    keyed = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bytes")) for k, m in enumerate(masks)])).alias("key"),
    ).select("key.k", "key.bytes", "fp")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (k, bytes); a list may run over batches."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def done(k, by, fp):
            cut = np.flatnonzero((np.diff(k) != 0) | (np.diff(by) != 0)) + 1
            a, b = np.append(0, cut), np.append(cut, len(k))
            left, right = [], []
            for x, y in zip(a[b - a > 1].tolist(), b[b - a > 1].tolist(), strict=True):
                own = fp[x:y]
                for i, j in link(own.view(np.uint64), distance):
                    left.append(own[i])
                    right.append(own[j])
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy().copy() for c in ("k", "bytes", "fp")))
            k, by, _ = held[-1]
            new = np.flatnonzero((k != k[-1]) | (by != by[-1]))
            if len(new):  # all before the last list is complete
                stop = new[-1] + 1
                parts = [*held[:-1], tuple(x[:stop] for x in held[-1])]
                yield done(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                held = [tuple(x[stop:] for x in held[-1])]
        if held:
            yield done(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = keyed.repartition("k", "bytes").sortWithinPartitions("k", "bytes", "fp")
    links = scratch.keep(dealt.mapInArrow(lists, "a long, b long"), "links", outer=True)
    scratch.tidy(spark)
    return links


def near_duplicates(docs: DataFrame, distance: int = 3, words: int = 3, more_links: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, row, fp, component_id, root) for each row; row is a hash of its text, root the same in a component.

    ``more_links`` gives further links (a, b) of fingerprints from the docs and their (row, fp).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for whole in batches:
            for batch in slices(whole, "text"):
                fp = fingerprints(batch.column("text"), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fp)], names=["doc_id", "row", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    prints = scratch.keep(rows.mapInArrow(run, "doc_id long, row long, fp long"), "fingerprints")
    with scratch.brief(docs.sparkSession):
        links = near_links(prints, distance)
        if more_links is not None:
            links = links.unionByName(more_links(docs, prints))
        roots = components(links)
        least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
        of_print = least.join(roots, least["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
        of_print = scratch.keep(of_print, "print-roots", outer=True)
    # a table, so that the join below is of two plain shuffles, of which Spark can split a very large component's
    of_root = scratch.keep(of_print.groupBy("root").agg(F.min("least").alias("component_id")), "root-ids")
    labels = of_print.join(of_root, "root").select("fp", "component_id", "root")
    return prints.join(labels, "fp").select("doc_id", "row", "fp", "component_id", "root")


def hexadecimal(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
