"""Near copies by word shingles: Jaccard similarity of two texts' sets of five-word shingles, verified exactly.

Candidates come from MinHash bands: two sets that meet in a band (all of its ``ROWS``
minima agree) are tied, and a band ties all its sets to the least one, so that rows
grow with the sets and never with their pairs.  A pair with similarity 0.8 meets in
one of the bands but for a chance of (1 - 0.8**6)**48, or 5 in ten million; above that it
is less.  Components of ties are *clusters*; a set is sent once, to its cluster's
task, where :func:`similar` compares exactly: each pair in reach (sets that share one
of their rarest shingles, as any pair at the threshold must) that is not yet linked
is verified by its common shingles.

Equal sets are one entry.  A group is cut in blocks, each pair of which is a task's, so
that a task holds at most about ``2 * MOST`` sets at a time.  A cluster of more than
``MOST * COPIES`` sets is compared band by band.  So no pair that meets in a band is left
out, whatever the size of a group, and each task gives the links of a spanning forest only.

Cases: words are as in :mod:`words`, ASCII letters lowered; fewer words than a
shingle's make one shingle; texts without words are equal to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, workers
from .components import components
from .words import Words, mix, slices, utf8, window_hashes

WORDS = 5
#: Similarity from which texts are near copies, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 48, 6
#: Groups are cut in blocks of about FINE sets, whose pairs are tasks' own, as long as a set has COPIES copies at most;
#: larger groups in as many blocks, of up to MOST sets.
FINE, COPIES, MOST = 128, 48, 4096
_ODD = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's begin, with the end."""
    w = Words(*utf8(column), lower=True)
    room, each = w.room(), w.hashes()
    first = np.flatnonzero((room >= words) | (w.positions() == 0))
    h = window_hashes(each, words)[first] if len(each) else each
    for size in range(1, words):  # shorter texts
        short = np.flatnonzero(room[first] == size)
        if len(short):
            h[short] = window_hashes(each, size)[first[short]]
    text = np.repeat(np.arange(len(column)), w.counts)[first]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(column) + 1))


def signatures(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set a hash, equal for equal sets, and its key in each band."""
    own = np.flatnonzero(np.diff(cuts))
    ids, keys = np.zeros(len(cuts) - 1, dtype=np.uint64), np.zeros((len(cuts) - 1, BANDS), dtype=np.uint64)
    if not len(own):
        return ids, keys
    heads = cuts[:-1][own]
    ids[own] = mix(np.add.reduceat(mix(h), heads) + np.diff(cuts)[own].astype(np.uint64))
    for b in range(BANDS):
        key = np.full(len(own), b + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key ^ np.minimum.reduceat(h * _ODD[b * ROWS + r], heads))
        keys[own, b] = key
    return ids, keys


def similar(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among distinct sorted sets: similarity of at least the fraction."""
    up, down = least
    n = np.array([len(s) for s in sets])
    by_size = np.argsort(n, kind="stable")
    sets, n = [sets[i] for i in by_size], n[by_size]
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), dtype=np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    token, at = rank[token], np.append(0, np.cumsum(n))
    # a pair at the threshold shares up/down of the larger set's shingles at least, so one of these rarest
    prefix = [np.sort(token[a:b])[: k - -(-up * k // down) + 1] for a, b, k in zip(at[:-1], at[1:], n.tolist(), strict=True)]
    who = np.repeat(np.arange(len(sets)), [len(p) for p in prefix])
    flat = np.concatenate(prefix)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    label, out = np.arange(len(sets)), []
    for i, p in enumerate(prefix):
        near = np.zeros(len(sets), dtype=bool)
        for a, b in zip(np.searchsorted(flat, p).tolist(), np.searchsorted(flat, p, side="right").tolist(), strict=True):
            if b - a > 1:
                near[who[a:b]] = True
        found = np.flatnonzero(near[:i] & (label[:i] != label[i]) & (down * n[:i] >= up * n[i]))
        while len(found):
            j = found[-1]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            found = found[:-1]
            if (up + down) * both >= up * (n[i] + n[j]):
                out.append((int(by_size[j]), int(by_size[i])))
                label[label == label[j]] = label[i]
                found = found[label[found] != label[i]]
    return out


def _groups(clusters: DataFrame, bands: DataFrame, most: int) -> DataFrame:
    """(group, i, j, set): what is compared together, of clusters (node, root) and bands (set, band)."""
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"))
    members = clusters.join(sizes, "root").select(F.col("node").alias("set"), "root", "n")
    small = _cut(members.where(F.col("n") <= most * COPIES).withColumnRenamed("root", "group"), most)
    if sizes.where(F.col("n") > most * COPIES).isEmpty():
        return small
    met = bands.join(members.where(F.col("n") > most * COPIES).select("set"), "set").distinct()
    full = met.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    return small.unionByName(_cut(met.join(full, "band").withColumnRenamed("band", "group"), most))


def _cut(rows: DataFrame, most: int) -> DataFrame:
    """Groups (group, n, set) in pairs of blocks: of FINE sets while that makes few copies, of more then, of ``most`` at last."""
    blocks = F.greatest(F.least(F.ceil(F.col("n") / FINE), F.lit(COPIES)), F.ceil(F.col("n") / most)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set")


def copy_links(docs: DataFrame, prints: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b): fingerprints to link, of texts with equal or similar shingle sets, from docs (text) and prints (row, fp); row is the text's hash.

    most: see ``MOST``.
    """
    with scratch.brief(docs.sparkSession):
        return _copy_links(docs, prints, most or MOST)


def _copy_links(docs: DataFrame, prints: DataFrame, most: int) -> DataFrame:
    spark = docs.sparkSession

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, keys = signatures(*shingle_sets(batch.column("text")))
                bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids.view(np.int64)), bands], names=["row", "set", "bands"])

    rows = docs.select(F.xxhash64("text").alias("row"), "text")
    signed = scratch.keep(rows.mapInArrow(sign, "row long, set long, bands array<long>"), "signatures")
    of_row = scratch.keep(signed.select("row", "set").distinct(), "row-sets")  # copies are one row from here on
    bands = signed.where("set <> 0").select("set", "bands").dropDuplicates(["set"]).select("set", F.explode("bands").alias("band"))
    heads = bands.groupBy("band").agg(F.min("set").alias("head"), F.max("set").alias("last")).where("head < last").select("band", "head")
    ties = bands.join(heads, "band").where("set <> head").select(F.col("set").alias("a"), F.col("head").alias("b")).distinct()
    clusters = scratch.keep(components(scratch.keep(ties, "ties")), "clusters")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for whole in batches:
            for batch in slices(whole, "text"):
                h, cuts = shingle_sets(batch.column("text"))
                each = [h[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array(each, pa.binary())], names=["set", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (group, i, j, set); a group may run over batches."""
        workers.release()
        group, ids, sets = None, [], []

        def done():
            pairs = similar(sets) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *g, s, h in zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j", "set")), batch.column("hashes"), strict=True):
                if g != group:
                    yield done()
                    group, ids, sets = g, [], []
                ids.append(s)
                sets.append(np.frombuffer(h.as_py(), dtype=np.uint64))
        yield done()

    # one text of each set
    chosen = of_row.join(clusters.select(F.col("node").alias("set")), "set").groupBy("set").agg(F.min("row").alias("_row"))
    texts = rows.join(chosen, F.col("row") == F.col("_row")).dropDuplicates(["set"]).select("set", "text")
    hashes = scratch.keep(texts.mapInArrow(read, "set long, hashes binary"), "hashes")
    dealt = _groups(clusters, bands, most)
    pairs = dealt.join(hashes, "set").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "set")
    pairs = scratch.keep(pairs.mapInArrow(compare, "a long, b long"), "similar")

    # sets speak for fingerprints: a set's least one, to which its others are linked
    of_set = scratch.keep(of_row.join(prints.select("row", "fp").distinct(), "row").select("set", "fp").distinct(), "set-prints")
    first = of_set.groupBy("set").agg(F.min("fp").alias("first"))
    inside = of_set.join(first, "set").where("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    one = pairs.join(first.withColumnsRenamed({"set": "a", "first": "x"}), "a").join(first.withColumnsRenamed({"set": "b", "first": "y"}), "b")
    links = scratch.keep(inside.unionByName(one.select(F.col("x").alias("a"), F.col("y").alias("b"))), "copy-links", outer=True)
    scratch.tidy(spark)
    return links
