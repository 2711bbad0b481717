"""Operator 11: near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors of one label and length are packed into tiles.  A unit vector u is held as
``s * q`` with 8-bit integers q; what that loses, e = u - s * q, has a length that is
computed, so for any other vector v the product of the integers bounds the cosine:

    |u.v - s_u s_v q_u.q_v| <= |e_u| + (1 + |e_u|) |e_v|

1. Equal vectors of a label are one class with a count, so copies cost nothing.
2. Classes are put near their like (by the nearest of a few pivots) and packed into
   tiles.  A tile is compared with itself as it is packed.
3. Tile pairs meet as integers, a task for each pair of parts.  Pairs whose caps (a
   centre, and the widest angle to it) lie too far apart for any link don't meet.
   What is left of a pair are the rows that the bound can't rule out.
4. Only for these tiles are the vectors fetched, and only pairs that the bound can't
   rule out are computed again, in double precision.
5. A class gets the counts of the classes it links with; a tile pair gives a spanning
   forest between the groups inside its tiles, never its pairs; components follow.

Pivots only decide which tile a vector is in: any choice gives the same result.

Cases: vectors that are null, empty, zero or hold a null or non-finite component, and
rows without a label, link with nothing and stay; vectors of different lengths don't
link; rows that repeat an id are vectors each; a null id counts as a vector but names
no component unless it is alone in it (then null, kept); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, workers
from .components import components

#: Vectors in a tile at most.
TILE = 1024
#: Tiles in a part on average: a task compares the tiles of a pair of parts.
SIDE = 4
#: Vectors, those with the least hashes, that tell which vectors are put together.
PIVOTS = 128
#: What rounding in double precision may add to a bound.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit integers, the scale of each row, and a bound of the length of what each row loses."""
    scale = np.abs(u).max(axis=1) / 127.0
    q = np.rint(u / scale[:, None])
    lost = u - scale[:, None] * q
    return q.astype(np.int8), scale, np.sqrt(np.einsum("ij,ij->i", lost, lost)) * (1 + SLACK) + SLACK


def possible(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Which pairs of rows may have a cosine of the threshold or more; a and b as :func:`quantise` gives them."""
    exact = np.float32 if 127 * 127 * a[0].shape[1] < 1 << 24 else np.float64  # every partial sum fits the mantissa
    product = (a[0].astype(exact) @ b[0].astype(exact).T).astype(np.float64)
    product *= a[1][:, None]
    product *= b[1][None, :]
    product += b[2][None, :] * (1 + a[2][:, None])
    product += a[2][:, None]
    return product >= threshold - SLACK


def linked(u: np.ndarray, v: np.ndarray, mask: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs in the mask those whose cosine in double precision is the threshold or more."""
    i, j = np.nonzero(mask)
    if len(i) * 8 > mask.size:  # many: as one product
        return np.nonzero(mask & (u @ v.T >= threshold))
    near = np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), 1 << 15):
        s = slice(k, k + (1 << 15))
        near[s] = np.einsum("ij,ij->i", u[i[s]], v[j[s]]) >= threshold
    return i[near], j[near]


def least_joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of the numbers 0 to n - 1 that each is joined with by the pairs (i, j)."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        least = least[least]
        if (least == before).all():
            return least


def _matrix(lists: pa.Array, own: np.ndarray, d: int) -> np.ndarray:
    return lists.take(pa.array(own)).flatten().to_numpy().reshape(len(own), d)


def _placed(classes: DataFrame) -> DataFrame:
    """Adds code and near: the nearest pivot and the cosine with it. PIVOTS rows are collected, whatever the input."""
    chosen = classes.select("h1", "h2", "x").orderBy("h1", "h2").limit(PIVOTS).toArrow().column("x").to_pylist()
    by_length = {}
    for d in {len(x) for x in chosen}:
        by_length[d] = unit(np.array([x for x in chosen if len(x) == d]))
    held = classes.sparkSession.sparkContext.broadcast(by_length)

    @F.arrow_udf("struct<code:int,near:double>")
    def nearest(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        workers.release()
        for x in columns:
            size = x.value_lengths().to_numpy(zero_copy_only=False)
            code, near = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
            for d, pivots in held.value.items():
                own = np.flatnonzero(size == d)
                for part in np.array_split(own, -(-len(own) // TILE)) if len(own) else ():
                    cos = unit(_matrix(x, part, d)) @ pivots.T
                    code[part], near[part] = cos.argmax(axis=1), cos.max(axis=1)
            yield pa.StructArray.from_arrays([pa.array(code), pa.array(near)], names=["code", "near"])

    return classes.withColumn("at", nearest("x")).select("*", "at.code", "at.near").drop("at")


_TILE = "number long, d int, centre array<double>, radius double, h1 array<long>, h2 array<long>, least array<long>, n array<long>, links array<long>, grp array<int>, q binary, scale binary, lost binary, x binary"


def _tiles(classes: DataFrame, threshold: float) -> DataFrame:
    """One row a tile, already compared with itself; a class's number is its tile's number and its place."""
    kind = classes.schema["label"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        workers.release()
        number, held, last = TaskContext.get().partitionId() << 40, [], None

        def full() -> pa.RecordBatch:
            nonlocal number, held
            rows = pa.Table.from_batches(held).combine_chunks()
            m, d = rows.num_rows, len(rows.column("x")[0])
            x = rows.column("x").chunk(0).flatten().to_numpy().reshape(m, d)
            u = unit(x)
            q = quantise(u)
            n = rows.column("n").to_numpy()
            i, j = linked(u, u, np.triu(possible(q, q, threshold), 1), threshold)
            links = np.zeros(m, dtype=np.int64)
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            centre = u.mean(axis=0)
            length = np.sqrt(centre @ centre)
            centre, radius = (centre / length, float(np.arccos(np.clip((u @ centre / length).min(), -1.0, 1.0))) + 1e-6) if length > 1e-6 else (u[0], np.pi)
            lists = lambda a, t: pa.array([a], pa.list_(t))
            columns = {"label": rows.column("label").chunk(0).slice(0, 1), "number": pa.array([number]), "d": pa.array([d], pa.int32()), "centre": lists(centre, pa.float64()), "radius": pa.array([radius])}
            columns |= {c: lists(rows.column(c).to_pylist(), pa.int64()) for c in ("h1", "h2", "least")} | {"n": lists(n, pa.int64()), "links": lists(links, pa.int64())}
            columns |= {"grp": lists(least_joined(m, i, j).astype(np.int32), pa.int32())}
            columns |= {name: pa.array([v.tobytes()], pa.binary()) for name, v in zip(("q", "scale", "lost", "x"), (*q, u), strict=True)}
            number, held = number + m, []
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        def size() -> int:
            return sum(b.num_rows for b in held)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "d", "code")), strict=True))
            begin = 0
            while begin < len(keys):
                end = begin + 1
                while end < len(keys) and keys[end] == keys[begin]:
                    end += 1
                # a tile has one label and length, and rather one pivot
                if held and keys[begin] != last and (keys[begin][:2] != last[:2] or size() >= TILE // 4):
                    yield full()
                last = keys[begin]
                while begin < end:
                    some = min(end - begin, TILE - size())
                    held.append(batch.slice(begin, some))
                    begin += some
                    if size() == TILE:
                        yield full()
        if held:
            yield full()

    order = ["label", "d", "code", "near", "h1", "h2"]
    dealt = classes.repartitionByRange(*order).sortWithinPartitions(*order)  # a label with very many vectors is dealt over tasks
    return scratch.keep(dealt.select("label", "d", "code", "h1", "h2", "least", "n", "x").mapInArrow(pack, f"label {kind}, {_TILE}"), "tiles")


def _floats(x: dict, side: str, rows: np.ndarray | None = None) -> tuple:
    """A tile's integers, scales and losses from their bytes."""
    scale, lost = (np.frombuffer(x[f"{side}_{c}"], dtype=np.float64) for c in ("scale", "lost"))
    return np.frombuffer(x[f"{side}_q"], dtype=np.int8).reshape(len(scale), -1), scale, lost


def _possible_cells(tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b, a_rows, b_rows): tile pairs with pairs that the bound can't rule out, and the rows of either in these pairs, as bits."""
    parts = tiles.groupBy("label", "d").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("parts"))
    own = tiles.select("label", "d", "number", "centre", "radius", "q", "scale", "lost").join(parts, ["label", "d"])
    own = own.withColumn("part", F.pmod(F.xxhash64("number"), "parts").cast("int"))
    named = lambda t, side: t.select("label", "d", "i", "j", *(F.col(c).alias(f"{side}_{c}") for c in ("number", "centre", "radius", "q", "scale", "lost")))
    a = named(own.withColumn("i", F.col("part")).withColumn("j", F.explode(F.sequence("part", F.col("parts") - 1))), "a")
    b = named(own.withColumn("j", F.col("part")).withColumn("i", F.explode(F.sequence(F.lit(0), "part"))), "b")
    cos = F.aggregate(F.zip_with("a_centre", "b_centre", lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    close = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))) <= F.col("a_radius") + F.col("b_radius") + acos(max(-1.0, min(1.0, threshold))) + 1e-6
    met = a.join(b, ["label", "d", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("a_number") < F.col("b_number"))) & close)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for batch in batches:
            out: list[tuple] = []
            for x in batch.to_pylist():
                mask = possible(_floats(x, "a"), _floats(x, "b"), threshold)
                rows, columns = mask.any(axis=1), mask.any(axis=0)
                if rows.any():
                    out.append((x["a_number"], x["b_number"], np.packbits(rows).tobytes(), np.packbits(columns).tobytes()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["a", "b", "a_rows", "b_rows"])

    met = met.select(*(f"{side}_{c}" for side in "ab" for c in ("number", "q", "scale", "lost")))
    return scratch.keep(met.mapInArrow(compare, "a long, b long, a_rows binary, b_rows binary"), "cells")


def _links(cells: DataFrame, tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): what a class's links add to its count (b is null), and edges that join the groups of two tiles."""
    full = lambda side: tiles.select(F.col("number").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("x", "n", "grp")))
    met = cells.join(full("a").hint("merge"), "a").join(full("b").hint("merge"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for batch in batches:
            for x in batch.to_pylist():
                rows, u, n, grp = [], [], [], []
                for side in "ab":
                    size = len(x[f"{side}_n"])
                    own = np.flatnonzero(np.unpackbits(np.frombuffer(x[f"{side}_rows"], dtype=np.uint8))[:size])
                    rows.append(own)
                    u.append(np.frombuffer(x[f"{side}_x"], dtype=np.float64).reshape(size, -1)[own])
                    n.append(np.array(x[f"{side}_n"], dtype=np.int64)[own])
                    grp.append(np.array(x[f"{side}_grp"], dtype=np.int64)[own])
                i, j = linked(*u, possible(quantise(u[0]), quantise(u[1]), threshold), threshold)
                if not len(i):
                    continue
                add = np.zeros(len(rows[0]), dtype=np.int64), np.zeros(len(rows[1]), dtype=np.int64)
                np.add.at(add[0], i, n[1][j])
                np.add.at(add[1], j, n[0][i])
                size = len(x["a_n"])
                pairs = np.unique(grp[0][i] * (1 << 32) + grp[1][j])
                least = least_joined(size + len(x["b_n"]), pairs >> 32, size + (pairs & 0xFFFFFFFF))
                class_of = np.concatenate([x["a"] + np.arange(size), x["b"] + np.arange(len(x["b_n"]))])
                node = np.flatnonzero(least != np.arange(len(least)))
                got = [np.flatnonzero(v) for v in add]
                counted = np.concatenate([x[side] + r[g] for side, r, g in zip("ab", rows, got, strict=True)])
                a = np.concatenate([counted, class_of[node]])
                b = pa.array(np.concatenate([np.zeros(len(counted), dtype=np.int64), class_of[least[node]]]), mask=np.arange(len(a)) < len(counted))
                total = np.concatenate([*(v[g] for v, g in zip(add, got, strict=True)), np.zeros(len(node), dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(total)], names=["a", "b", "n"])

    return scratch.keep(met.mapInArrow(verify, "a long, b long, n long"), "links")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    if not 0.0 < threshold <= 1.0:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    x = F.col("x")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0.0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    takes_part = F.col("label").isNotNull() & x.isNotNull() & finite
    # two chains of hashes that start from different seeds: equal vectors have equal ones, others don't agree on both
    rows = rows.withColumn("h1", F.when(takes_part, F.xxhash64("x"))).withColumn("h2", F.when(takes_part, F.xxhash64(F.lit(1), "x")))
    with scratch.brief(spark):
        classes = rows.where("h1 is not null").groupBy("label", "h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("x").alias("x"))
        classes = scratch.keep(classes.withColumn("d", F.size("x")), "classes")
        tiles = _tiles(scratch.keep(_placed(classes), "placed"), threshold)
        found = _links(_possible_cells(tiles, threshold), tiles, threshold)
        each = F.posexplode(F.arrays_zip("h1", "h2", "n", "least", "links", "grp")).alias("pos", "c")
        own = tiles.select("label", "number", each).select("label", (F.col("number") + F.col("pos")).alias("class"), (F.col("number") + F.col("c.grp")).alias("head"), "c.*")
        own = scratch.keep(own, "members")
        inside = own.where("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b"))
        roots = components(inside.unionByName(found.where("b is not null").select("a", "b")))
        more = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("more"))
        own = own.join(more, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
        n_links = F.col("links") + F.coalesce("more", F.lit(0)) + F.col("n") - 1
        own = scratch.keep(own.select("label", "h1", "h2", "least", F.coalesce("root", "class").alias("root"), n_links.cast("long").alias("n_links")), "rooted")
        least = scratch.keep(own.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # a table, so that a large component's side of the join can be split
        labels = scratch.keep(own.join(least, "root").select(F.col("label").alias("c_label"), F.col("h1").alias("c_h1"), F.col("h2").alias("c_h2"), "n_links", "component_id"), "labels", outer=True)
    same = (F.col("label") == F.col("c_label")) & (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2"))
    out = rows.select("vec_id", "label", "h1", "h2").join(labels, same, "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
