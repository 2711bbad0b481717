import duckdb
import numpy as np
import pytest

from tessera.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, label int, n long, class string, h1 long"


def rows_of(rnd, n=300, d=12, groups=9):
    """Clusters of near vectors, copies, repeated ids and rows, and everything that takes no part."""
    heads = rnd.normal(size=(groups, d))
    out = []
    for k in range(n):
        x = heads[k % groups] + rnd.normal(size=d) * rnd.choice([0.0, 0.05, 0.25, 0.4])
        out.append((k, [float(v) for v in np.float32(x * rnd.choice([0.1, 1.0, 30.0]))], int(k % 3)))
    out += [out[5], out[5], (7, out[9][1], 0), (None, out[0][1], 0), (None, [9.0] * d, 2), (None, None, 1)]
    out += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * d, 1), (1003, [1.0, None] + [0.0] * (d - 2), 1), (1004, [float("nan")] * d, 1), (1005, [float("inf")] * d, 1), (1006, out[0][1], None), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0), (1009, [-0.0, 0.0], 0)]
    return [(*r, 1, "x", 2) for r in out]


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table embeddings(vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", [list(r[:3]) for r in rows])
    return sorted(con.execute(f"select vec_id, n_links, component_id, kept from ({queries.ORACLE_SQL['op11_embedding_dedup']})").fetchall(), key=repr)


@pytest.mark.parametrize("tile, side, pivots", [(1024, 4, 128), (16, 2, 8), (7, 1, 1)])
def test_links_as_in_sql(spark, monkeypatch, tile, side, pivots):
    monkeypatch.setattr(neighbours, "TILE", tile)
    monkeypatch.setattr(neighbours, "SIDE", side)
    monkeypatch.setattr(neighbours, "PIVOTS", pivots)
    rows = rows_of(np.random.default_rng(tile))
    got = neighbours.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == by_sql(rows)


def test_empty(spark):
    got = neighbours.near_vectors(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.count() == 0


def test_one_hot_group(spark, monkeypatch):
    """Thousands of copies and very many near copies in one label: no pairs leave a task."""
    monkeypatch.setattr(neighbours, "TILE", 64)
    rnd = np.random.default_rng(1)
    head = rnd.normal(size=16)
    near = [[float(v) for v in head + rnd.normal(size=16) * 0.02] for _ in range(400)]
    rows = [(k, near[k % 400] if k < 400 else [float(v) for v in head], 1, 1, "x", 2) for k in range(3000)]
    seen = []
    keep = neighbours.scratch.keep
    monkeypatch.setattr(neighbours.scratch, "keep", lambda df, name, *a, **b: seen.append((name, t := keep(df, name, *a, **b), t.count())) or t)
    got = neighbours.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(2999, 0)} and sum(r["kept"] for r in got) == 1
    assert max(n for _, _, n in seen) < 20_000  # 80,000 pairs of different vectors link


@pytest.mark.parametrize("d", [1, 3, 64, 2000])
def test_the_bound_holds(d):
    """Nothing at or above the threshold is ruled out, and of the rest almost all is."""
    rnd = np.random.default_rng(d)
    x = rnd.normal(size=(400, d)) * np.exp(rnd.normal(size=(400, 1)) * 20)
    x[200:] = x[:200] + np.abs(x[:200]).max(axis=1, keepdims=True) * rnd.normal(size=(200, d)) * 0.05
    u = neighbours.unit(x)
    q = neighbours.quantise(u)
    cos = u @ u.T
    for t in (0.2, 0.9, 0.93, 0.999):
        may = neighbours.possible(q, q, t)
        assert not ((cos >= t) & ~may).any()
        assert (may & (cos < t - 0.1)).sum() <= (d == 1) * may.size


def test_scales_beyond_squares(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (3, [1e200, -1e200], 1)]
    got = neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_text_labels(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, [1.0, 0.0], "b")]
    got = neighbours.near_vectors(spark.createDataFrame(rows, "k long, v array<double>, g string"), id_col="k", vector_col="v", label_col="g").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
