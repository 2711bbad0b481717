import numpy as np
import pytest

from tessera.operators import ivf


def test_recall_and_pruning(spark, tmp_path):
    """Recall against all pairs, exact scores, every row in the index, and only probed partitions read."""
    rnd = np.random.default_rng(0)
    heads = rnd.normal(size=(30, 24))
    x = heads[rnd.integers(0, 30, 3000)] + rnd.normal(size=(3000, 24)) * 0.45
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    built = ivf.build(e, str(tmp_path / "i"))
    assert len(built.centres) == 55 and built.vectors.count() == 3000
    assert sorted(i for r in built.codes.collect() for i in r["ids"]) == list(range(3000))
    asked = e.where("vec_id % 100 = 0 and vec_id < 3000").withColumnRenamed("vec_id", "query_id")
    got = ivf.search(built, asked, 10, 8)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 100):
        cos = u @ u[q]
        own = sorted((r for r in got.where(f"query_id = {q}").collect()) if q < 300 else [], key=lambda r: r["rank"])
        assert [r["score"] for r in own] == pytest.approx([cos[r["id"]] for r in own])
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    for q, own in found.items():
        hits += len(own & set(np.argsort(-(u @ u[q]), kind="stable")[:10].tolist()))
    assert len(found) == 30 and hits / 300 >= 0.9
    few = ivf.search(built, asked.limit(1), 10, 2)
    few.collect()
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    everything = ivf.search(built, asked.limit(3), 10, 55, 3000).collect()
    assert all(r["id"] in set(np.argsort(-(u @ u[r["query_id"]]), kind="stable")[:10].tolist()) for r in everything) and len(everything) == 30
