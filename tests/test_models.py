import collections

import pytest
from pyspark.sql import functions as F

from tessera.functions.models import guarded, hashing_embedder
from tessera.functions.text import code_tokens
from tessera.operators import search


def test_embedder_against_counts(spark):
    texts = ["get_user(id) get_user other", "", None, "a b c d e f g " * 50, "é x_y"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    hashed = F.transform(code_tokens("t"), lambda t: F.xxhash64(t))
    for size in (8, 64):
        for r in rows.select("k", hashing_embedder(size)(F.col("t")).alias("e"), hashed.alias("h")).collect():
            want = collections.Counter()
            for h in r["h"] or []:
                want[h % size] += 1 if h >= 0 else -1
            length = sum(v * v for v in want.values()) ** 0.5
            assert r["e"] == pytest.approx([want[i] / length if length else 0.0 for i in range(size)])


def flaky():
    """Raises on some texts, alone or in a batch, and the first time of all."""
    calls = []

    def model(queries, texts):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("warming up")
        if any("bad" in t for t in texts):
            raise ValueError("bad")
        return [float(len(t)) for t in texts]

    return model


def test_rows_that_fail_give_null(spark):
    rows = spark.createDataFrame([(k, "q", "bad" if k % 7 == 3 else None if k == 5 else "x" * k) for k in range(50)], "k int, q string, t string").coalesce(1)
    got = {r["k"]: r["s"] for r in rows.select("k", guarded(flaky, "double", batch_rows=8)("q", "t").alias("s")).collect()}
    assert got == {k: None if k % 7 == 3 or k == 5 else float(k) for k in range(50)}

    def broken():
        raise OSError("no weights")

    assert {r[0] for r in rows.select(guarded(broken, "double")("t").alias("s")).collect()} == {None}
    vectors = rows.select(guarded(lambda: lambda texts: [[1.0, float(len(t))] for t in texts], "array<double>")("t").alias("v")).where("v is not null")
    assert vectors.count() == 49


def test_short_results_are_failures(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("t"))
    assert {r[0] for r in rows.select(guarded(lambda: lambda texts: [1.0] * (len(texts) - 1), "double")("t")).collect()} == {None}


def test_a_reranker_that_fails_at_run_time_leaves_those_questions(spark):
    rows = [(q, "why", f"{q}{k} " + ("bad" if q == "b" and k == 2 else "x" * k), k + 1, 1.0 - k / 10) for q in "abc" for k in range(4)]
    results = spark.createDataFrame(rows, "query_id string, query string, content string, rank int, score double")
    got = search.rerank(results, guarded(flaky, "double"), 3).collect()
    order = {q: [r["content"][1] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] for q in "abc"}
    assert order == {"a": ["3", "2", "1"], "b": ["0", "1", "2"], "c": ["3", "2", "1"]}
    assert {r["score"] for r in got if r["query_id"] == "b"} == {1.0, 0.9, 0.8}
