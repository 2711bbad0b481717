import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, sentence

from tessera.llm import components, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(rows, window):
    words = [WORD.findall(r[1] or "") for r in rows]
    ids = [r[0] if r[0] is not None else 1 << 63 for r in rows]
    least = {}
    for i, w in zip(ids, words, strict=True):
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, i), i)
    out = []
    for (r, i), w in zip(zip(rows, ids, strict=True), words, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def removed(df, window=50):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substrings.remove_repeats(df, window).collect())


def test_repeats_on_edge_cases(edge_docs, edge_rows, no_docs):
    assert removed(edge_docs) == brute_repeats(edge_rows, 50)
    assert removed(no_docs) == Counter()


@pytest.mark.parametrize("window", [16, 50])
def test_repeats_on_planted_passages(spark, window):
    rnd = random.Random(window)
    passages = [sentence(rnd, rnd.randrange(10, 140), 12) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [sentence(rnd, rnd.randrange(0, 40), 12)]
        for _ in range(rnd.randrange(3)):
            w = rnd.choice(passages).split()
            a = rnd.randrange(len(w))
            parts += [" ".join(w[a : a + rnd.randrange(1, 140)]), sentence(rnd, rnd.randrange(0, 30), 12)]
        rows.append((rnd.randrange(50), "\n".join(parts), "en", "a", 1, 0.5, "x", 1))
    assert removed(spark.createDataFrame(rows, DOCS), window) == brute_repeats(rows, window)


def brute_print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    own = sorted(up)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    return {p: root(p) for p in own}


def brute_duplicates(rows):
    prints = [brute_print(r[1]) for r in rows]
    roots = brute_components(prints)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[roots[p]] = min(least.get(roots[p], r[0]), r[0])
    return Counter((r[0], f"{p:016x}", least.get(roots[p])) for r, p in zip(rows, prints, strict=True))


def found_duplicates(df):
    return Counter(map(tuple, simhash.near_duplicates(df).select("doc_id", simhash.hexadecimal(), "component_id").collect()))


def test_near_duplicates_on_edge_cases(edge_docs, edge_rows, no_docs):
    assert found_duplicates(edge_docs) == brute_duplicates(edge_rows)
    assert found_duplicates(no_docs) == Counter()


def test_near_duplicates_on_variants(spark):
    rnd = random.Random(9)
    rows = []
    for g in range(12):
        w = sentence(rnd, 150).split()
        for _ in range(rnd.randrange(1, 9)):
            v = list(w)
            for _ in range(rnd.randrange(3)):
                v[rnd.randrange(len(v))] = "zz"
            rows.append((rnd.randrange(1000), " ".join(v), "en", f"s{g}", 1, 0.5, "x", 1))
    assert found_duplicates(spark.createDataFrame(rows, DOCS)) == brute_duplicates(rows)


@pytest.mark.parametrize("spread", [3, 20])
def test_long_lists_lose_no_link(spread):
    rnd = np.random.default_rng(spread)
    center = np.uint64(0x0123456789ABCDEF)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rnd.choice(64, rnd.integers(0, spread), replace=False).astype(np.uint64), initial=np.uint64(0)) for _ in range(3000)])
    values = np.unique(center ^ flips)
    got = defaultdict(set)
    forest = simhash._Forest(len(values))
    pairs = simhash.link(values, 3)
    for i, j in pairs:
        assert int(values[i] ^ values[j]).bit_count() <= 3
        forest.join(i, j)
    for i in range(len(values)):
        got[forest.root(i)].add(i)
    want, brute = defaultdict(set), simhash._Forest(len(values))
    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(values[a] ^ values[:a]) <= 3).tolist():
            brute.join(a, b)
    for i in range(len(values)):
        want[brute.root(i)].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("many", [False, True])
def test_position_sets_meet_every_link(many):
    from itertools import combinations

    sets = simhash.position_sets(3, many)
    assert all(any(set(s) <= set(five) for s in sets) for five in combinations(range(8), 5))


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, rnd.randrange(2000, 2100)) for _ in range(200)] + [(5, 5), (300, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        up.setdefault(a, {a}), up.setdefault(b, {b})
        if up[a] is not up[b]:
            both = up[a] | up[b]
            for x in both:
                up[x] = both
    assert got == {x: min(s) for x, s in up.items() if len(s) > 1}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def anchor_rows(rnd, keys, docs, n):
    x = {"key": rnd.integers(0, keys, n), "doc": rnd.integers(0, docs, n), "row": rnd.integers(0, 3, n), "lo": rnd.integers(0, 200, n), "hi": rnd.integers(0, 30, n), "block": rnd.random(n) < 0.4, "ask": rnd.random(n) < 0.9, "kind": np.zeros(n, dtype=np.int8)}
    x["hi"] = x["lo"] + x["hi"]
    x["block"] &= x["ask"]
    order = np.lexsort((x["doc"], x["key"]))
    return {c: v[order].astype(np.int32 if c in ("lo", "hi") else v.dtype) for c, v in x.items()}


def cut(batch, rnd, parts):
    at = np.sort(rnd.integers(0, batch.num_rows + 1, parts))
    return [batch.slice(a, b - a) for a, b in zip([0, *at], [*at, batch.num_rows], strict=True)]


@pytest.mark.parametrize("seed", range(6))
def test_keys_over_batches(seed):
    """Rows of a key that come in any number of batches give what they give at once."""
    rnd = np.random.default_rng(seed)
    x = anchor_rows(rnd, rnd.choice([1, 3, 50]), rnd.choice([2, 40]), 600)
    whole = substrings._judge_anchors(x, 25, 50)[2]
    parts = cut(pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in x.items()}), rnd, int(rnd.integers(0, 40)))
    got = [b.to_pydict() for b in substrings._hits(iter(parts), 25, 50)]
    rows = lambda d: list(zip(*(d[c] for c in ("doc", "row", "lo", "hi")), strict=True))
    assert Counter(r for d in got for r in rows(d)) == Counter(rows({c: v.tolist() for c, v in whole.items()}))

    w = {"h1": rnd.integers(0, 4, 300), "h2": rnd.integers(0, 2, 300).astype(np.int32), "doc": rnd.integers(0, 9, 300), "row": rnd.integers(0, 2, 300), "kind": np.zeros(300, dtype=np.int8)}
    order = np.lexsort((w["doc"], w["h2"], w["h1"]))
    w = {c: v[order] for c, v in w.items()} | {"at": [[int(k), int(k) + 7] for k in range(300)]}
    late = substrings._late({c: w[c] for c in ("h1", "h2", "doc")})
    got = [r for b in substrings._late_spans(iter(cut(pa.RecordBatch.from_pydict(w), rnd, int(rnd.integers(0, 30))))) for r in b.column("lo").to_pylist()]
    assert Counter(got) == Counter(p for k in np.flatnonzero(late).tolist() for p in (k, k + 7))


def test_one_key_takes_time_in_proportion():
    """Four times the rows of one key: not sixteen times the time."""
    import time

    rnd = np.random.default_rng(0)
    batches = {n: [pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in anchor_rows(rnd, 1, 1 << 40, 10_000).items()}) for _ in range(n)] for n in (50, 200)}
    took = {}
    for n, some in batches.items():
        took[n] = min(timed(lambda some=some: [None for _ in substrings._hits(iter(some), 25, 50)], time) for _ in range(3))
    assert took[200] < 8 * took[50]


def timed(f, time):
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def test_cut_texts_beside_any_columns(spark):
    rnd = random.Random(4)
    base = sentence(rnd, 120)
    names = ["_doc", "_row", "_words", "_d", "_r", "doc", "row", "spans", "words", "kept", "c0", "c1"]
    rows = [(1, base, 0, *range(12)), (2, "x " + base, 0, *range(12)), (3, "short", 5, *range(12))]
    got = substrings.cut_texts(spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "n_chars long", *(f"{n} int" for n in names)])))
    assert got.columns == ["doc_id", "text", "n_chars", *names]
    assert sorted(map(tuple, got.collect())) == [rows[0], (2, "x", 1, *range(12)), rows[2]]


def test_a_hub_is_split(spark):
    """The side of the large star's join that holds a hub's edges is split where it is large."""
    own = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        edges = spark.range(40_000).selectExpr("if(id < 30000, 0L, id) as u", "id + 50000 as v").repartition(8)
        edges = components.scratch.keep(edges, "hub")
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        first = components.scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "first")
        star = components.large_star(both, first)
        rows = star.select(F.sum(F.hash("u", "v")).alias("s"))
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
