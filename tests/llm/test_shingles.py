import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import sentence
from tests.llm.test_dedup import WORD, brute_print

import corpus_pipeline
from tessera.llm import shingles

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def groups(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if label[i] != label[j] and linked(i, j):
                label = [label[i] if x == label[j] else x for x in label]
    return label


def edited(rnd, words, k, tag):
    w = list(words)
    for p in rnd.sample(range(len(w)), k):
        w[p] = f"{tag}-{p}"
    return " ".join(w)


def test_shingle_sets_are_those_of_the_texts():
    texts = ["a b c d e f", "A b\tc\nd e  f", "a b c", None, "", " \n", "a b c d e a b c d e a", "é à b c d e", "A"]
    h, cuts = shingles.shingle_sets(pa.array(texts))
    got = [frozenset(h[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    want = [brute_set(t) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j])
    assert np.diff(cuts).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("seed", range(4))
def test_similar_finds_every_link(seed):
    rnd = np.random.default_rng(seed)
    common = rnd.integers(0, 1 << 40, 60)
    sets = []
    for _ in range(12):
        base = np.concatenate([rnd.integers(0, 1 << 40, rnd.integers(1, 90)), common[: rnd.integers(0, 60)]])
        for _ in range(rnd.integers(1, 12)):
            part = base[rnd.random(len(base)) > rnd.choice([0.0, 0.05, 0.1, 0.2])]
            own = np.unique(np.append(part, rnd.integers(0, 1 << 40, rnd.integers(1, 8)))).astype(np.uint64)
            sets.append(own)
    brute = [frozenset(s.tolist()) for s in sets]
    pairs = shingles.similar(sets)
    assert all(near(brute[i], brute[j]) for i, j in pairs)
    got = groups(len(sets), lambda i, j: (i, j) in pairs or (j, i) in pairs)
    want = groups(len(sets), lambda i, j: near(brute[i], brute[j]))
    assert {(i, j) for i in range(len(sets)) for j in range(i) if got[i] == got[j]} == {(i, j) for i in range(len(sets)) for j in range(i) if want[i] == want[j]}


@pytest.mark.parametrize("fine,copies,most", [(128, 48, 4096), (2, 48, 4096), (2, 2, 4), (2, 1, 3)])
def test_stage_keeps_one_of_each_group_of_near_copies(spark, monkeypatch, fine, copies, most):
    """Groups held whole, cut in blocks of few sets, and compared band by band."""
    for name, n in (("FINE", fine), ("COPIES", copies), ("MOST", most)):
        monkeypatch.setattr(shingles, name, n)
    rnd = random.Random(4)
    rows, passage = [], sentence(rnd, 90, 5000).split()
    for g in range(25):
        words = sentence(rnd, 200, 5000).split() + (passage if g % 5 == 0 else [])
        for k in range(7):
            text = edited(rnd, words, k, f"e{g}-{k}")
            rows.append((1000 - 7 * g - k, text, "en", "a", len(text)))
    rows += [(5000 + i, t, "en", "b", 1) for i, t in enumerate(["", " ", "one", "one two", "one two", "One two", None])]
    sets, prints = [brute_set(r[1]) for r in rows], [brute_print(r[1]) for r in rows]
    label = groups(len(rows), lambda i, j: near(sets[i], sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 3)
    want = {}
    for r, g in zip(rows, label, strict=True):
        want[g] = min(want.get(g, r[0]), r[0])
    got = corpus_pipeline.near_duplicates_out(spark, spark.createDataFrame(rows, SHAPE), "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want.values())
    assert len(got) < len(set(groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)))


def test_stage_keeps_one_of_a_group_with_null_ids(spark):
    rnd = random.Random(6)
    a, b, c, d = (sentence(rnd, 300, 5000).split() for _ in range(4))
    rows = [(None, edited(rnd, a, k, "x"), "en", "a", 1) for k in (0, 0, 1, 2)]
    rows += [(8, " ".join(b), "en", "a", 1), (9, " ".join(b), "en", "a", 1), (None, " ".join(b), "en", "a", 1), (None, edited(rnd, b, 1, "y"), "en", "a", 1)]
    rows += [(3, " ".join(c), "en", "a", 1), (3, " ".join(c), "en", "a", 1), (3, " ".join(d), "en", "a", 1)]
    got = corpus_pipeline.near_duplicates_out(spark, spark.createDataFrame(rows, SHAPE), "").collect()
    texts = {r[1] for r in rows[:4]}
    assert sum(r["text"] in texts for r in got) == 1
    assert sorted((r["doc_id"], r["text"]) for r in got if r["text"] not in texts) == sorted([(8, " ".join(b)), (3, " ".join(c)), (3, " ".join(d))])
