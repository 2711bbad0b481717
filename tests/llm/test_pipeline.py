import random
import re
from collections import Counter

import pytest
from tests.llm.conftest import sentence
from tests.llm.test_native import brute_mix
from tests.llm.test_dedup import WORD, brute_components, brute_print
from tests.llm.test_tokens_packing import check_packing

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory, edge_rows):
    """Each stage's rows over small tables with toxic documents, copies, repeated rows and nulls."""
    at, rnd = tmp_path_factory.mktemp("tables"), random.Random(12)
    rows, labels = [r[:5] for r in edge_rows], []
    passage = sentence(rnd, 70, 5000)
    for i in range(100, 500):
        w, bad = sentence(rnd, rnd.randrange(20, 150), 5000).split(), i % 5 == 0
        for _ in range(4 if bad else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["grumf", "blarg"]))
        if i % 20 == 1:
            w = w[:10] + passage.split() + w[10:]
        rows.append((i, " ".join(w), "en", f"s{i % 3}", len(" ".join(w))))
        if i % 40 == 3:
            rows.append((i + 1000, " ".join(w), "en", "s9", 1))
        labels.append((i, 1, int(bad)))
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, shape).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), [[tuple(r) for r in rows]]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(at)).write.parquet(f"{at}/out-{k}")
        docs = spark.read.parquet(f"{at}/out-{k}")
        assert k == 4 or docs.columns == COLUMNS
        out.append([tuple(r) for r in docs.collect()] if k < 4 else docs.collect())
    return str(at), out


def test_toxic_documents_go_and_clean_ones_stay(staged):
    before, after = map(Counter, staged[1][:2])
    gone = before - after
    assert not after - before
    toxic = {r[0] for r in before if r[1] and re.search("grumf|blarg", r[1])}
    assert {r[0] for r in gone} <= toxic and len(gone) >= 0.95 * len(toxic)


def test_one_of_each_group_stays(staged):
    before, after = staged[1][1], staged[1][2]
    roots = brute_components([brute_print(r[1]) for r in before])
    least, kept = {}, Counter(after)
    for r in before:
        k = roots[brute_print(r[1])]
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    assert all(n == 1 for n in kept.values()) and not kept - Counter(before)
    have = Counter(roots[brute_print(r[1])] for r in after if r[0] is not None)
    assert have == Counter(dict.fromkeys(least, 1))
    assert all(r[0] == least[roots[brute_print(r[1])]] for r in after if r[0] is not None)


def test_repeats_are_cut_in_place(staged):
    before, after = staged[1][2], staged[1][3]
    ids, words = [r[0] if r[0] is not None else 1 << 62 for r in before], [WORD.findall(r[1] or "") for r in before]
    least = {}
    for i, w in zip(ids, words, strict=True):
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            least[k] = min(least.get(k, i), i)
    want = []
    for r, i, w in zip(before, ids, words, strict=True):
        gone = {q for p in range(len(w) - 49) if least[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((r[0], kept, *r[2:4], len(kept)) if gone else r)
    assert Counter(after) == Counter(want) and after != before


def test_mix_takes_whole_documents(staged):
    before, after = map(Counter, staged[1][3:5])
    assert all(n <= 2 * before[r] for r, n in after.items()) and not set(after) - set(before)
    want = Counter()
    for i, source, size, taken in brute_mix(staged[1][3]):
        want[i, source] += taken // size if size else 0
    assert Counter((r[0], r[3]) for r in staged[1][4] if WORD.search(r[1] or "")) == +want


def test_packing_covers_the_mix(staged):
    rows = staged[1][5]
    check_packing(rows, 2048)
    pieces = Counter((r["doc_id"]) for r in rows if r["piece"] == 0)
    assert pieces == Counter(r[0] for r in staged[1][4])


def test_run_equals_the_stages(spark, staged):
    got = corpus_pipeline.run(spark, staged[0]).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, got)) == Counter(map(key, staged[1][5]))
