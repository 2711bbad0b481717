import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, sentence

from tessera.llm import lattice, toxicity
from tessera.llm.queries import id_remainder, tokenizer_path


def labelled(spark, n=900):
    rnd = random.Random(4)
    slurs, rows, labels = ["grumf", "blarg", "snorkoid"], [], []
    for i in range(n):
        w, bad = sentence(rnd, rnd.randrange(20, 120)).split(), rnd.random() < 0.2
        for _ in range(3 if bad else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(slurs) + rnd.choice(["", ",", "s."]))
        rows.append((i, " ".join(w), "en", "a", 1, 0.5, "x", 1))
        labels.append((i, int(bad), 0.5))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, score double")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, allowed=id_remainder(3) != 1)
    scored = toxicity.score(docs.select("doc_id", "text"), model).join(labels.select("doc_id", "toxic"), "doc_id").where(id_remainder(3) == 1).collect()
    hits = Counter((r["toxic"], r["score"] >= 0.7) for r in scored)
    assert hits[(1, True)] >= 0.95 * (hits[(1, True)] + hits[(1, False)])
    assert hits[(0, True)] <= 0.01 * len(scored)
    assert len(model.index) < 5000


def plain_ftrl(examples, alpha, beta, l1, l2, epochs, positive):
    """The update rule one coordinate at a time; the bias is the coordinate None."""
    z, n = Counter(), Counter()

    def weight(i):
        pull = 0.0 if i is None else l1
        if abs(z[i]) <= pull:
            return 0.0
        return -(z[i] - math.copysign(pull, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for own, label in examples:
            w = {i: weight(i) for i in [*own, None]}
            g = (1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - label) * (positive if label else 1)
            for i, wi in w.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * wi
                n[i] += g * g
    return {i: weight(i) for i in n}


def plain_features(text):
    """Named features: words, stems, neighbours and skip-grams."""
    w = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = {("word", x) for x in w} | {("stem", x.encode()[:k]) for x in w for k in (4, 5, 6) if len(x.encode()) > k}
    return out | {(gap, a, b) for gap in (1, 2) for a, b in zip(w, w[gap:], strict=False)}


def test_features_are_those_of_the_text():
    texts = ["The cat, the CAT sat; on mats", "mats on sat the", "", "éàü longword-longwordy", "a b a b a"]
    row, key = toxicity.features(pa.array(texts), 40)
    named, sets = [plain_features(t) for t in texts], [set(key[row == k].tolist()) for k in range(len(texts))]
    for i in range(len(texts)):
        for j in range(len(texts)):
            # a stem may be a word too: the same span of bytes is one feature then
            plain = lambda s: {x[1].encode() if x[0] == "word" else x[1] if x[0] == "stem" else x for x in s}
            assert len(sets[i] & sets[j]) == len(plain(named[i]) & plain(named[j]))


def test_fit_and_scores_equal_plain_ftrl(spark):
    docs, labels = labelled(spark, 200)
    options = dict(alpha=3.0, beta=1.0, l1=4.0, l2=0.1, epochs=3, positive=3.0)
    model = toxicity.fit(docs, labels, bits=18, **options)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = labels.select("doc_id", "toxic", F.xxhash64("doc_id", F.col("toxic").cast("int")).alias("o")).orderBy("o").collect()
    keys = lambda t: sorted(set(toxicity.features(pa.array([t]), 18)[1].tolist()))
    want = plain_ftrl([(keys(texts[r["doc_id"]]), r["toxic"]) for r in order], **options)
    assert model.bias == pytest.approx(want.pop(None), rel=1e-6)
    assert dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx({i: w for i, w in want.items() if w}, rel=1e-5)
    for r in toxicity.score(docs.select("doc_id", "text"), model).collect():
        total = model.bias + sum(want.get(i, 0.0) for i in keys(r["text"]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, total)))), abs=1e-5)


def test_toxicity_edge_cases(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    blank = toxicity.fit(edge_docs, none)
    assert [r["score"] for r in toxicity.score(edge_docs.select("doc_id", "text"), blank).collect()] == [0.5] * edge_docs.count()
    some = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (None, 1), (9, None), (77, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edge_docs, some)
    scores = [r["s"] for r in toxicity.score(edge_docs, model, "s").collect()]
    assert len(scores) == edge_docs.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(no_docs, model, "s").count() == 0


def brute_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(rows):
    remainder = lambda i: zlib.crc32(str(i).encode()) % 10
    counts, docs = Counter(), 0
    for r in rows:
        if r[0] is not None and remainder(r[0]) != 0:
            counts.update(brute_words(r[1]))
            docs += 1
    counts[None] = docs
    n, v = sum(counts.values()), sum(1 for c in counts.values() if c)
    out = []
    for r in rows:
        t = [*brute_words(r[1]), None]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        out.append((r[0], r[0] is not None and remainder(r[0]) == 0, len(t), sum(counts[x] > 0 for x in t), n, round(base, 6)))
    return Counter(out)


@pytest.mark.parametrize("share", [1e-6, 0.02])
def test_base_scores(spark, edge_docs, edge_rows, share):
    got = lattice.score_documents(edge_docs, tokenizer_path("piece_bpe_32k.model"), id_remainder(10) == 0, head_share=share).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base(edge_rows)
    assert all(r["score"] < 0 for r in got)


def test_rare_and_frequent_words_score_alike(spark, edge_docs):
    path, held = tokenizer_path("piece_bpe_32k.model"), id_remainder(10) == 0
    one, two = (sorted(round(r["score"], 6) for r in lattice.score_documents(edge_docs, path, held, head_share=s).collect()) for s in (1e-6, 0.02))
    assert one == pytest.approx(two)


def test_no_documents(no_docs):
    assert lattice.score_documents(no_docs, tokenizer_path("piece_bpe_32k.model"), F.lit(False)).count() == 0


def test_lattice_sums_over_all_segmentations():
    names = [b" ", b" a", b"a", b"b", b"ab", b"bab", b" aba", "é".encode()] + [bytes([x]) for x in "é".encode()]
    logp = np.log(np.linspace(0.02, 0.2, len(names)))
    table = dict(zip(names, np.exp(logp).tolist(), strict=True))
    model = lattice.Lattice(lattice.Pieces(names, logp, -1.0))

    def total(word):
        way = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            way[j] = sum(way[i] * table.get(word[i:j], 0.0) for i in range(j))
        return way[-1]

    words = [b"a", b"ab", b"abab", b"babbab", "aéb".encode(), b"aba" * 30, b"b"]
    got = model.words(pa.array(words, pa.binary()))
    assert got.tolist() == pytest.approx([math.log(total(b" " + w)) for w in words])
    assert model.words(pa.array([b"q"], pa.binary()))[0] == -np.inf


def ways(word, table):
    """Sums over all segmentations: of the word, and up to and from each place."""
    n = len(word)
    to, rest = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for j in range(1, n + 1):
        to[j] = sum(to[i] * table.get(word[i:j], 0.0) for i in range(j))
    for i in range(n - 1, -1, -1):
        rest[i] = sum(table.get(word[i:j], 0.0) * rest[j] for j in range(i + 1, n + 1))
    return to[n], to, rest


def test_expected_counts_are_those_of_all_segmentations(spark):
    names = [b" ", b" a", b"a", b"b", b"ab", b"bab", b" aba"]
    table = dict(zip(names, np.linspace(0.02, 0.2, len(names)).tolist(), strict=True))
    words = {b"a": 3, b"ab": 5, b"abab": 1, b"babbab": 2, b"aba": 7}
    df = spark.createDataFrame([(bytearray(w), n) for w, n in words.items()], "word binary, n_train long").repartition(3)
    got = lattice.expected_counts(df, lattice.Pieces(names, np.log(list(table.values())), -1.0))
    want = Counter()
    for w, n in words.items():
        w = b" " + w
        total, to, rest = ways(w, table)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if w[i:j] in table:
                    want[w[i:j]] += n * to[i] * table[w[i:j]] * rest[j] / total
    assert got.tolist() == pytest.approx([want[x] for x in names], abs=1e-5)


def test_scores_are_sums_over_all_segmentations(spark, edge_rows):
    """The query's score of each document against a plain forward recursion with pieces learned the plain way."""
    import sentencepiece

    path, rnd = tokenizer_path("piece_bpe_32k.model"), random.Random(5)
    rows = [r for r in edge_rows if len(r[1] or "") < 1000] + [(100 + i, " ".join(rnd.choice(["the", "house", "houses", "über", "xq", "\U0001f600"]) for _ in range(rnd.randrange(12))), "en", "a", 1, 0.5, "x", 1) for i in range(40)]
    train = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 != 0]
    counts = Counter(w for r in train for w in brute_words(r[1]))
    sp, names = sentencepiece.SentencePieceProcessor(model_file=path), lattice._vocabulary(path)[1]
    n = Counter({t: 0.0 for t in names if t})
    for w, k in counts.items():
        for i in sp.encode(w):
            n[names[i]] += k

    def probabilities(n):
        whole = sum(n.values()) + 0.1 * len(n) + len(train) + 0.1
        return {t: (x + 0.1) / whole for t, x in n.items()}, math.log10((len(train) + 0.1) / whole)

    table, _ = probabilities(n)
    again = Counter(dict.fromkeys(n, 0.0))
    for w, k in counts.items():
        w = b" " + w.encode()
        total, to, rest = ways(w, table)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if w[i:j] in table:
                    again[w[i:j]] += k * to[i] * table[w[i:j]] * rest[j] / total
    table, end = probabilities(again)
    got = lattice.score_documents(spark.createDataFrame(rows, DOCS), path, id_remainder(10) == 0).select("doc_id", "score").collect()
    want = [(str(r[0]), end + sum(math.log10(ways(b" " + w.encode(), table)[0]) for w in brute_words(r[1]))) for r in rows]
    got, want = sorted((str(r["doc_id"]), r["score"]) for r in got), sorted(want)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-4)


def test_a_round_of_learning_raises_the_likelihood(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["unhappy", "happiness", "unhelpful", "helpfulness", "zzyzx"]) for _ in range(20)), "en", "a", 1, 0.5, "x", 1) for i in range(60)]
    path = tokenizer_path("piece_bpe_32k.model")
    counts = lattice.count_words(spark.createDataFrame(rows, DOCS).select("text", F.lit(True).alias("train"))).cache()
    words = [(bytes(r["word"]), r["n_train"]) for r in counts.collect()]
    fit = lambda p: sum(n * lattice.Lattice(p).words(pa.array([w], pa.binary()))[0] for w, n in words)
    known = counts.select("word", "n_train")
    pieces = lattice.learn_pieces(counts, path, len(rows), 1e-9, rounds=0)
    even = lattice.Pieces(pieces.text, np.full(len(pieces.text), -np.log(len(pieces.text))), -1.0)
    fits = []
    for _ in range(4):  # from equal probabilities, without smoothing, each round is better than the last
        n = lattice.expected_counts(known, even)
        with np.errstate(divide="ignore"):
            even = lattice.Pieces(even.text, np.log(n / n.sum()), -1.0)
        fits.append(fit(even))
    assert fits == sorted(fits) and fits[-1] > fits[0] + 1
