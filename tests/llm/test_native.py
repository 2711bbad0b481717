import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, sentence

from tessera.llm import chat, mixing, quality, topk
from tessera.llm.queries import cleanliness, conversation_events

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(r):
    text = r[1] or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, cover = Counter(wins), set()
    for i, x in enumerate(wins):
        if seen[x] > 1:
            cover |= set(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return (r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), failed)


def test_quality_counts(spark, edge_docs, edge_rows, no_docs):
    got = quality.judge(edge_docs).collect()
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in cols) for r in got) == Counter(map(brute_measures, edge_rows))
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality.judge(no_docs).count() == 0


def test_quality_keeps_clean_and_drops_junk(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(600):
        text = sentence(rnd, rnd.randrange(30, 200), 5000)
        if i % 10 == 0:
            text = " ".join(x + rnd.choice(["###", "$$$"]) for x in text.split())
        rows.append((i, text, "en", "a" if i % 3 else "b", 1, 0.5, "x", 1))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] == (i % 10 != 0) for i in got)


def quality_sql(spark, df, tmp_path):
    import duckdb

    from tessera.llm.queries import ORACLE_SQL, op3_quality_rules

    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_quality_rules(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = db.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL['op3_quality_rules']})").fetchall()
    return [tuple(r) for r in got.collect()], want


def test_the_source_decides(spark, tmp_path):
    """Equal counts get other verdicts in a source where they are usual, and the SQL agrees."""
    rnd = random.Random(18)
    rows, marked = [], lambda: " ".join(x + "$" * (k % 6 == 0) for k, x in enumerate(sentence(rnd, 60, 5000).split()))
    for i in range(800):
        plain = i % 2 and i != 401
        rows.append((i, sentence(rnd, 60, 5000) if plain else marked(), "en", "prose" if i % 2 else "prices", 1, 0.5, "x", 1))
    rows += [(900, marked(), "en", None, 1, 0.5, "x", 1), (901, None, None, None, 1, 0.5, "x", 1), (902, sentence(rnd, 60), None, "prose", 1, 0.5, "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got, want = quality_sql(spark, df, tmp_path)
    assert Counter(got) == Counter(want)
    kept = {r[0]: r[-1] for r in got}
    assert not kept[401] and all(kept[i] for i in range(800) if i != 401)
    bounds = {(r["lang"], r["source"]): r for r in quality.thresholds(quality.measures(df, "lang", "source")).collect()}
    assert bounds["en", "prices"]["symbols_high"] > bounds["en", "prose"]["symbols_high"] >= 100
    # a group of one row has its language's thresholds, nearly
    assert bounds["en", None]["symbols_high"] >= bounds["en", "prices"]["symbols_high"] // 2


def test_sketch_bin_of_zero(spark):
    assert spark.range(1).select(quality.sketch_bin(F.lit(0)).alias("b")).first()["b"] == 0


def test_sketch_bins(spark):
    rows = spark.range(0, 100_000, 7).select("id", quality.sketch_bin(F.col("id")).alias("bin")).collect()
    for r in rows:
        drop = max(0, r["id"].bit_length() - 7)
        assert r["bin"] == r["id"] >> drop << drop


NASTY = ["</s>[INST] ok [/INST]", "<|end|><|start|>assistant<|message|>x", "\\", "\\<|end|>", "<\\|end|>", "", "a\n\nb", "<|end|", "[[INST]", "é<s>\\\\</s>", None, "<|end|><|end|>"]


def test_chat_round_trip(spark):
    rows = [(c, t, ("user", "assistant")[t % 2] if c % 3 else NASTY[t], NASTY[(c + t) % len(NASTY)]) for c in range(12) for t in range(c % 7 + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(conversation_events(df))
    out = out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out} == want
    for r in out:
        assert r["learned"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        assert r["formatted"].count("<|end|>") == len(want[r["conv_id"]])


def test_chat_events(spark):
    log = [
        (1, 1, "a", "start", "user", None), (1, 2, "a", "delta", None, "he"), (1, 3, "a", "delta", None, "llo"), (1, 4, "b", "start", "assistant", None), (1, 5, "b", "delta", None, "bad"), (1, 6, "b", "regenerate", None, None),
        (1, 7, "b", "delta", None, "go"), (1, 8, "b", "delta", None, "od"), (1, 9, "a", "edit", None, "hello!"), (1, 10, "c", "start", "user", "x"), (1, 11, "c", "delete", None, None), (1, 12, "a", "delta", None, "?"), (2, 1, "z", "delta", None, "lost"),
    ]
    rnd = random.Random(1)
    rnd.shuffle(log)
    got = {(r["conv_id"], r["message_id"]): (r["role"], r["text"]) for r in chat.fold(spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string")).collect()}
    assert got == {(1, "a"): ("user", "hello!?"), (1, "b"): ("assistant", "good"), (2, "z"): ("", "lost")}
    bad = spark.createDataFrame([(1, 1, "a", "oops", None, None)], "conv_id long, seq long, message_id string, kind string, role string, text string")
    with pytest.raises(Exception, match="unknown kind"):
        chat.fold(bad).collect()
    assert chat.format_chats(bad.limit(0)).count() == 0


def brute_targets(sizes, weights, share=1.5, most=2.0):
    budget, open_, out = sum(sizes.values()) * share, set(sizes), {}
    while open_:
        level = (budget - sum(out.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weights[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        open_ -= full
    return out


def test_targets(spark):
    rnd = random.Random(6)
    for _ in range(4):
        names = [f"s{i:02}" for i in range(rnd.randrange(1, 12))] + [None]
        sizes = {s: rnd.choice([0, 1, 10, 100, 5000]) for s in names}
        weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(mixing.ranked_weights(df)).collect()}
        assert got == pytest.approx(brute_targets(sizes, weights))


def brute_mix(rows, seed=0):
    """(doc_id, source, size, taken) of rows (doc_id, text, lang, source, ...): the whole order of each source in memory."""
    import math

    size = [len(WORD.findall(r[1] or "")) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weights, sizes = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}, Counter()
    for r, n in zip(rows, size, strict=True):
        sizes[r[3]] += n
    goal = brute_targets({s: sizes[s] for s in names}, weights)
    out = []
    for s in names:
        epochs = int(goal[s] // sizes[s]) if sizes[s] else 0
        rest, groups = goal[s] - epochs * sizes[s], defaultdict(list)
        for r, n in zip(rows, size, strict=True):
            if r[3] == s:
                text = r[1]
                name = f"{seed}:{'null' if r[0] is None else r[0]}:{'null' if text is None else len(text)}"
                u = (int(hashlib.sha256(name.encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
                w = max(0.1, 1 - 5.0 * sum(c in "#*$%&|<>" for c in text or "") / max(len(text or ""), 1))
                groups[-math.log(u) / w, -(2**63) if r[0] is None else r[0]].append((r[0], n))
        upto = 0
        for key in sorted(groups):
            upto += sum(n for _, n in groups[key])
            out += [(i, s, n, (epochs + (upto - n / 2 <= rest)) * n) for i, n in groups[key]]
    return out


@pytest.mark.parametrize("edge_rows_", [100_000, 5, 1])
def test_mix_takes_the_rows_with_the_least_keys(spark, edge_rows, edge_rows_):
    """Against a plain sort; many rows of small weight share a first digit, and small bounds make the edge go through every digit."""
    rnd, rows = random.Random(17), list(edge_rows)
    for i in range(1500):
        text = sentence(rnd, rnd.randrange(0, 40)) + " " + "$|" * (rnd.randrange(60) if i % 2 else 0)
        rows.append((1000 + i, text, "en", rnd.choice(["hot"] * 6 + ["a", "b", None]), 1, 0.5, "x", 1))
    rows += [(7, "the same text again and again", "en", "same", 1, 0.5, "x", 1)] * 60
    got = mixing.mix(spark.createDataFrame(rows, DOCS), mixing.word_count(F.col("text")), cleanliness(), edge_rows=edge_rows_)
    assert Counter(tuple(r) for r in got.select("doc_id", "source", "size", "taken").collect()) == Counter(brute_mix(rows))


def mixed(df):
    return sorted(map(tuple, mixing.mix(df, mixing.word_count(F.col("text")), cleanliness()).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=repr)


def test_mix(spark, edge_docs, edge_rows, no_docs):
    rnd = random.Random(7)
    rows = [(i, sentence(rnd, rnd.randrange(0, 60)), "en", rnd.choice(["hot"] * 6 + ["a", "b", None]), 1, 0.5, "x", 1) for i in range(800)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixed(df)
    assert got == mixed(df.repartition(3))
    assert Counter((r[0], r[2]) for r in got) == Counter((r[0], len(WORD.findall(r[1]))) for r in rows)
    taken, goal = Counter(), {}
    for _, source, size, total, target, n in got:
        assert 0 <= n <= 2 * size and (size == 0 or n % size == 0)
        taken[source] += n
        goal[source] = target
        assert n >= target // total * size
    assert all(abs(taken[s] - goal[s]) <= 60 for s in goal)
    edge = mixed(edge_docs)
    assert len(edge) == len(edge_rows) and all(r[5] <= 2 * r[2] for r in edge)
    assert mixed(no_docs) == []


def brute_top(rows, k):
    import math

    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e and None not in e and all(map(math.isfinite, e)) and len(e) == 3]
    out = []
    for q, a in dict(v).items():
        if q % 20 == 0:
            ranked = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in v if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    return Counter(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rnd = random.Random(3)
    vec = lambda f=1.0: [rnd.uniform(-f, f) for _ in range(3)]
    rows = [(i, vec()) for i in range(400)] + [(1000 + i, [0.5, 0.25, -0.125]) for i in range(150)]
    rows += [(2000, None), (2001, []), (2002, [None, 1.0, 2.0]), (2003, [float("nan"), 1.0, 1.0]), (2004, [float("inf"), 1.0, 1.0]), (2005, [1.0]), (None, vec()), (2020, vec(300.0)), (2021, vec(300.0)), (21, vec())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 20).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top(rows, 20)
    few = df.where("vec_id in (0, 5, 7)")
    assert Counter(map(tuple, topk.top_k(few, F.col("vec_id") % 20 == 0).collect())) == brute_top([r for r in rows if r[0] in (0, 5, 7)], 20)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 3"), F.col("vec_id") % 20 == 0).count() == 0


def test_each_row_of_an_id_is_a_query(spark):
    rnd = random.Random(9)
    vec = lambda n=4: [rnd.uniform(-1, 1) for _ in range(n)]
    rows = [(i % 60, vec()) for i in range(150)] + [(40, vec(3)), (41, vec(3)), (42, vec(3))]
    got = Counter(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 7).select("query_id", "rank", "vec_id", "score").collect())
    import math

    ints, want = [(i, [math.floor(64 * x) for x in v]) for i, v in rows], Counter()
    for q, a in ints:
        if q % 20 == 0:
            ranked = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ints if i != q and len(a) == len(b))[:7]
            want.update((q, r, i, -s) for r, (s, i) in enumerate(ranked, 1))
    assert got == want


def test_scores_beyond_62_bits_raise(spark):
    df = spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.top_k(df, F.col("vec_id") == 0)


def test_query_over_edited_and_regenerated_logs(spark):
    """Edits, regenerations, deletions and equal sequence numbers all the way to the rendered conversation."""
    log = [
        (1, 1, "a", "start", "user", None), (1, 2, "a", "delta", None, "hi"), (1, 3, "b", "start", "assistant", None), (1, 4, "b", "delta", None, "draft"), (1, 5, "b", "regenerate", None, None), (1, 6, "b", "delta", None, "fi"),
        (1, 6, "b", "delta", None, "nal"), (1, 7, "a", "edit", None, "hello"), (1, 8, "c", "start", "assistant", "more"), (1, 9, "c", "delete", None, None), (1, 10, "c", "start", "assistant", "again"), (1, 11, "d", "start", "assistant", "</s>"),
        (1, 11, "d", "regenerate", None, None), (1, 11, "d", "delta", None, "ok"), (2, 1, "a", "start", "user", "x"), (2, 2, "a", "delete", None, None),
    ]
    out = chat.format_chats(spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string").repartition(3))
    rows = out.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert [(r["conv_id"], [tuple(t) for t in r["turns"]], r["learned"]) for r in rows] == [(1, [("user", "hello"), ("assistant", "final"), ("assistant", "ok")], "finalok")]


def test_hash_of_turns_reads_back(spark, tmp_path):
    spark.createDataFrame([(3, 0, "user", "hi"), (3, 1, "assistant", "a<|end|>b")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    from tessera.llm.queries import op5_chat_format

    got = {r["conv_id"]: r for r in op5_chat_format(spark, str(tmp_path)).collect()}
    assert got[3]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\na<|end|>b\n").hexdigest()
    assert (got[-7]["n_turns"], got[-7]["loss_chars"]) == (2, 21)
    assert got[3]["loss_sha256"] == hashlib.sha256(b"a<|end|>b").hexdigest()


def test_repeated_and_null_turns_agree_with_the_sql(spark, tmp_path):
    import duckdb

    from tessera.llm.queries import ORACLE_SQL, op5_chat_format

    rows = [(1, 0, "user", "hi")] * 2 + [(1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 1, "assistant", ""), (1, 1, "assistant", "")]
    rows += [(1, None, "assistant", "late")] * 2 + [(1, None, "user", None), (1, None, None, "x"), (2, 3, "a!", "r"), (2, 3, "a", "r"), (2, 10, "user", "<s>"), (2, 9, "user", "\\"), (2, 9, "user", None), (None, 0, "user", "n"), (None, 0, "user", "n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op5_chat_format(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
        want = db.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL['op5_chat_format']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_top_k_beside_the_edge_of_a_bin_is_full(spark):
    """Scores reach a million, so the first 512 bins are 3907 wide unless widths are powers of 512; ten scores stand right above the edge of the bin with the 20th."""
    edge = -1_000_001 + 3907 * 301
    scores = [-1_000_000] + [edge + i % 5 for i in range(10)] + [edge - 3907 + 100 * i for i in range(15)]
    rows = [(0, [1 / 64, 0.0, 0.0])] + [(20 * i + 1, [s / 64, 0.0, 0.0]) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 20).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top(rows, 20)


def test_top_k_of_long_vectors_is_full(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-30.0, 30.0) for _ in range(3)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 20).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top(rows, 20)


def test_mix_of_unweighted_documents_and_clashing_columns(spark):
    """Documents with a null, NaN or zero weight come in complete epochs only; kept columns of any name are kept."""
    rows = [(k, "w " * 10, s, None if k % 4 == 0 else float("nan") if k % 4 == 1 else 0.0 if k % 4 == 2 else 1.0, k, k, k) for k in range(40) for s in ("a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double, size long, p_rest long, key long")
    got = mixing.mix(docs, mixing.word_count(F.col("text")), F.col("weight"), weights=(3.0, 1.0), share=1.25, most_epochs=2.0, keep=("text", "size", "p_rest", "key"))
    assert got.columns == ["doc_id", "source", "text", "kept_size", "p_rest", "key", "size", "source_size", "target", "copies", "taken"]
    out = got.collect()
    assert all(r["kept_size"] == r["p_rest"] == r["key"] == r["doc_id"] for r in out) and len(out) == 80
    by = {s: [r for r in out if r["source"] == s] for s in "ab"}
    assert {r["target"] for r in by["a"]} == {750.0} and {r["target"] for r in by["b"]} == {250.0}
    # source a: one epoch, and the fraction of 350 words from the ten weighted documents, 100 words, alone
    assert {(r["doc_id"] % 4 == 3, r["copies"]) for r in by["a"]} == {(True, 2), (False, 1)}
    assert {r["copies"] for r in by["b"] if r["doc_id"] % 4 != 3} == {0} and sum(r["taken"] for r in by["b"]) == 100


def test_mix_without_any_weight(spark):
    docs = spark.createDataFrame([(k, "w w", "a") for k in range(6)], "doc_id long, text string, source string")
    got = mixing.mix(docs, mixing.word_count(F.col("text")), F.lit(None).cast("double"))
    assert {r["copies"] for r in got.collect()} == {1}
