import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.operators import cache, chunks, delta, drift, evals, graph, linker, search, symbols, traverse, viewer
from tessera.queries import CODE, code_files

FILES = "repo_name string, file_path string, content string"


def upsert_all(spark, registry, files):
    rows = delta.with_ids(files).select(F.col("_doc_id").alias("doc_id"), "file_path", "repo_name", F.col("_content_hash").alias("content_hash"), F.array(F.lit("c")).alias("chunk_ids"), F.lit(None).cast("array<string>").alias("graph_node_ids"), F.current_timestamp().alias("last_indexed_at"))
    return delta.upsert(registry, rows)


def test_delta(spark):
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], FILES)
    new = spark.createDataFrame([("r", "a", "1"), ("r", "b", "3"), ("s", "a", "1")], FILES)
    empty = spark.createDataFrame([], delta.REGISTRY)
    assert delta.filter_changed(old, empty).count() == 2
    registry = upsert_all(spark, empty, old)
    changed = delta.filter_changed(new, registry).collect()
    assert {(r["repo_name"], r["file_path"]) for r in changed} == {("r", "b"), ("s", "a")} and changed[0]["_content_hash"]
    assert [r["file_path"] for r in delta.unchanged(new, registry).collect()] == ["a"]
    again = upsert_all(spark, registry, new)
    assert again.count() == 3 and delta.filter_changed(new, again).count() == 0
    a = changed[0]["_doc_id"]
    nodes = delta.set_graph_nodes(again, spark.createDataFrame([(a, ["n"]), ("unknown", ["m"])], "doc_id string, graph_node_ids array<string>"))
    assert nodes.count() == 3 and delta.ids_of(nodes, a, "graph_node_ids") == ["n"] and delta.ids_of(nodes, a) == ["c"] and delta.ids_of(nodes, "unknown") == []
    assert {r["repo_name"]: r["files"] for r in delta.stats(again).collect()} == {None: 3, "r": 2, "s": 1}
    gone = delta.vanished(again, old)
    assert gone.count() == 1 and delta.deregister(again, gone).count() == 2 and delta.clear(again).count() == 0


def test_split_text_invariants():
    rnd = random.Random(1)
    for _ in range(30):
        t = "".join(rnd.choice(["word ", "x", "\n", "\n\n", "longerword "]) for _ in range(rnd.randrange(400)))
        parts = chunks.split_text(t, 100, 20, chunks.DEFAULT_SEPARATORS)
        assert all(len(p) <= 100 and t[a : a + len(p)] == p for a, p in parts)
        covered = set(itertools.chain.from_iterable(range(a, a + len(p)) for a, p in parts))
        assert all(i in covered for i, c in enumerate(t) if not c.isspace())
        assert all(a < b for (a, _), (b, _) in itertools.pairwise(parts))


def test_chunks_by_symbol(spark):
    big = "def big():\n" + "    x = 1\n" * 400
    files = spark.createDataFrame([("r", "m.py", "import os\n\n@deco\ndef f():\n    '''Doc.'''\n\nclass C:\n    pass\n", ".py"), ("r", "big.py", big, ".py"), ("r", "only.py", "import os\n", ".py"), ("r", "n.md", "# hi\n", ".md"), ("r", "e.py", "", ".py")], FILES + ", file_type string")
    got = chunks.split_documents(files).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["chunk_index"]):
        by.setdefault(r["file_path"], []).append(r)
    assert [(r["symbol_name"], r["symbol_type"], r["start_line"]) for r in by["m.py"]] == [("f", "function", 3), ("C", "class", 7)]
    assert by["m.py"][0]["content"].startswith("@deco") and by["m.py"][0]["docstring"] == "Doc."
    assert len(by["big.py"]) > 1 and [r["sub_chunk"] for r in by["big.py"]] == list(range(len(by["big.py"])))
    assert all(len(r["content"]) <= 1000 for r in by["big.py"])
    assert [r["content"] for r in by["only.py"]] == ["import os"] and [r["content"] for r in by["n.md"]] == ["# hi"] and "e.py" not in by
    assert len({r["chunk_id"] for r in got}) == len(got)


PY = '''import os
from typing import List as L, Dict
from . import sibling

class Child(Base, pkg.Mixin):
    """Docs here."""
    def __init__(self): pass
    async def go(self): pass

async def top(): pass

@app.get("/items/{item_id}")
def read(item_id): pass

@app.route("/users", methods=["GET", "POST"])
def users(): pass

@app.route("/plain")
def plain():
    def nested(): pass
'''


def test_python_records():
    r = symbols.extract_python(PY)
    by = lambda k: [x for x in r if x["kind"] == k]
    assert [(c["name"], c["docstring"], c["start_line"]) for c in by("class")] == [("Child", "Docs here.", 5)]
    assert [(f["qualified_name"], f["is_async"], f["is_method"]) for f in by("function")] == [("Child.__init__", False, True), ("Child.go", True, True), ("top", True, False), ("read", False, False), ("users", False, False), ("plain", False, False)]
    assert [(e["http_method"], e["path"], e["framework"], e["handler"]) for e in by("endpoint")] == [("GET", "/items/{item_id}", "fastapi", "read"), ("GET,POST", "/users", "flask", "users"), ("GET", "/plain", "flask", "plain")]
    assert [(i["module"], i["symbols"]) for i in by("import")] == [("os", []), ("typing", ["List", "Dict"]), (".", ["sibling"])]
    assert [(i["name"], i["parent"]) for i in by("inherits")] == [("Child", "Base"), ("Child", "Mixin")]
    assert [f["start_line"] for f in by("function")][3] == 12
    for text, kind in (("def f(:", ".py"), ("", ".py"), ("x", ".rb"), (None, ".js"), ("function (", ".js")):
        assert symbols.extract(text, kind) == []


JS = """import React, { useState as s } from 'react';
import * as path from "path";
import './style.css';
// class Fake {}
const text = "function no() {}";
@Injectable()
export class Service extends lib.Base {
  private readonly url: string = '/x';
  async load(id) { if (id) { return `a}`; } }
  static make() { return new Service(); }
}
function plain(a, b) { return a; }
export async function exported() {}
const arrow = async (x) => x * 2;
router.get('/api/items', auth, plain);
app.post("/api/items", (req, res) => {});
app.use('/mid', exported);
app.get('home', plain);
const parts = text.split(/[`'"{]/), half = a / b / c;
class After { m() { return /\\/}/.test(x); } }
function last() {}
"""


def test_script_records():
    r = symbols.extract_script(JS, ".ts")
    by = lambda k: [x for x in r if x["kind"] == k]
    assert [c["name"] for c in by("class")] == ["Service", "After"] and [i["parent"] for i in by("inherits")] == ["Base"]
    assert [(f["qualified_name"], f["is_async"], f["is_method"]) for f in by("function")] == [
        ("Service.url", False, True), ("Service.load", True, True), ("Service.make", False, True), ("plain", False, False), ("exported", True, False), ("arrow", True, False), ("After.m", False, True), ("last", False, False),
    ]
    assert [(e["http_method"], e["path"], e["handler"]) for e in by("endpoint")] == [("GET", "/api/items", "plain"), ("POST", "/api/items", None), ("ALL", "/mid", "exported"), ("GET", "home", "plain")]
    assert [(i["module"], i["symbols"]) for i in by("import")] == [("react", ["React", "useState"]), ("path", ["path"]), ("./style.css", [])]
    assert [s["name"] for s in symbols.script_symbols(JS, ".ts")] == ["Service", "plain", "exported", "After", "last"]


def whole_graph(spark, rows=CODE):
    f = code_files(spark) if rows is CODE else spark.createDataFrame(rows, FILES).withColumn("file_type", F.regexp_extract("file_path", r"(\.\w+)$", 1))
    s = symbols.extract_symbols(f)
    files = f.select(ids.file_id("repo_name", "file_path").alias("file_id"), "repo_name", "file_path")
    v = graph.vertices_of(s)
    return f, s, files, v, graph.symbol_edges(s, files, v["classes"])


def named(edges, files, v):
    names = files.select(F.col("file_id").alias("id"), F.col("file_path").alias("n"))
    for kind, label in (("classes", "name"), ("functions", "qualified_name"), ("endpoints", "path_pattern")):
        names = names.unionByName(v[kind].select(F.col(graph.KEYS[kind]).alias("id"), F.col(label).alias("n")))
    e = edges.join(names.withColumnsRenamed({"id": "src", "n": "a"}), "src").join(names.withColumnsRenamed({"id": "dst", "n": "b"}), "dst")
    return {(r["type"], r["a"], r["b"]) for r in e.select("type", "a", "b").collect()}


def test_graph_of_code(spark):
    f, s, files, v, edges = whole_graph(spark)
    got = named(edges, files, v)
    assert {("INHERITS", "Order", "Base"), ("METHOD_OF", "Order.load", "Order"), ("IMPORT_DEP", "app/api.py", "app/models.py"), ("IMPORT_DEP", "src/server.js", "src/charge.js"), ("HANDLES", "/orders/{id}", "get_order"), ("EXPOSES", "src/server.js", "/api/charges"), ("CONTAINS_CLASS", "app/models.py", "Order")} <= got
    links = named(linker.cross_repo_links(f, v["endpoints"]), files, v)
    assert links == {("CROSS_REPO_CALL", "app/api.py", "src/server.js"), ("CROSS_REPO_CALL", "src/server.js", "worker.py")}
    node_ids = graph.node_ids_per_file(s).collect()
    assert sum(len(r["graph_node_ids"]) for r in node_ids) == sum(v[k].count() for k in v)


@pytest.mark.parametrize(
    "module,path,want",
    [
        ("./b", "src/a.js", ["src/b", "src/b.js", "src/b.ts", "src/b.jsx", "src/b.tsx", "src/b/index.js", "src/b/index.ts"]), ("../b", "x/src/a.js", ["x/b", "x/b.js", "x/b.ts", "x/b.jsx", "x/b.tsx", "x/b/index.js", "x/b/index.ts"]),
        (".m", "p/q.py", ["p/m.py", "p/m/__init__.py"]), ("..m.n", "p/q/r.py", ["p/m/n.py", "p/m/n/__init__.py"]), (".", "p/q.py", ["p/__init__.py"]), ("a.b", "x.py", ["a/b.py", "a/b/__init__.py"]), ("os", "x.py", ["os.py", "os/__init__.py"]),
    ],
)
def test_import_candidates(spark, module, path, want):
    assert spark.range(1).select(graph.import_candidates(F.lit(module), F.lit(path))).first()[0] == want


def test_imports_resolve_at_boundaries(spark):
    rows = [("r", "lib/videos.py", "import os\n"), ("r", "a.py", "import a\nimport missing\nimport util\n"), ("r", "pkg/util.py", "x = 1\n"), ("s", "util.py", "y = 1\n"), ("r", "web/index.js", ""), ("r", "app.js", "import x from './web';\n")]
    f, s, files, v, edges = whole_graph(spark, rows)
    assert {e for e in named(edges, files, v) if e[0] == "IMPORT_DEP"} == {("IMPORT_DEP", "a.py", "pkg/util.py"), ("IMPORT_DEP", "app.js", "web/index.js")}


def test_upserts_and_deletes(spark):
    f, s, files, v, edges = whole_graph(spark)
    tables = {k: graph.upsert_vertices(spark.createDataFrame([], graph.SCHEMAS[k]), t, k) for k, t in v.items()}
    again = {k: graph.upsert_vertices(tables[k], v[k], k) for k in v}
    assert {k: t.count() for k, t in again.items()} == {k: t.count() for k, t in v.items()}
    assert graph.upsert_edges(edges, edges).count() == edges.count()
    full = {**tables, "repos": spark.createDataFrame([], graph.SCHEMAS["repos"]), "files": spark.createDataFrame([], graph.SCHEMAS["files"])}
    left, kept = graph.delete_file_symbols(full, edges, spark.createDataFrame([("shop", "app/models.py")], "repo_name string, file_path string"))
    assert left["classes"].where("repo_name = 'shop'").count() == 0 and left["functions"].where("file_path = 'app/models.py'").count() == 0
    assert {r["type"] for r in edges.join(kept, ["type", "src", "dst"], "left_anti").select("type").collect()} == {"INHERITS", "METHOD_OF", "CONTAINS_CLASS", "CONTAINS_FUNCTION"}
    stats = {(r["element"], r["name"]): r["count"] for r in graph.graph_stats(full, edges).collect()}
    assert stats[("edge", "CALLS")] == 0 and stats[("node", "classes")] == 3 and len(stats) == 15


CHUNKS = [("c1", "retailer", "a.py", "def get_user_name(user): return user.name"), ("c2", "retailer", "b.py", "campaign service sends email"), ("c3", "retailer", "c.py", "user campaign"), ("c4", "retailer", "d.py", "database connection pool"), ("c5", "influencer", "e.py", "user profile page for the user")]


def corpus(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, repo_name string, file_path string, content string")


def questions(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, query string")


def test_bm25(spark):
    i = search.build_bm25(corpus(spark))
    assert i.n_chunks == 5
    got = search.bm25_search(i, questions(spark, "campaign email", "zzz", "", "user user")).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} <= {"0", "3"}
    first = [r for r in got if r["query_id"] == "0"]
    assert first[0]["chunk_id"] == "c2" and first[0]["score"] == 1.0 and [r["score"] for r in first] == sorted((r["score"] for r in first), reverse=True)
    scoped = search.bm25_search(i, questions(spark, "profile page"), scope=corpus(spark).where("repo_name = 'retailer'"))
    assert scoped.count() == 0


def lists(spark, *ranked):
    return [spark.createDataFrame([("q", k, k + str(j), r) for r, k in enumerate(keys, 1)], "query_id string, key string, chunk_id string, rank int") for j, keys in enumerate(ranked)]


def test_large_sides_are_dealt_by_more_than_one_key(spark, monkeypatch):
    """Nothing is broadcast beyond the bound, and the dense join's keys take many values."""
    from tessera import settings

    monkeypatch.setenv("BROADCAST_ROWS", "1")
    settings.get_settings.cache_clear()
    monkeypatch.setattr(search.dense, "BLOCK", 16)
    e = spark.range(300).select(F.col("id").alias("chunk_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 2)).alias("embedding"))
    q = e.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    found = search.vector_search(e, q, 5, min_score=-1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "hashpartitioning(size(" not in plan and "SortMergeJoin" in plan
    rows = {r["chunk_id"]: r["embedding"] for r in e.collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {(i, k, j) for i in range(0, 300, 3) for k, j in enumerate(sorted(rows, key=lambda j: (-round(cos(rows[i], rows[j]), 9), j))[:5], 1)}
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in found.collect()} == want
    bm = search.bm25_search(search.build_bm25(corpus(spark)), questions(spark, "campaign email user"))
    assert "Broadcast" not in bm._jdf.queryExecution().executedPlan().toString() and bm.count() > 0
    settings.get_settings.cache_clear()


def test_fusion(spark):
    keys = lambda *ls, **o: [r["key"] for r in search.rrf_fuse(lists(spark, *ls), **o).orderBy("rank").collect()]
    assert keys("abc") == ["a", "b", "c"]
    assert keys("ab", "bc")[0] == "b" and keys("ab", "cd", top_k=3) == ["a", "c", "b"]
    assert keys("xa", "xb", "xc")[0] == "x" and keys("") == []
    row = search.rrf_fuse(lists(spark, "ab", "b")).where("key = 'b'").first()
    assert row["score"] == pytest.approx(1 / 62 + 1 / 61) and row["chunk_id"] == "b1"
    scores = [{r["key"]: round(r["score"], 9) for r in search.rrf_fuse(lists(spark, *p), top_k=9).collect()} for p in itertools.permutations(("ab", "bc", "ca"))]
    assert all(s == scores[0] for s in scores)


def test_dense(spark):
    e = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], "x"), ("c", [0.9, 0.1], "y"), ("d", [0.0, 0.0], "x")], "chunk_id string, embedding array<double>, repo string")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    ids_ = lambda **o: [r["chunk_id"] for r in search.vector_search(e, q, 3, **o).orderBy("rank").collect()]
    assert ids_() == ["a", "c"] and ids_(scope=F.col("repo") == "x") == ["a"] and ids_(min_score=-1.0) == ["a", "c", "b"] and ids_(metric="l2_relevance") == ["a", "c"]
    with pytest.raises(ValueError):
        search.vector_search(e, q, metric="other")


def test_rerank(spark):
    rows = spark.createDataFrame([("q", "user", "nothing", 1), ("q", "user", "the user", 2), ("q", "user", "also nothing", 3)], "query_id string, query string, content string, rank int")
    order = lambda model, k=None: [r["content"] for r in search.rerank(rows, model, k).orderBy("rank").collect()]
    assert order(None) == ["nothing", "the user", "also nothing"] and order(None, 1) == ["nothing"]
    from tessera.functions.models import overlap_reranker

    assert order(overlap_reranker, 2) == ["the user", "nothing"]

    def broken(q, t):
        raise OSError("down")

    assert order(broken, 2) == ["nothing", "the user"] and order(lambda q, t: F.when(t != "nothing", 1.0)) == order(None)


def test_questions_against_the_graph(spark):
    f, s, files, v, edges = whole_graph(spark)
    names = traverse.known_names(v["classes"], v["functions"], v["endpoints"])
    asked = questions(spark, "How does Order work with get_order?", "who budgets", "what about /api/charges and the charge?")
    found = {}
    for r in traverse.extract_entities(asked, names).collect():
        found.setdefault(r["query_id"], set()).add(r["entity"])
    assert {"Order", "get_order", "How"} <= found["0"] and "charge" in found["2"] and "/api/charges" in found["2"] and "get" not in found.get("1", set())
    matches = traverse.find_nodes(traverse.extract_entities(asked, names), v["classes"], v["functions"], v["endpoints"])
    near, far = ({(r["query_id"], r["file_path"]) for r in traverse.related_files(matches, files, edges, h).collect()} for h in (1, 3))
    assert ("0", "app/models.py") in near and near <= far and ("2", "src/charge.js") in far
    text = {r["query_id"]: r["summary"] for r in traverse.summarise(matches, traverse.methods_of(matches, v["functions"], edges)).collect()}
    assert "* class `Order` (shop: app/models.py) with `load`" in text["0"] and "* async `get_order` (shop: app/api.py)" in text["0"] and "* route `GET /api/charges` of express (pay: src/server.js)" in text["2"]


def test_hops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = lambda h, **o: {r["node"]: r["hops"] for r in traverse.k_hops(e, spark.createDataFrame([("a",)], "start string"), h, **o).collect()}
    assert got(1) == {"a": 0, "b": 1} and got(5) == {"a": 0, "b": 1, "c": 2, "d": 3} and got(1, undirected=True) == {"a": 0, "b": 1, "c": 1}


def test_viewer(spark):
    n = spark.createDataFrame([("1", "File", "A.py", "r"), ("2", "File", "b.py", "s"), ("3", "Class", "C", "r")], "id string, type string, label string, repo_name string")
    e = spark.createDataFrame([("CONTAINS", "1", "3"), ("CONTAINS", "2", "3"), ("CALLS", "1", "3")], "type string, src string, dst string")
    nodes, edges = viewer.subgraph(n, e, 1)
    assert {r["id"] for r in nodes.collect()} == {"1", "3"} and [tuple(r) for r in edges.select("src", "dst").collect()] == [("1", "3")]
    assert viewer.subgraph(n, e, 9, repo="s")[0].count() == 1 and [r[0] for r in viewer.repo_list(n).collect()] == ["r", "s"]
    assert {r["id"]: r["faded"] for r in viewer.faded(n, "a", ("File",)).collect()} == {"1": False, "2": True, "3": True}
    around = viewer.neighbours(e, n, n.where("id = '3'"), 2).collect()
    assert len(around) == 2 and around[0]["total"] == 3 and {r["direction"] for r in around} == {"←"}
    assert viewer.export(nodes, edges).count() == 3 + viewer.stats(nodes, edges).count()


def entries(spark, *rows):
    df = spark.createDataFrame(rows, "query string, embedding array<double>, answer string, created_at string")
    return cache.store(spark.createDataFrame([], cache.ENTRY), df.withColumn("created_at", F.col("created_at").cast("timestamp")))


def test_cache(spark):
    unit = lambda i: [1.0 if k == i else 0.0 for k in range(8)]
    near = [0.99, 0.14] + [0.0] * 6
    c = entries(spark, ("a", unit(0), "A", "2024-01-01"), ("b", unit(0), "B", "2024-01-02"), ("lost", None, "X", "2024-01-03")).persist()
    q = spark.createDataFrame([("same", "x", unit(0)), ("near", "x", near), ("far", "x", unit(1)), ("blank", " ", unit(0)), ("none", "x", None), ("zero", "x", [0.0] * 8)], "query_id string, query string, embedding array<double>")
    hits = cache.lookup(c, q).join(c.select("id", "answer"), "id")
    assert {r["query_id"]: r["answer"] for r in hits.collect()} == {"same": "A", "near": "A"}
    assert cache.lookup(c.limit(0), q).count() == 0
    assert tuple(cache.stats(c).first()) == (2, 0) and tuple(cache.stats(cache.record_hits(c, hits)).first()) == (2, 2)
    assert [r["answer"] for r in cache.evict(c, 1).collect()] == ["B"] and cache.invalidate(c)[1] == 2


def test_drift(spark):
    probe = lambda v: spark.createDataFrame([(v,)], "probe_embedding array<double>")
    none = spark.createDataFrame([], drift.FINGERPRINT)
    kept = drift.record(probe([1.0, 0.0]), "m")
    verdict = lambda f, v, m="m": tuple(drift.check(f, probe(v), m).first())
    assert verdict(none, [1.0, 0.0]) == (False, "no_fingerprint", 1.0)
    assert verdict(kept, [1.0, 0.0]) == (False, "same", 1.0)
    assert verdict(kept, None, "n") == (True, "model_changed", 0.0)
    assert verdict(kept, [0.0, 1.0]) == (True, "vector_changed", 0.0)
    assert verdict(kept, None) == (False, "embedder_unavailable", 1.0)
    assert verdict(kept, [1.0])[1] == "vector_changed" and drift.record(probe(None), "m").count() == 0


def test_evaluation(spark):
    q = spark.createDataFrame([("1", "why", ["a/x.py"], ["t"]), ("2", "how", [], [])], "id string, question string, expected_files array<string>, tags array<string>")
    a = spark.createDataFrame([("1", "ans", ["b/x.py"], 10.0, True, 5, 6, None), ("2", "", [], 0.0, False, 1, 1, "boom")], "question_id string, answer string, relevant_files array<string>, retrieval_ms double, cache_hit boolean, input_tokens int, output_tokens int, error string")
    dry = evals.evaluate(q, a)
    assert dry.where("judge_scores is not null").count() == 0 and {r["question_id"]: r["file_recall"] for r in dry.collect()} == {"1": 1.0, "2": 1.0}
    judged = evals.evaluate(q, a, lambda q, t: F.lit('{"faithfulness": 5, "completeness": 4, "relevance": 3}'))
    s = evals.summary(judged).first().asDict()
    assert (s["total"], s["successful"], s["failed"], s["mean_faithfulness"], s["cache_hit_rate"], s["total_input_tokens"]) == (2, 1, 1, 5.0, 1.0, 5)
    assert evals.summary(judged.limit(0)).first()["mean_file_recall"] == 0.0


def test_first_links_make_each_pair_once_and_shuffle_none(spark):
    rows = [(f"r{k % 3}", f"f{k}", t) for k in range(40) for t in (f"t{k % 4}", f"t{k % 5 + 2}", "all", "all")]
    made = spark.createDataFrame(rows, "repo_name string, file_path string, topic string")
    used = made.withColumnsRenamed({"repo_name": "to_repo", "file_path": "to_path"})
    want = {}
    for (a, b, t), (c, d, u) in itertools.product(rows, rows):
        if t == u and a != c:
            want[a, b, c, d] = min(t, want.get((a, b, c, d), t))
    most, linker.CONSUMERS_A_PART = linker.CONSUMERS_A_PART, 7
    try:
        found = linker.first_links(made, used)
        got = found.collect()
    finally:
        linker.CONSUMERS_A_PART = most
    assert len(got) == len(want) and {tuple(r)[:4]: r["topic"] for r in got} == want
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]  # nothing is grouped above the join that makes the pairs


def test_bm25_scores_chunks_by_part_as_pairs_would(spark, monkeypatch):
    """Several parts and blocks give what a join of each query's terms with the postings gives, ties by id, and no pair is shuffled."""
    rng = random.Random(4)
    words = [f"word{k}" for k in range(30)] + ["common"] * 6
    texts = [(f"c{k:03d}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for k in range(120)] + [(f"d{k}", "word1 common word2") for k in range(30)]
    chunks_, asked = spark.createDataFrame(texts, "chunk_id string, content string"), spark.createDataFrame([(f"q{k}", " ".join(rng.choice(words) for _ in range(5))) for k in range(9)] + [("none", "zzzz"), ("empty", "")], "query_id string, query string")
    index = search.build_bm25(chunks_)
    terms = asked.select("query_id", F.explode(search.code_tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")).join(index.terms, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / index.avg_length))
    pairs = index.postings.join(terms, "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score")).where("score > 0")
    scope = chunks_.where("chunk_id >= 'c050'").select("chunk_id")
    monkeypatch.setattr(search, "CHUNKS_A_PART", 16)
    monkeypatch.setattr(search, "QUERIES_A_PART", 3)
    for some, within in ((pairs, None), (pairs.join(scope, "chunk_id", "left_semi"), scope)):
        want = search.rank_by(some, 7, search._near(), F.asc("chunk_id"))
        found = search.bm25_search(index, asked, 7, within, normalise=False)
        rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in df.collect())
        assert rows(found) == rows(want) and found.count() > 50
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [query_id" not in plan.split("FlatMapCoGroups")[0]


def test_files_made_from_a_small_table_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from tessera import cases

    spark.range(1, 101).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(cases, "ROWS_A_TASK", 10)
    found = cases.script_shapes(spark, str(tmp_path)).where("kind = 'class'").withColumn("task", F.spark_partition_id())
    by = [r["count"] for r in found.groupBy("task").count().collect()]
    assert sum(by) == 100 and len(by) == 10


def test_edges_are_made_distinct_as_numbers_and_named_afterwards(spark):
    from tessera import queries

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    edges, imports = plan(queries._edges(spark, "/root/testdata/sf0.001")), plan(queries._imports(spark, "/root/testdata/sf0.001")[1])
    assert edges.count("Aggregate [") == 6 and "Aggregate [type" not in edges
    assert "Aggregate [l_orderkey" in imports and "Aggregate [type" not in imports and "Aggregate [src" not in imports


def test_a_stored_table_is_sized_without_computing_its_rows(spark, monkeypatch):
    from tessera import queries
    from tessera.sources.layers import Layout

    rows = spark.range(5).selectExpr("id as k")
    monkeypatch.setattr(rows, "count", lambda: pytest.fail("the rows were counted"))
    stored = queries.layered(spark, "sized test", Layout("k long", ("k",), ("k",)), rows, lambda change: (spark.range(2).selectExpr("id as k"), spark.range(1).selectExpr("id as k")), sized=spark.range(5))
    assert sorted(r["k"] for r in stored.collect()) == [0, 2, 3, 4]


def test_edges_dedup_compares_no_type_that_its_layer_does_not_touch(spark, monkeypatch):
    """Each edge comes once; orders' edges, nearly all there are, are read beside the join with the layer."""
    from tessera import queries
    from tessera.sources import layers

    sides, base = [], layers.Snapshot._base
    monkeypatch.setattr(layers.Snapshot, "_base", lambda self, layout, entry, buckets: sides.append(base(self, layout, entry, buckets)) or sides[-1])
    found = queries.edges_dedup(spark, "/root/testdata/sf0.001")
    want = queries._edges(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    compared, read = sides[-2:]
    assert {r["type"] for r in compared.select("type").distinct().collect()} == {"IN_REGION"}
    assert {r["type"] for r in read.select("type").distinct().collect()} == {"ORDERED_BY", "HAS_PART", "FROM_SUPPLIER"}


def test_first_links_pair_lists_of_files(spark, monkeypatch):
    """Files of a repository with the same topics meet as lists, cut at a bound, and each pair comes once; a file without a name stays."""
    monkeypatch.setattr(linker, "FILES_A_LIST", 4, raising=False)
    rows = [(f"r{k % 2}", f"f{k:02d}" if k else None, t) for k in range(30) for t in ("a", "b", f"c{k % 3}")[k % 2 :]]
    made = spark.createDataFrame(rows, "repo_name string, file_path string, topic string")
    found = linker.first_links(made, made.withColumnsRenamed({"repo_name": "to_repo", "file_path": "to_path"}))
    want = {}
    for (a, b, t), (c, d, u) in itertools.product(rows, rows):
        if t == u and a != c:
            want[a, b, c, d] = min(t, want.get((a, b, c, d), t))
    got = found.collect()
    assert len(got) == len(want) == 450 and {tuple(r)[:4]: r["topic"] for r in got} == want
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan[: plan.index("Join")].count("Generate explode(") == 2
