import pytest
from pyspark.sql import functions as F

from tessera import settings
from tessera.__main__ import build_parser, main
from tessera.operators import cache as caching
from tessera.plans import ask, evaluate, index, service
from tessera.queries import CODE
from tessera.sources import repos, tables
from tessera.streaming import ingest


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    for repo, path, text in CODE:
        at = root / repo / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    at = str(tmp_path_factory.mktemp("index"))
    result = index.run(spark, repos.load_repos(spark, str(root)), at)
    return root, at, result


def questions(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, query string")


def test_index_and_reindex(spark, built):
    root, at, first = built
    assert (first.total_files, first.changed_files, first.drift) == (5, 5, "no_fingerprint") and first.graph_edges > 10
    again = index.run(spark, repos.load_repos(spark, str(root)), at)
    assert (again.changed_files, again.removed_files, again.total_chunks, again.graph_edges, again.drift) == (0, 0, first.total_chunks, first.graph_edges, "same")
    i = index.Index(spark, at)
    kinds = {r["type"] for r in i.table("edges").select("type").distinct().collect()}
    assert {"BELONGS_TO_REPO", "INHERITS", "IMPORT_DEP", "HANDLES", "CROSS_REPO_CALL"} <= kinds
    assert i.table("registry").where(F.size("graph_node_ids") > 0).count() == 5
    few = repos.load_repos(spark, str(root)).where("file_path <> 'worker.py'").withColumn("content", F.when(F.col("file_path") == "app/models.py", "class Base:\n    pass\n").otherwise(F.col("content")))
    few = few.withColumn("content_hash", F.sha2("content", 256))
    moved = index.run(spark, few, at)
    i.refresh()
    assert (moved.changed_files, moved.removed_files) == (1, 1) and i.table("classes").where("name = 'Order'").count() == 0
    full = index.run(spark, repos.load_repos(spark, str(root)), at, reindex=True)
    assert full.changed_files == 5 and full.graph_edges == first.graph_edges


def test_ask(spark, built):
    i = index.Index(spark, built[1])
    got = {r["query_id"]: r for r in ask.run(i, questions(spark, "How does get_order load an Order?", "?")).collect()}
    assert "app/api.py" in got["0"]["relevant_files"] and "get_order" in got["0"]["query_entities"] and "Question:\nHow does get_order" in got["0"]["prompt"] and "Known from the graph:\n" in got["0"]["prompt"]
    assert got["1"]["answer"] == ask.NOTHING and got["1"]["chunks"] == 0
    only = ask.retrieve(i, questions(spark, "charges"), repo="pay").collect()
    assert only and {r["repo_name"] for r in only} == {"pay"}
    assert ask.traces(ask.run(i, questions(spark, "get_order", "?"))).count() == 1


def test_ask_through_the_cache(spark, built):
    i, q = index.Index(spark, built[1]), questions(spark, "How does get_order load an Order?", "worker subscribe")
    embed = ask.hashing_embedder()
    known = q.where("query_id = '0'").select("query", embed(F.col("query")).alias("embedding"), F.lit("cached").alias("answer"), F.array(F.lit("f")).alias("relevant_files"))
    c = caching.store(spark.createDataFrame([], caching.ENTRY), known).persist()
    got = {r["query_id"]: r for r in ask.run(i, q, cache=c).collect()}
    assert got["0"]["cache_hit"] and got["0"]["answer"] == "cached" and not got["1"]["cache_hit"]


def test_answers_fill_the_cache_and_are_traced(spark, built, tmp_path):
    i, at = index.Index(spark, built[1]), str(tmp_path / "t")
    service.invalidate_cache(i)
    first = {r["query_id"]: r for r in ask.answer(i, questions(spark, "How does get_order load an Order?", "?"), trace_path=at).collect()}
    assert not first["0"]["cache_hit"] and first["0"]["vector_count"] + first["0"]["bm25_count"] > 0 and first["0"]["retrieval_ms"] > 0
    stored = i.table("cache").collect()
    assert [(r["query"], r["answer"], r["hit_count"]) for r in stored] == [("How does get_order load an Order?", first["0"]["answer"], 0)]
    again = {r["query_id"]: r for r in ask.answer(i, questions(spark, "How does get_order load an Order?", "?"), trace_path=at).collect()}
    assert again["0"]["cache_hit"] and again["0"]["answer"] == first["0"]["answer"]
    assert [r["hit_count"] for r in i.table("cache").collect()] == [1]
    (trace,) = spark.read.json(at).collect()  # neither the hit nor the empty result
    assert trace["query"].startswith("How") and trace["total_fused_chunks"] == first["0"]["chunks"] and trace["retrieval_ms"] == round(trace["retrieval_ms"], 2) and trace["input_tokens"] > 0
    assert service.invalidate_cache(i) == 1


def test_only_changed_files_are_parsed(spark, built, monkeypatch, tmp_path):
    from tessera.operators import symbols

    files = repos.load_repos(spark, str(built[0]))
    at, seen = str(tmp_path / "i"), []
    real = symbols.extract_symbols
    monkeypatch.setattr(symbols, "extract_symbols", lambda f: seen.append(f.count()) or real(f))
    first = index.run(spark, files, at)
    changed = files.withColumn("content", F.when(F.col("file_path") == "app/models.py", F.concat("content", F.lit("\nclass New(Base): pass\n"))).otherwise(F.col("content"))).withColumn("content_hash", F.sha2("content", 256))
    second = index.run(spark, changed, at)
    fresh = index.run(spark, changed, str(tmp_path / "j"))
    assert seen == [5, 1, 5] and second.graph_edges == fresh.graph_edges == first.graph_edges + 2 and second.counters()["changed_files"] == 1
    a, b = (index.Index(spark, str(tmp_path / k)) for k in "ij")
    for name in ("edges", "classes", "functions", "endpoints", "postings", "terms", "chunks"):
        cols = [c for c in a.table(name).columns if c not in ("embedding", "last_indexed_at")]
        assert a.table(name).select(cols).exceptAll(b.table(name).select(cols)).isEmpty() and a.table(name).count() == b.table(name).count()


def code(*rows):
    return [("r", path, text) for path, text in rows]


def files_of(spark, rows):
    shape = "repo_name string, file_path string, content binary"
    f = repos.file_rows(spark.createDataFrame([(r, p, t.encode()) for r, p, t in rows], shape))
    return f.select("*", *[F.lit(None).cast("string").alias(c) for c in ("git_commit_sha", "git_last_modified_at", "git_last_modified_by")])


def size(path):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_increments_resolve_as_a_full_build(spark, tmp_path, monkeypatch):
    """Classes, files and routes that come and go change the edges of files that stay, and only so much is parsed and written."""
    from tessera.operators import symbols

    monkeypatch.setenv("USE_CROSS_REPO_LINKING", "true")
    settings.get_settings.cache_clear()
    body = "\n".join(f"def f{k}(): return {k}" for k in range(60))
    many = [(f"pkg/m{k}.py", f"import m{k + 1}\nclass C{k}(C{k + 1}): pass\n{body}\n") for k in range(40)]
    first = code(*many, ("a/child.py", "from lib import util\nclass Child(Base): pass\n"), ("z/base.py", "class Base: pass\n"), ("old/lib.py", "x = 1\n"), ("call.py", "import requests\nrequests.get('/api/things')\n"))
    first += [("s", "api.py", "@app.get('/api/things')\ndef things(): pass\n")]
    # a nearer Base, another lib, a route that went, a file that went and one that changed
    second = [r for r in first if r[1] not in ("old/lib.py", "api.py", "pkg/m7.py")] + code(("b/base.py", "class Base: pass\nclass C8: pass\n"), ("lib/__init__.py", "y = 2\n"), ("pkg/m7.py", "class C7(Base): pass\n")) + [("s", "api.py", "@app.get('/api/other')\ndef things(): pass\n")]
    seen, real = [], symbols.extract_symbols
    monkeypatch.setattr(symbols, "extract_symbols", lambda f: seen.append(f.count()) or real(f))
    at, fresh = str(tmp_path / "i"), str(tmp_path / "j")
    index.run(spark, files_of(spark, first), at)
    whole = size(at)
    index.run(spark, files_of(spark, second), at)
    assert size(at) - whole < whole / 2  # many small files here; what a layer holds is tested with the tables
    index.run(spark, files_of(spark, second), fresh)
    assert seen == [len(first), 4, len(second)]
    a, b = index.Index(spark, at), index.Index(spark, fresh)
    for name in ("edges", "classes", "functions", "endpoints", "postings", "terms", "chunks", "names", "parents", "tails", "imports", "calls", "symbols"):
        x, y = (i.snapshot.table(name).drop("embedding", "last_indexed_at") for i in (a, b))
        assert sorted(map(repr, x.collect())) == sorted(map(repr, y.collect())), name
    assert a.table("edges").where("type = 'CROSS_REPO_CALL'").isEmpty() and a.table("edges").where("type = 'INHERITS'").count() > 38
    settings.get_settings.cache_clear()


def test_a_run_that_stops_leaves_the_index_whole(spark, tmp_path, monkeypatch):
    from tessera.operators import linker

    at = str(tmp_path / "i")
    index.run(spark, files_of(spark, code(("a.py", "class A: pass\n"), ("b.py", "import a\n"))), at)
    held = index.Index(spark, at)
    before = {n: sorted(map(repr, held.snapshot.table(n).collect())) for n in ("chunks", "edges", "registry", "postings", "classes")}
    files = size(at)
    later = files_of(spark, code(("a.py", "class B: pass\n"), ("c.py", "import a\n")))
    with monkeypatch.context() as m:
        m.setattr(linker, "links_of", lambda *a, **b: 1 / 0)
        with pytest.raises(ZeroDivisionError):  # chunks, postings and vertices are written by then
            index.run(spark, later, at)
    now = index.Index(spark, at)
    assert {n: sorted(map(repr, now.snapshot.table(n).collect())) for n in before} == before and size(at) == files
    index.run(spark, later, at)
    assert {n: sorted(map(repr, held.snapshot.table(n).collect())) for n in before} == before  # what is open stays
    assert [r["name"] for r in held.refresh().table("classes").collect()] == ["B"]


def test_a_question_reads_its_terms_buckets(spark, built):
    i = index.Index(spark, built[1])
    stored, made = i.bm25(), ask.search.build_bm25(i.table("chunks"))
    q = questions(spark, "get_order charges")
    rows = lambda x: sorted((r["chunk_id"], round(r["score"], 9)) for r in ask.search.bm25_search(x, q).collect())
    assert rows(stored) == rows(made) and stored.postings.columns[-1] == "bucket"


def test_curation(spark):
    rows = spark.createDataFrame([("q", "why", 1, "a.py", "one"), ("q", "why", 2, "b.py", "two"), ("q", "why", 3, "a.py", "three")], "query_id string, query string, rank int, file_path string, content string")
    plain = ask.curate(rows).first()
    assert (plain["summary"], plain["relevant_files"], plain["chunk_count"]) == ("one\n\ntwo\n\nthree", ["a.py", "b.py"], 3)
    seen = []
    chosen = ask.curate(rows, lambda c: seen.append(1) or F.lit('```json\n{"summary": "S", "relevant_files": ["x"], "kept_chunk_indices": [0, 2, 9, -1]}\n```')).first()
    assert (chosen["summary"], chosen["relevant_files"], chosen["chunk_count"]) == ("S", ["x"], 2) and seen
    assert ask.curate(rows, lambda c: F.lit("broken")).first()["summary"] == plain["summary"]


def test_service(spark, built, monkeypatch):
    i = index.Index(spark, built[1])
    assert sum(sum(r[2:]) for r in i.file_counters().collect()) == i.graph()["classes"].count() + i.graph()["functions"].count() + i.graph()["endpoints"].count() + i.table("edges").count()
    assert service.health()["status"] == "ok" and service.ready(i)["status"] == "ready" and service.ready(index.Index(spark, built[1] + "/none"))["status"] == "not_ready"
    totals, by_repo = service.index_stats(i)
    assert totals.first()["total_repos"] == 3 and [r["repo_name"] for r in by_repo.collect()] == ["mail", "pay", "shop"]
    assert service.graph_stats(i).where("name = 'IMPORT_DEP'").first()["count"] == 2
    found = service.graph_traverse(i, "Order", 9)
    assert found["matches"].count() == 1 and found["related_files"].count() >= 1
    assert service.graph_data(i, 1)["nodes"].count() == 5
    assert service.invalidate_cache(i) == 0
    job = service.start_index(spark, files=repos.load_repos(spark, str(built[0])), index_dir=built[1])
    assert service.index_status(job)["status"] in ("running", "completed") and service.wait(job)["status"] == "completed"
    assert service.wait(service.start_index(spark, files=spark.range(1), index_dir=built[1]))["status"] == "failed"
    with pytest.raises(KeyError):
        service.index_status("x")
    settings.get_settings.cache_clear()
    assert service.authorise(None) == 200
    monkeypatch.setenv("API_KEY", "k")
    settings.get_settings.cache_clear()
    assert [service.authorise(h) for h in (None, "k", "Bearer x", "Bearer k")] == [401, 401, 403, 200]
    monkeypatch.delenv("API_KEY")
    settings.get_settings.cache_clear()


def test_evaluation_run(spark, built, tmp_path):
    q = tables.parse_questions(spark.createDataFrame([('{"id": "1", "question": "get_order", "expected_files": ["app/api.py"]}',)], "value string"))
    results, summary = evaluate.run(index.Index(spark, built[1]), q, str(tmp_path / "out"))
    assert results.first()["file_recall"] == 1.0 and summary.first()["successful"] == 1


def test_command_line(spark, built, capsys):
    assert build_parser().parse_args(["ask", "x", "--repo", "r", "--no-bm25"]).no_bm25
    assert main(["--index-dir", built[1], "ask", "get_order"]) == 0 and "app/api.py" in capsys.readouterr().out
    assert main(["--index-dir", built[1] + "/none", "stats"]) == 1
    assert main(["--index-dir", built[1], "stats"]) == 0 and main(["--index-dir", built[1], "graph-stats"]) == 0


def test_a_stream_asks_the_cache(spark, tmp_path):
    unit = lambda i: [1.0 if k == i else 0.0 for k in range(4)]
    known = spark.createDataFrame([("a", unit(0), "A")], "query string, embedding array<double>, answer string")
    tables.publish(caching.store(spark.createDataFrame([], caching.ENTRY), known), str(tmp_path / "cache"))
    shape = "query_id string, query string, embedding array<double>"
    for batch in ([("1", "x", unit(0)), ("2", "x", unit(1))], [("3", "x", unit(0))]):
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.answer_stream(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), str(tmp_path / "cache"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r["query_id"], r["answer"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("1", "A"), ("3", "A")}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    shape = "repo_name string, file_path string, content string"
    for batch in ([("r", "a", "1"), ("r", "b", "2")], [("r", "b", "3")]):
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(src)
        ingest.register_stream(spark.readStream.schema(shape).parquet(src), str(tmp_path / "reg"), str(tmp_path / "cp")).awaitTermination()
    got = {r["file_path"]: r["content_hash"][:4] for r in ingest.registered(spark, str(tmp_path / "reg")).collect()}
    assert got == {"a": "6b86", "b": "4e07"}
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = ingest.windowed_counts(events).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 1000
