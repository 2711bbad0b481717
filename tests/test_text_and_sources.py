import json
import logging
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera import logs, settings
from tessera.functions.calls import call_links, may_link
from tessera.functions import ids, text, vectors
from tessera.functions.models import hashing_embedder, overlap_reranker
from tessera.sources import repos, tables


def values(spark, expression, *rows, kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_code_tokens(spark):
    got = values(spark, text.code_tokens, "getUserName", "HTTPServer parse_json x 42", "", None, "a b cd", "v2API")
    assert got == [["get", "user", "name"], ["http", "server", "parse", "json", "42"], [], [], ["cd"], ["v2api"]]


def test_entities(spark):
    got = values(spark, text.text_entities, "How does CampaignService call get_user_id at /api/v1/users?", "nothing here", None)
    assert got == [["/api/v1/users", "CampaignService", "How", "get_user_id"], [], []]


def test_paths(spark):
    assert values(spark, text.basename, "a/b/c.py", "c") == ["c.py", "c"]
    assert values(spark, text.suffix, "a/b.C.PY", "a/.env", "Dockerfile") == [".py", "", ""]
    assert values(spark, text.parent, "a/b/c.py", "c.py") == ["a/b", ""]


def test_call_sites(spark):
    code = """requests.get("http://svc/api/x?y=1"); axios.post('/v1/items'); fetch(`/a/b#c`); requests.get("x"); p.produce("topic-1", v); c.subscribe(['topic-2', 'z'])"""
    rows = spark.createDataFrame([(1, code, ".js"), (2, "HTTPX . Request ( f'http://a/b' )", ".py"), (3, "prefetch('/abcd')", ".py"), (4, None, ".py")], "k int, c string, t string")
    got = {r["k"]: [tuple(x) for x in r["l"]] for r in rows.select("k", call_links("c", "t").alias("l")).collect()}
    assert got == {1: [("http", "http://svc/api/x?y=1"), ("http", "/v1/items"), ("http", "/a/b#c"), ("made", "topic-1"), ("used", "topic-2")], 2: [("http", "http://a/b")], 3: [], 4: []}
    assert [r["k"] for r in rows.where(may_link("c")).orderBy("k").collect()] == [1, 2, 3]
    assert values(spark, text.url_path, "http://svc/api/x?y=1", "https://svc", "https://svc/", "/a/b#c", "/", "svc/x", None) == ["/api/x", None, None, "/a/b", None, None, None]


def test_json_recovery(spark):
    raw = ['{"a": 1}', 'Sure!\n```json\n{"a": 1}\n```', '`{"a": 1}`', 'so {"a": 1} it is', "no json", "", None]
    assert [x and json.loads(x) for x in values(spark, text.json_object, *raw)] == [{"a": 1}] * 4 + [None] * 3
    got = values(spark, text.judge_scores, '{"faithfulness": 5, "completeness": 4, "relevance": 3, "explanation": "ok"}', '{"faithfulness": 2}', "?")
    assert [tuple(r) for r in got] == [(5, 4, 3, "ok"), (2, 3, 3, ""), (3, 3, 3, "parse_failed")]
    assert spark.range(1).select(text.judge_mean(F.struct(F.lit(3.0).alias("faithfulness"), F.lit(4.0).alias("completeness"), F.lit(5.0).alias("relevance")))).first()[0] == 4


def test_recall(spark):
    rows = [(["a/x.py", "b/y.py"], ["c/x.py"]), ([], ["z"]), (None, None), (["q.py"], ["r.py"]), (["x.py"], ["x.py", "x.py"])]
    df = spark.createDataFrame(rows, "e array<string>, r array<string>")
    assert [x[0] for x in df.select(text.file_recall("e", "r")).collect()] == [0.5, 1.0, 1.0, 0.0, 1.0]


def test_ids(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    row = spark.range(1).select(ids.file_id(F.lit("r"), F.lit("p")), ids.chunk_id(F.lit("r"), F.lit("p"), F.lit(3)), ids.class_id(F.lit("r"), F.lit("p"), F.lit("C")), ids.endpoint_id(F.lit("r"), F.lit(None), F.lit("GET"), F.lit("/"))).first()
    assert list(row) == [sha("r::p"), sha("r::p::3"), sha("r::p::class::C"), sha("r::::endpoint::GET::/")]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([1, 0, 0, 0.96])


def test_offline_models(spark):
    e = hashing_embedder(16)
    df = spark.createDataFrame([("load the user record",), ("load the user record",), ("",)], "t string").select(e(F.col("t")).alias("v")).collect()
    assert df[0] == df[1] and sum(x * x for x in df[0]["v"]) == pytest.approx(1) and set(df[2]["v"]) == {0.0}
    assert spark.range(1).select(overlap_reranker(F.lit("get user"), F.lit("the user"))).first()[0] == 0.5


def test_load_repos(spark, tmp_path):
    files = {"shop/a.py": b"x = 1\n", "shop/node_modules/b.py": b"y", "shop/blank.py": b" \n", "shop/Dockerfile": b"FROM x", "shop/pic.png": b"png", "pay/src/c d+e.ts": "let é;".encode() + b"\xff", "pay/big.py": b"#" * 600_000, "top.py": b"z"}
    for name, data in files.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    got = {(r["repo_name"], r["file_path"]): r for r in repos.load_repos(spark, str(tmp_path)).collect()}
    assert set(got) == {("shop", "a.py"), ("shop", "Dockerfile"), ("pay", "src/c d+e.ts")}
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", repos.name_glob()).load(str(tmp_path))
    assert not any(f.endswith(".png") for f in raw.inputFiles()) and len(raw.inputFiles()) == len(files) - 1  # images aren't even opened
    ts = got[("pay", "src/c d+e.ts")]
    assert (ts["content"], ts["file_type"], ts["language"], ts["size_bytes"], ts["git_commit_sha"]) == ("let é;", ".ts", "typescript", 7, None)


def test_replacement_characters_of_the_text_stay(spark):
    rows = [(b"a\xff\xef\xbf\xbdb",), ("ok \ufffd".encode(),), (b"\xc3(",), (None,)]
    got = spark.createDataFrame(rows, "c binary").select(repos.utf8_text(F.col("c"))).collect()
    assert [r[0] for r in got] == ["a\ufffdb", "ok \ufffd", "(", None]


def test_git_metadata(spark, tmp_path):
    import subprocess

    repo = tmp_path / "shop"
    repo.mkdir()
    (tmp_path / "plain").mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init")
    for name, message in (("a.py", "one"), ("b é.py", "two"), ("a.py", "three")):
        (repo / name).write_text(f"x = '{message}'\n")
        run("add", "-A")
        run("commit", "-m", message)
    got = {r["file_path"]: r for r in repos.git_metadata(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", "b é.py"} and got["a.py"]["git_commit_sha"] != got["b é.py"]["git_commit_sha"] and got["a.py"]["git_last_modified_by"] == "Ann"
    files = {r["file_path"]: r["git_commit_sha"] for r in repos.load_repos(spark, str(tmp_path), repos.git_metadata(spark, str(tmp_path))).collect()}
    assert files["a.py"] == got["a.py"]["git_commit_sha"][:8]
    assert repos.last_commits(str(tmp_path / "none")) == []


def test_readers_of_the_version_before_can_finish(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.publish(spark.range(3), at)
    old = tables.open_table(spark, at)
    tables.publish(spark.range(5), at)
    assert old.count() == 3 and tables.open_table(spark, at).count() == 5
    for n in (6, 7):
        tables.publish(spark.range(n), at)
    import os

    assert len([d for d in os.listdir(at) if d.startswith("v-")]) == 2 and not [d for d in os.listdir(at) if d.startswith("_current.")]


def test_publish_and_open(spark, tmp_path):
    at = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tables.open_table(spark, at)
    assert tables.open_table(spark, at, "a int").count() == 0
    tables.publish(spark.range(3), at)
    old = tables.publish(spark.range(5), at, keep_old=True)
    assert tables.open_table(spark, at).count() == 5
    with pytest.raises(Exception):
        tables.publish(spark.range(2).select(F.raise_error(F.lit("x")).cast("string").alias("x")), at)
    assert tables._current(spark, at) == old and tables.open_table(spark, at).count() == 5


def test_questions(spark, tmp_path):
    at = tmp_path / "q.jsonl"
    at.write_text('# note\n\n{"id": "1", "question": "why?"}\n{"id": "2", "question": "x", "difficulty": "hard", "expected_files": ["a"]}\n')
    got = {r["id"]: r for r in tables.read_questions(spark, str(at)).collect()}
    assert got["1"]["difficulty"] == "medium" and got["1"]["expected_files"] == [] and got["2"]["expected_files"] == ["a"]
    for bad, why in (('{"question": "x"}', "line 3: missing id"), ("{oops", "line 3: invalid JSON")):
        at.write_text("# note\n\n" + bad)
        with pytest.raises(Exception, match=why):
            tables.read_questions(spark, str(at)).collect()


def test_sinks(spark, tmp_path):
    for _ in range(2):
        tables.append_traces(spark.createDataFrame([("q",)], "query string"), str(tmp_path / "t"))
        tables.write_results(spark.createDataFrame([("q",)], "query string"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2 and spark.read.json(str(tmp_path / "r")).count() == 1


def test_settings(monkeypatch):
    settings.get_settings.cache_clear()
    monkeypatch.setenv("TOP_K_RESULTS", "9")
    monkeypatch.setenv("USE_GRAPH", "false")
    monkeypatch.setenv("API_KEY", "  ")
    s = settings.get_settings()
    assert (s.top_k_results, s.use_graph, s.api_key) == (9, False, None)
    settings.get_settings.cache_clear()


def test_settings_of_a_file_and_a_session(spark, monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".env").write_text("# note\nexport TOP_K_RESULTS='3'\nCHUNK_SIZE=70\nVECTOR_TOP_K=4\n")
    spark.conf.set("spark.tessera.chunk_size", "80")
    spark.conf.set("spark.tessera.vector_top_k", "5")
    monkeypatch.setenv("VECTOR_TOP_K", "6")
    settings.get_settings.cache_clear()
    s = settings.get_settings()
    assert (s.top_k_results, s.chunk_size, s.vector_top_k) == (3, 80, 6)
    for k in ("chunk_size", "vector_top_k"):
        spark.conf.unset(f"spark.tessera.{k}")
    settings.get_settings.cache_clear()


def test_cut_lines():
    assert logs.cut("a\n b", 10) == "a b" and logs.cut(None) == "" and logs.cut("x" * 130) == "x" * 119 + "…" and len(logs.cut("y" * 99, 80)) == 80


def test_log_lines():
    record = logging.LogRecord("n", logging.INFO, "f", 1, "hi %s", ("x",), None)
    record.extra_field = 3
    line = json.loads(logs.JsonLines().format(record))
    assert line["message"] == "hi x" and line["extra_field"] == 3 and datetime.fromisoformat(line["timestamp"])
