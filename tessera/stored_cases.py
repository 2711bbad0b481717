"""Operators that write and read tables, as queries over an index of generated code that is built once in a session, each with its SQL."""

from __future__ import annotations

import contextlib
import io
import json
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logs, store
from .__main__ import main
from .cases import _LETTERS, _answered, col, letters, stored_index, text
from .operators import cache as caching, ivf, search
from .operators import chunks, evals
from .plans import ask, evaluate, index, service
from .queries import _BM25, _TOKENS, _questions, query, table
from .sources import repos, tables
from .streaming import ingest


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file on whatever file system the path names."""
    fs, at = tables._fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(data))
    out.close()


def generated_files(spark: SparkSession, sf_dir: str, later: bool = False) -> DataFrame:
    """A Python file for each nation, regions as repositories. Later: the first region is gone, and every other file has one more function."""
    n = table(spark, sf_dir, "nation")
    k = col("n_nationkey")
    more = F.when(F.lit(later) & (F.col("n_nationkey") % 2 == 0), text("\n\ndef g", k, "(): pass\n")).otherwise(F.lit(""))
    code = F.concat(text('"""N."""\n\nclass K', k, ":\n    async def run(self): pass\n\n\n@app.get('/n/", k, "')\ndef f", k, "(): pass\n"), more)
    rows = n.where(F.col("n_regionkey") > 0 if later else F.lit(True)).select(F.concat(F.lit("r"), col("n_regionkey")).alias("repo_name"), text("src/m", k, ".py").alias("file_path"), F.encode(code, "utf-8").alias("content"))
    files = repos.file_rows(rows)
    return files.select("*", *[F.lit(None).cast("string").alias(c) for c in ("git_commit_sha", "git_last_modified_at", "git_last_modified_by")])


def code_index(spark: SparkSession, sf_dir: str) -> tuple[index.Index, list[index.IndexResult]]:
    """The index of the generated files, and what its two runs told."""

    def build(path):
        results = []
        for later in (False, True):
            job = service.start_index(spark, files=generated_files(spark, sf_dir, later), index_dir=path, embedder=letters, model_name="letters")
            done = service.wait(job)
            if done["status"] != "completed":
                raise RuntimeError(done.get("error", "the job did not end"))
            results.append(done["result"])
        put_file(spark, f"{path}/results.json", json.dumps([vars(r) for r in results]).encode())

    path = store.once(spark, "code", sf_dir, build)
    told = spark.read.text(f"{path}/results.json", wholetext=True).first()[0]
    return index.Index(spark, path), [index.IndexResult(**r) for r in json.loads(told)]


@query("""with a as (select count(*)::int as n, count(*) filter (n_regionkey = 0)::int as gone, count(*) filter (n_regionkey > 0 and n_nationkey % 2 = 0)::int as more, count(distinct n_regionkey)::int as r, count(*) filter (n_regionkey > 0)::int as left_over from nation)
select 1 as run, n as total_files, n as changed_files, 0 as removed_files, 2 * n as total_chunks, r + 5 * n as graph_nodes, 7 * n as graph_edges, 'no_fingerprint' as drift from a
union all select 2, left_over, more, gone, 2 * left_over + more, r + 5 * left_over + more, 7 * left_over + more, 'same' from a""")
def index_jobs(spark, sf_dir):
    """Totals of two indexing jobs: all files, and then only those that changed; repositories stay known, vanished files' nodes go."""
    rows = [(k, r.total_files, r.changed_files, r.removed_files, r.total_chunks, r.graph_nodes, r.graph_edges, r.drift) for k, r in enumerate(code_index(spark, sf_dir)[1], 1)]
    return spark.createDataFrame(rows, "run int, total_files int, changed_files int, removed_files int, total_chunks int, graph_nodes int, graph_edges int, drift string")


@query("""with k as (select n_nationkey as k, 'r' || n_regionkey as repo, 'src/m' || n_nationkey || '.py' as path, n_nationkey % 2 = 0 as more from nation where n_regionkey > 0)
select 'Repo' as type, 'r' || n_regionkey as label, 'r' || n_regionkey as repo_name, null as file_path from (select distinct n_regionkey from nation) union all select 'File', 'm' || k || '.py', repo, path from k union all select 'Class', 'K' || k, repo, path from k
union all select 'Function', 'K' || k || '.run', repo, path from k union all select 'Function', 'f' || k, repo, path from k union all select 'Function', 'g' || k, repo, path from k where more union all select 'APIEndpoint', 'GET /n/' || k, repo, path from k""")
def graph_nodes_shown(spark, sf_dir):
    """Every vertex of the stored graph with its label."""
    return service.viewer_nodes(code_index(spark, sf_dir)[0]).select("type", "label", "repo_name", "file_path")


@query("""with k as (select n_nationkey as k, n_nationkey % 2 = 0 as more from nation where n_regionkey > 0)
select type, count(*) as n from (select unnest(['BELONGS_TO_REPO', 'CONTAINS_CLASS', 'CONTAINS_FUNCTION', 'CONTAINS_FUNCTION', 'METHOD_OF', 'EXPOSES', 'HANDLES']) as type from k union all select 'CONTAINS_FUNCTION' from k where more) group by type""")
def graph_edges_stored(spark, sf_dir):
    return code_index(spark, sf_dir)[0].table("edges").groupBy("type").agg(F.count("*").alias("n"))


@query("""select 'total' as what, null as repo_name, 2 * count(*) + count(*) filter (n_nationkey % 2 = 0) as chunks, count(distinct n_regionkey) as repos, count(*) as files from nation where n_regionkey > 0
union all select 'repo', 'r' || n_regionkey, 2 * count(*) + count(*) filter (n_nationkey % 2 = 0), null, null from nation where n_regionkey > 0 group by n_regionkey""")
def service_stats(spark, sf_dir):
    totals, by = service.index_stats(code_index(spark, sf_dir)[0])
    one = totals.select(F.lit("total").alias("what"), F.lit(None).cast("string").alias("repo_name"), F.col("total_chunks").alias("chunks"), F.col("total_repos").alias("repos"), F.col("total_files").alias("files"))
    null = F.lit(None).cast("long")
    return one.unionByName(by.select(F.lit("repo").alias("what"), "repo_name", "chunks", null.alias("repos"), null.alias("files")))


@query("""select 'match' as what, 'Class K7' as value from nation where n_nationkey = 7 and n_regionkey > 0 union all select 'file', 'src/m7.py' from nation where n_nationkey = 7 and n_regionkey > 0
union all select 'summary', '* class `K7` (r' || n_regionkey || ': src/m7.py) with `run`' from nation where n_nationkey = 7 and n_regionkey > 0""")
def graph_traversal(spark, sf_dir):
    """One entity's matches, related files and summary, as the service gives them."""
    found = service.graph_traverse(code_index(spark, sf_dir)[0], "K7", 2)
    m = found["matches"].select(F.lit("match").alias("what"), F.concat_ws(" ", "kind", "name").alias("value"))
    f = found["related_files"].select(F.lit("file").alias("what"), F.col("file_path").alias("value"))
    return m.unionByName(f).unionByName(found["summary"].select(F.lit("summary").alias("what"), F.col("summary").alias("value")))


@query("""select 'nodes' as what, count(*) as n from (select type from (select 'Repo' as type from (select distinct n_regionkey from nation) union all select unnest(['File', 'Class', 'Function', 'Function', 'APIEndpoint']) from nation where n_regionkey > 0 union all select 'Function' from nation where n_regionkey > 0 and n_nationkey % 2 = 0) qualify row_number() over (partition by type) <= 4)
union all select 'checks', 1""")
def service_data(spark, sf_dir):
    """The viewer's data under a cap for each type, and that the service is ready."""
    at = code_index(spark, sf_dir)[0]
    nodes = service.graph_data(at, 4)["nodes"].agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n")
    ready = service.health()["status"] == "ok" and service.ready(at)["status"] == "ready" and service.ready(index.Index(spark, at.path + "/none"))["status"] == "not_ready"
    return nodes.unionByName(spark.createDataFrame([("checks", int(ready))], "what string, n long"))


@query("select n_nationkey::bigint as k, n_name as name from nation where n_regionkey > 1 union all select -1, 'empty'")
def published_versions(spark, sf_dir):
    """A table published three times: readers get the last one; one that is missing opens empty under its schema."""

    def build(path):
        for r in (-1, 0, 1):
            tables.publish(table(spark, sf_dir, "nation").where(F.col("n_regionkey") > r).select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")), path)

    path = store.once(spark, "versions", sf_dir, build)
    none = tables.open_table(spark, f"{path}/none", "k long, name string")
    return tables.open_table(spark, path).unionByName(none).unionByName(spark.createDataFrame([(-1, "empty")], "k long, name string").where(F.lit(none.isEmpty())))


@query("""select doc_id::varchar as question_id, case when doc_id % 2 = 0 then 1.0::double else 0.0::double end as file_recall, 4.0::double as faithfulness, 3.0::double as completeness, lang as tags from documents join labels using (doc_id)""")
def result_lines(spark, sf_dir):
    """Results of an evaluation written as JSON lines, twice, and read again."""

    def build(path):
        d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
        q = d.select(col("doc_id").alias("id"), F.lit("q").alias("question"), F.array(F.lit("a/x.py")).alias("expected_files"), F.array("lang").alias("tags"))
        a = d.select(col("doc_id").alias("question_id"), F.lit("a").alias("answer"), F.array(F.when(F.col("doc_id") % 2 == 0, "b/x.py").otherwise("y.py")).alias("relevant_files"))
        for _ in range(2):
            tables.write_results(evals.evaluate(q, a, lambda q, a: F.lit('{"faithfulness": 4}')), path)

    out = spark.read.schema(evals.RESULT).json(store.once(spark, "results", sf_dir, build))
    return out.select("question_id", "file_recall", "judge_scores.faithfulness", "judge_scores.completeness", F.array_join("tags", ",").alias("tags"))


@query("select 'INFO' as level, 'tessera.t' as logger, 'hello ' || n_name as message, 5 as k, true as timed from nation")
def log_lines(spark, sf_dir):
    """Log records as lines of JSON, read again."""
    form, lines = logs.JsonLines(), []
    for r in table(spark, sf_dir, "nation").select("n_name").collect():  # what a driver logs
        record = logging.LogRecord("tessera.t", logging.INFO, "f", 1, "hello %s", (r["n_name"],), None)
        record.k = 5
        lines.append((form.format(record),))
    j = F.from_json("value", "timestamp string, level string, logger string, message string, k int")
    return spark.createDataFrame(lines, "value string").select(j.alias("j")).select("j.level", "j.logger", "j.message", "j.k", F.col("j.timestamp").cast("timestamp").isNotNull().alias("timed"))


@query("""select * from (values ('shop', 'a.py', '.py', 'python', 6, 'x = 1' || chr(10)), ('shop', 'Dockerfile', '', 'text', 6, 'FROM x'), ('pay', 'src/c d+e.ts', '.ts', 'typescript', 7, 'let é;')) t(repo_name, file_path, file_type, language, size_bytes, content)""")
def repo_scan(spark, sf_dir):
    """A folder of repositories: other types, skipped folders, blank and too large files and loose ones go; bytes that aren't UTF-8 are dropped."""

    def build(path):
        files = {"shop/a.py": b"x = 1\n", "shop/node_modules/b.py": b"y", "shop/blank.py": b" \n", "shop/Dockerfile": b"FROM x", "shop/pic.png": b"png", "pay/src/c d+e.ts": "let é;".encode() + b"\xff", "pay/big.py": b"#" * 600_000, "top.py": b"z"}
        for name, data in files.items():
            put_file(spark, f"{path}/{name}", data)

    found = repos.load_repos(spark, store.once(spark, "repos", "", build))
    return found.select("repo_name", "file_path", "file_type", "language", F.col("size_bytes").cast("int").alias("size_bytes"), "content")


@query("""select sha256(source || '::doc/' || doc_id) as doc_id, 'doc/' || doc_id as file_path, source as repo_name, sha256(case when doc_id % 3 = 0 then 'new' else coalesce(text, '') end) as content_hash from documents""")
def registered_stream(spark, sf_dir):
    """A registry kept up by a stream: a file that comes again has its new hash."""

    def build(path):
        d = table(spark, sf_dir, "documents").select(F.col("source").alias("repo_name"), F.concat(F.lit("doc/"), "doc_id").alias("file_path"), F.col("text").alias("content"), "doc_id")
        for batch in (d, d.where("doc_id % 3 = 0").withColumn("content", F.lit("new"))):
            batch.drop("doc_id").write.mode("append").parquet(f"{path}/in")
            ingest.register_stream(spark.readStream.schema("repo_name string, file_path string, content string").parquet(f"{path}/in"), f"{path}/registry", f"{path}/checkpoint").awaitTermination()

    path = store.once(spark, "stream", sf_dir, build)
    return ingest.registered(spark, f"{path}/registry").select("doc_id", "file_path", "repo_name", "content_hash")


@query("""select sha256('r' || user_id % 3 || '::u/' || user_id) as doc_id, 'u/' || user_id as file_path, 'r' || user_id % 3 as repo_name, content_hash, strftime(ts, '%Y-%m-%d %H:%M:%S') as at
from (select *, row_number() over (partition by user_id order by ts desc, content_hash desc) as n from (select user_id, ts, sha256(event_id::varchar) as content_hash from events)) where n = 1""")
def stream_versions(spark, sf_dir):
    """Events as versions of their users' files, in batches that hold several versions of one file and come in no order of time: the latest of each stays."""

    def build(path):
        e = table(spark, sf_dir, "events").select(
            F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("repo_name"), F.concat(F.lit("u/"), col("user_id")).alias("file_path"), col("event_id").alias("content"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).alias("batch")
        )
        for batch in (1, 2, 0):  # the stream takes what was added since it last ran
            e.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{path}/in")
            files = spark.readStream.schema("repo_name string, file_path string, content string, ts timestamp").parquet(f"{path}/in")
            ingest.register_stream(files, f"{path}/registry", f"{path}/checkpoint").awaitTermination()

    path = store.once(spark, "stream versions", sf_dir, build)
    return ingest.registered(spark, f"{path}/registry").select("doc_id", "file_path", "repo_name", "content_hash", F.date_format("last_indexed_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


_EMBEDDED = _LETTERS.format("lower(coalesce(text, ''))")


@query(f"""with {_BM25.format(where='')}, e as (select doc_id, {_EMBEDDED} as v from documents), q as (select item_id, {_EMBEDDED} as v from benchmark),
en as (select *, sqrt(list_dot_product(v, v)) as n from e), qn as (select *, sqrt(list_dot_product(v, v)) as n from q),
p as (select item_id as query_id, doc_id as chunk_id, case when qn.n = 0 or en.n = 0 then 0.0 else list_dot_product(qn.v, en.v) / (qn.n * en.n) end as score from qn join en on true),
dn as (select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank, score from p),
keyed as (select l.*, sha256(coalesce(d.text, '')) as key from (select query_id, chunk_id, rank, 0 as list from dn where rank <= 20 and score >= 0.3 union all select query_id, chunk_id, rank, 1 as list from bm) l join documents d on d.doc_id = l.chunk_id),
fused as (select query_id, key, sum(1.0 / (60 + rank)) as score, max_by(chunk_id, list * 1000000 + rank) as chunk_id, min(list * 1000000 + rank) as f from keyed group by 1, 2),
top as (select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, f, key) as rank from fused qualify rank <= 5),
tq as (select item_id, list_distinct({_TOKENS.format('text')}) as q from benchmark),
s as (select top.*, coalesce(d.text, '') as text, case when len(q) = 0 then 0.0 else len(list_intersect(q, list_distinct({_TOKENS.format("left(coalesce(d.text, ''), 2000)")}))) / len(q) end as o from top join documents d on d.doc_id = chunk_id join tq on item_id = query_id),
r as (select *, row_number() over (partition by query_id order by o desc, rank) as place from s)
select query_id::varchar as query_id, sha256(left(string_agg(text, chr(10) || chr(10) order by place), 600)) as answer_sha256, string_agg('doc/' || chunk_id, ',' order by place) as relevant_files, count(*)::int as chunks, false as cache_hit from r group by query_id""")
def ask_answers(spark, sf_dir):
    """Benchmark questions answered from the stored index: retrieved, reranked, curated and put to the default model."""
    q = _questions(spark, sf_dir).select(col("query_id").alias("query_id"), "query")
    out = ask.run(stored_index(spark, sf_dir), q, top_k=5, use_graph=False, embedder=letters)
    return out.select("query_id", F.sha2("answer", 256).alias("answer_sha256"), F.array_join("relevant_files", ",").alias("relevant_files"), F.col("chunks").cast("int").alias("chunks"), "cache_hit")


@query("""select 'q' || doc_id as query, 2 as n, round(n_chars / 7, 2) as retrieval_ms from documents join labels using (doc_id) where toxic <> 1 and doc_id % 4 > 0""")
def trace_lines(spark, sf_dir):
    """Traces appended twice as JSON lines and read again."""

    def build(path):
        for _ in range(2):
            tables.append_traces(ask.traces(_answered(spark, sf_dir)), path)

    lines = spark.read.json(store.once(spark, "traces", sf_dir, build))
    return lines.groupBy("query").agg(F.count("*").cast("int").alias("n"), F.max("retrieval_ms").alias("retrieval_ms"))


@query("""select 'big' || n_nationkey || '.py' as file_path, k as chunk_index, k as sub_chunk, 'big' as symbol_name, case k when 0 then 1000 when 3 then 605 else 995 end as size from nation, (select unnest([0, 1, 2, 3]) as k)""")
def sub_chunks(spark, sf_dir):
    """A function of 301 lines of 10 characters: pieces of 100 lines, 20 of which come again; a piece's blank edge goes."""
    code = F.concat(F.lit("def big():"), F.repeat(F.lit("\n    x = 1"), 300), F.lit("\n"))
    f = table(spark, sf_dir, "nation").select(F.lit("r").alias("repo_name"), text("big", col("n_nationkey"), ".py").alias("file_path"), F.lit(".py").alias("file_type"), code.alias("content"))
    return chunks.split_documents(f).select("file_path", "chunk_index", "sub_chunk", "symbol_name", F.length("content").alias("size"))


@query("""select n_nationkey, case when length(repeat(n_name || ' x ', 12)) - 1 <= 80 then left(repeat(n_name || ' x ', 12), length(repeat(n_name || ' x ', 12)) - 1) else left(repeat(n_name || ' x ', 12), 79) || '…' end as line from nation""")
def cut_lines(spark, sf_dir):
    """Texts as a log shows them: one line of 80 characters."""
    rows = [(r["n_nationkey"], logs.cut(f"{r['n_name']}\n x " * 12, 80)) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]  # a driver's log
    return spark.createDataFrame(rows, "n_nationkey int, line string")


@query("select 'deleted' as what, 40 as n union all select 'left', 0")
def cache_emptied(spark, sf_dir):
    """A stored cache is emptied, and how many entries went is told."""
    at = index.Index(spark, f"{store.folder(spark)}/emptied-{uuid.uuid4().hex}")
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("q"), col("vec_id")).alias("query"), "embedding", F.timestamp_seconds("vec_id").alias("created_at"))
    at.put_cache(caching.store(at.table("cache"), e, 40))
    return spark.createDataFrame([("deleted", service.invalidate_cache(at)), ("left", at.table("cache").count())], "what string, n int")


@query("""select count(*) as total, count(*) as successful, 0 as failed, 4.0::double as mean_faithfulness, 3.0::double as mean_relevance, 1.0::double as mean_file_recall, 0.0::double as cache_hit_rate from benchmark""")
def evaluation_run(spark, sf_dir):
    """Benchmark questions answered and judged in one run; none expects files."""

    def build(path):
        q = _questions(spark, sf_dir).select(col("query_id").alias("id"), F.col("query").alias("question"), F.array().cast("array<string>").alias("expected_files"), F.array().cast("array<string>").alias("tags"))
        evaluate.run(stored_index(spark, sf_dir), q, path, lambda question, answer: F.lit('{"faithfulness": 4}'), top_k=5, use_graph=False, embedder=letters)

    results = spark.read.schema(evals.RESULT).json(store.once(spark, "evaluation", sf_dir, build))
    return evals.summary(results).select("total", "successful", F.col("failed").cast("int").alias("failed"), "mean_faithfulness", "mean_relevance", "mean_file_recall", "cache_hit_rate")


@query("""select 'missing' as what, '1' as said union all select 'graph-stats', '0' union all select 'ask', '- src/m' || max(n_nationkey) || '.py' from nation where n_regionkey > 0""")
def command_line(spark, sf_dir):
    """The command line: without an index, the graph's statistics, and a question's last line."""
    path, out = code_index(spark, sf_dir)[0].path, io.StringIO()
    last = table(spark, sf_dir, "nation").where("n_regionkey > 0").agg(F.max("n_nationkey")).first()[0]
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
        missing, stats = main(["--index-dir", f"{path}/none", "stats"]), main(["--index-dir", path, "graph-stats"])
        main(["--index-dir", path, "ask", f"Where is K{last}?"])
    said = out.getvalue().rstrip("\n").split("\n")[-1]
    return spark.createDataFrame([("missing", str(missing)), ("graph-stats", str(stats)), ("ask", said)], "what string, said string")


@query("""select 20 as k, count(*) as asked, count(*) as full_lists, true as recall_reached, true as scores_exact, true as cells_left_out from embeddings where vec_id % 100 = 0""")
def vector_ann(spark, sf_dir):
    """Nearest vectors from an inverted file, for every hundredth vector against all, measured against exact search: recall of 0.9 or more. These vectors are nearly random, so it takes four fifths of the cells."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = ivf.load(spark, store.once(spark, "ivf", sf_dir, lambda path: ivf.build(e, path)))
    probes, asked = max(1, round(0.8 * len(found.centres))), e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    near = ivf.search(found, asked, 20, probes)
    exact = search.vector_search(e, asked, 20, -1.0, id_col="vec_id").withColumnsRenamed({"chunk_id": "id", "score": "exact"}).drop("rank")
    both = near.join(exact, ["query_id", "id"], "full_outer")
    each = both.groupBy("query_id").agg(F.count("score").alias("n"), F.count(F.col("score") + F.col("exact")).alias("hit"), F.max(F.abs(F.col("score") - F.col("exact"))).alias("off"))
    told = each.agg(F.count("*").alias("asked"), F.count_if(F.col("n") == 20).alias("full_lists"), (F.sum("hit") / F.sum(F.lit(20)) >= 0.9).alias("recall_reached"), (F.max("off") < 1e-9).alias("scores_exact"))
    return told.select(F.lit(20).alias("k"), "*", F.lit(probes < len(found.centres)).alias("cells_left_out"))
