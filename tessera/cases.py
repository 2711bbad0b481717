"""More of the engine's operators as queries, over files, graphs and answers made from the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .functions import ids
from .functions.calls import call_links
from .functions.text import basename, code_tokens, judge_mean, parent, suffix, text_entities
from .operators import cache, chunks, delta, evals, graph, linker, search, symbols, traverse, viewer
from .plans import ask, service
from .plans.index import CHUNKS, Index, columns, put_bm25
from .queries import _BM25, _GRAPH, _edges, _nodes, _questions, _registry, document_chunks, layered, query, table
from .sources import repos, tables
from .sources.layers import Layout


def text(*parts):
    """Columns and literal strings joined."""
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def col(name: str):
    return F.col(name).cast("string")


#: Rows of a table, about, from which one task makes and reads files.
ROWS_A_TASK = 5000


def dealt(rows: DataFrame) -> DataFrame:
    """A table in as many tasks as the files that are made from its rows take: its own few bytes would be read by one."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK)))


# --- text functions --------------------------------------------------------------------


@query(r"""with t as (select item_id, regexp_replace(text, '[^ -~]', '', 'g') || ' calls get_user_' || item_id || ' of UserService' || item_id || ' at /api/v' || item_id || '/x-y' as t from benchmark),
e as (select item_id, list_sort(list_distinct(regexp_extract_all(t, '\b([A-Z][a-zA-Z0-9]{2,})\b', 1) || list_filter(regexp_extract_all(t, '\b([a-z][a-z0-9_]{3,})\b', 1), lambda x: contains(x, '_')) || regexp_extract_all(t, '(/[a-zA-Z0-9_/-]+)', 1))) as e from t)
select item_id, len(e) as n, array_to_string(e, ' ') as entities from e""")
def text_entity_lists(spark, sf_dir):
    """Names by their shape: CamelCase, snake_case and paths."""
    t = text(F.regexp_replace("text", "[^ -~]", ""), " calls get_user_", col("item_id"), " of UserService", col("item_id"), " at /api/v", col("item_id"), "/x-y")
    e = table(spark, sf_dir, "benchmark").select("item_id", text_entities(t).alias("e"))
    return e.select("item_id", F.size("e").cast("long").alias("n"), F.array_join("e", " ").alias("entities"))


_PATH = "case page_id % 5 when 0 then 'a/b' || page_id || '.Py' when 1 then 'Dockerfile' when 2 then 'x/.env' when 3 then 'x/y.tar.GZ' else 'x/y/z' end"


@query(rf"""with p as (select page_id, {_PATH} as p from pages), b as (select *, string_split(p, '/')[-1] as b from p)
select page_id, b as basename, lower(regexp_extract(b, '[^.](\.[^.]+)$', 1)) as suffix, regexp_extract(p, '^(.*)/[^/]*$', 1) as parent from b""")
def path_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("p"))
    return p.select("page_id", basename("p").alias("basename"), suffix("p").alias("suffix"), parent("p").alias("parent"))


@query("""select p_partkey, case p_partkey % 7 when 0 then 'http://h/api/' || p_partkey || '?q=1' when 1 then 'http://h/b/' || p_partkey when 2 then '/v' || p_partkey || '/items' when 3 then '/f/' || p_partkey || ' /v2/' || p_partkey else '' end as urls,
case when p_partkey % 7 = 4 then 'topic.' || p_partkey else '' end as produced, case when p_partkey % 7 = 4 then 'in-' || p_partkey else '' end as consumed from part""")
def call_sites(spark, sf_dir):
    """URLs and topics of calls in several clients' ways; too short ones, other callers and other functions name none."""
    k = col("p_partkey")
    code = (
        F.when(F.col("p_partkey") % 7 == 0, text('x = requests.get("http://h/api/', k, '?q=1", timeout=3)'))
        .when(F.col("p_partkey") % 7 == 1, text("await httpx . POST(  f'http://h/b/", k, "' )"))
        .when(F.col("p_partkey") % 7 == 2, text("axios.put('/v", k, "/items', data); axios.put('/v", k, "/items')"))
        .when(F.col("p_partkey") % 7 == 3, text('prefetch("/no/', k, '"); axios.get("/f/', k, '"); fetch(`/v2/', k, '`); requests.get("abc")'))
        .when(F.col("p_partkey") % 7 == 4, text('p.produce( "topic.', k, "\", v); c.subscribe([ 'in-", k, "', 'other'])"))
        .otherwise(text('requests.head("http://h/', k, '"); called("http://h/", ', k, '); c.subscribe("in")'))
    )
    found = dealt(table(spark, sf_dir, "part")).select("p_partkey", code.alias("c"), F.lit(".py").alias("t")).select("p_partkey", call_links("c", "t").alias("l"))
    of = lambda kind: F.array_join(F.transform(F.filter("l", lambda x: x["kind"] == kind), lambda x: x["value"]), " ")
    return found.select("p_partkey", of("http").alias("urls"), of("made").alias("produced"), of("used").alias("consumed"))


@query("select o_orderkey, (o_orderkey % 5 + o_orderkey % 3 + 1) / 3.0::double as mean from orders")
def judge_means(spark, sf_dir):
    key = F.col("o_orderkey")
    scores = F.struct((key % 5).cast("double").alias("faithfulness"), (key % 3).cast("double").alias("completeness"), F.lit(1.0).alias("relevance"))
    return table(spark, sf_dir, "orders").select("o_orderkey", judge_mean(scores).alias("mean"))


# --- sources and sinks -----------------------------------------------------------------

_FILE = "case page_id % 8 when 0 then 'src/a' || page_id || '.py' when 1 then 'web/node_modules/x' || page_id || '.js' when 2 then 'lib/b.TS' when 3 then 'c.bin' when 4 then 'd/Dockerfile' when 5 then 'd/blank.md' when 6 then 'build/x.py' else 'notes/build' || page_id || '.rst' end"


@query(f"""with p as (select page_id, {_FILE} as file_path, case page_id % 8 when 5 then ' ' || chr(10) else html || case when page_id % 8 = 0 then chr(65533) || 'x' else '' end end as content from pages),
k as (select *, string_split(file_path, '/')[-1] as file_name from p where page_id % 8 in (0, 2, 4, 7) and regexp_matches(content, '[^ \\t\\n\\r\\f]'))
select page_id::varchar as repo_name, file_path, file_name, case page_id % 8 when 0 then '.py' when 2 then '.ts' when 4 then '' else '.rst' end as file_type, case page_id % 8 when 0 then 'python' when 2 then 'typescript' else 'text' end as language,
sha256(content) as content_hash, octet_length(encode(content)) as size_bytes from k""")
def repo_files(spark, sf_dir):
    """Pages as files: other types, skipped directories and blank files go, bytes that aren't UTF-8 too, replacement characters stay."""
    p = table(spark, sf_dir, "pages")
    odd = F.concat(F.unhex(F.lit("FF")), F.encode(F.lit("�x"), "utf-8"), F.unhex(F.lit("C3")))
    html = F.encode("html", "utf-8")
    content = F.when(F.col("page_id") % 8 == 5, F.encode(F.lit(" \n"), "utf-8")).when(F.col("page_id") % 8 == 0, F.concat(html, odd)).otherwise(html)
    rows = p.select(col("page_id").alias("repo_name"), F.expr(_FILE).alias("file_path"), content.alias("content"))
    return repos.file_rows(rows).drop("content")


@query("""select item_id::varchar as id, 'why ' || item_id as question, case when item_id % 2 = 0 then 'hard' else 'medium' end as difficulty, case when item_id % 2 = 0 then 2 else 0 end as n_files, '' as notes from benchmark where item_id % 5 not in (3, 4)""")
def question_rows(spark, sf_dir):
    """Evaluation questions of JSON lines; blank lines and comments are none."""
    k = col("item_id")
    full = text('{"id": "', k, '", "question": "why ', k, '", "difficulty": "hard", "expected_files": ["a", "b"]}')
    short = text('{"question": "why ', k, '", "id": "', k, '"}')
    line = F.when(F.col("item_id") % 5 == 3, "  ").when(F.col("item_id") % 5 == 4, "# note").when(F.col("item_id") % 2 == 0, full).otherwise(short)
    q = tables.parse_questions(table(spark, sf_dir, "benchmark").select(line.alias("value")))
    return q.select("id", "question", "difficulty", F.size("expected_files").alias("n_files"), "notes")


def _answered(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(
        F.concat(F.lit("q"), col("doc_id")).alias("query"), (F.col("toxic") == 1).alias("cache_hit"), (F.col("doc_id") % 4).cast("int").alias("chunks"), F.array(F.col("source")).alias("query_entities"), F.array(F.col("lang"), F.col("source")).alias("relevant_files"),
        F.lit(20).alias("vector_count"), (F.col("doc_id") % 7).cast("int").alias("bm25_count"), F.lit(None).cast("int").alias("graph_count"), (F.col("n_chars") / 7).alias("retrieval_ms"), F.lit(0.126).alias("llm_ms"), F.col("n_chars").cast("int").alias("input_tokens"), F.lit(3).alias("output_tokens"),
    )


@query("""select 'q' || doc_id as query, 'r' as repo_name, 20 as vector_count, (doc_id % 7)::int as bm25_count, 0 as graph_count, (doc_id % 4)::int as total_fused_chunks, source as graph_entities, lang || ',' || source as relevant_files,
round(n_chars / 7, 2) as retrieval_ms, 0.13::double as llm_ms, n_chars::int as input_tokens, 3 as output_tokens, 36 as id_length, 20 as time_length from documents join labels using (doc_id) where toxic <> 1 and doc_id % 4 > 0""")
def trace_rows(spark, sf_dir):
    """What is traced of answers: no cache hits, no empty results, times in hundredths, an id and a time for each."""
    t = ask.traces(_answered(spark, sf_dir), "r").withColumns({"id_length": F.length("query_id"), "time_length": F.length("timestamp"), "graph_entities": F.array_join("graph_entities", ","), "relevant_files": F.array_join("relevant_files", ",")})
    return t.drop("query_id", "timestamp")


@query("""select doc_id::varchar as question_id, 'q' || doc_id as question, (case when doc_id % 2 = 0 then 0.5 else 1.0 end)::double as file_recall, (case when doc_id % 7 = 0 then null else 4.0 end)::double as faithfulness, (case when doc_id % 7 = 0 then null else 3.0 end)::double as relevance,
case when doc_id % 7 = 0 then 'boom' end as error, toxic = 1 as cache_hit, lang as tags from documents join labels using (doc_id)""")
def eval_results(spark, sf_dir):
    """Results of questions and answers under a judge; failed ones aren't judged."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    expected = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a/x.py"), F.lit("b/y.py"))).otherwise(F.array().cast("array<string>"))
    q = d.select(col("doc_id").alias("id"), F.concat(F.lit("q"), col("doc_id")).alias("question"), expected.alias("expected_files"), F.array("lang").alias("tags"))
    a = d.select(col("doc_id").alias("question_id"), F.lit("the answer").alias("answer"), F.array(F.lit("c/x.py")).alias("relevant_files"), (F.col("toxic") == 1).alias("cache_hit"), F.when(F.col("doc_id") % 7 == 0, "boom").alias("error"))
    out = evals.evaluate(q, a, lambda question, answer: F.lit('{"faithfulness": 4, "completeness": 2}'))
    return out.select("question_id", "question", "file_recall", "judge_scores.faithfulness", "judge_scores.relevance", "error", "cache_hit", F.array_join("tags", ",").alias("tags"))


# --- chunks and symbols ----------------------------------------------------------------


@query("""select 'doc/' || doc_id as file_path, true as in_size, true as in_place, true as in_order, length(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b\\x1c-\\x1f\\x85\\xa0\\u3000]', '', 'g')) as covered from documents where regexp_matches(text, '[^ \\t\\n\\r\\f]')""".replace("\\u3000", "　"))
def char_chunks(spark, sf_dir):
    """Documents split by size: every piece has 1,000 characters at most, stands where it says, begins after the one before, and all that isn't blank is covered."""
    f = document_chunks(spark, sf_dir).drop("chunk_id", "chunk_index").withColumn("file_type", F.lit(".txt"))
    c = chunks.split_documents(f.withColumn("whole", F.col("content")))
    here = F.substring("whole", (F.col("start_index") + 1).cast("int"), F.length("content").cast("int")) == F.col("content")
    w = Window.partitionBy("file_path").orderBy("chunk_index")
    last, end = F.lag("start_index").over(w), F.col("start_index") + F.length("content")
    before = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.expr("substring(content, cast(greatest(before - start_index, 0) + 1 as int))")
    c = c.withColumns({"before": before, "sorted": F.coalesce(F.col("start_index") > last, F.lit(True))})
    solid = F.length(F.regexp_replace(fresh, "[ \\t\\n\\r\\f\\x0b\\x1c-\\x1f\\x85\\xa0\\u3000]", ""))
    return c.groupBy("file_path").agg(F.bool_and(F.length("content") <= 1000).alias("in_size"), F.bool_and(here).alias("in_place"), F.bool_and("sorted").alias("in_order"), F.sum(solid).alias("covered"))


_UNITS = "select n_nationkey, 40 + n_nationkey * 10 as n from nation"


@query(f"""with u as ({_UNITS}), c as (select n_nationkey, n, unnest(range(0, 1 + greatest(0, ceil((n - 20) / 16.0)::bigint - 0))) as k from u)
select 'f' || n_nationkey as file_path, k::int as chunk_index, (k * 16 * 50)::int as start_index, (least(n - k * 16, 20) * 50 - 1)::int as size from c where n - k * 16 > 0 and (k = 0 or n - k * 16 > 4)""")
def size_chunks(spark, sf_dir):
    """Lines of 49 characters: 20 fit in a piece of 1,000, and 4 of them (200) are repeated in the next."""
    n = table(spark, sf_dir, "nation")
    line = F.repeat(F.lit("x"), 49)
    content = F.array_join(F.array_repeat(line, (F.lit(40) + F.col("n_nationkey") * 10).cast("int")), "\n")
    f = n.select(F.lit("r").alias("repo_name"), F.concat(F.lit("f"), col("n_nationkey")).alias("file_path"), F.lit(".txt").alias("file_type"), content.alias("content"))
    return chunks.split_documents(f).select("file_path", "chunk_index", "start_index", F.length("content").alias("size"))


@query("""with k as (select s_suppkey as k from supplier)
select 'f' || k || '.py' as file_path, 0 as chunk_index, 'f' || k as symbol_name, 'function' as symbol_type, 4 as start_line, 5 as end_line, '@deco' || chr(10) || 'def f' || k || '(): pass' as content from k
union all select 'f' || k || '.py', 1, 'C' || k, 'class', 7, 8, 'class C' || k || ':' || chr(10) || '    x = 1' from k
union all select 'm' || k || '.md', 0, null, null, null, null, '# title ' || k from k
union all select 'i' || k || '.py', 0, null, null, null, null, 'import os' from k
union all select 's' || k || '.js', 0, 'K' || k, 'class', 2, 2, 'class K' || k || ' { a() { return /[{]/; } }' from k""")
def symbol_chunks(spark, sf_dir):
    """Files split at symbols where the language is known and has some; blank and unsupported ones by size."""
    k = col("s_suppkey")
    files = F.array(
        F.struct(text("f", k, ".py").alias("file_path"), F.lit(".py").alias("file_type"), text("import os\n\n\n@deco\ndef f", k, "(): pass\n\nclass C", k, ":\n    x = 1\n").alias("content")),
        F.struct(text("m", k, ".md").alias("file_path"), F.lit(".md").alias("file_type"), text("\n# title ", k, "\n").alias("content")),
        F.struct(text("i", k, ".py").alias("file_path"), F.lit(".py").alias("file_type"), F.lit("import os\n").alias("content")),
        F.struct(text("b", k, ".py").alias("file_path"), F.lit(".py").alias("file_type"), F.lit(" \n").alias("content")),
        F.struct(text("s", k, ".js").alias("file_path"), F.lit(".js").alias("file_type"), text("// c\nclass K", k, " { a() { return /[{]/; } }\n").alias("content")),
    )
    f = dealt(table(spark, sf_dir, "supplier")).select(F.lit("r").alias("repo_name"), F.explode(files).alias("f")).select("repo_name", "f.*")
    return chunks.split_documents(f).select("file_path", "chunk_index", "symbol_name", "symbol_type", F.col("start_line"), "end_line", "content")


def _rows_sql(of: str, key: str, rows: list[tuple]) -> str:
    """SQL of the records of each file: expressions of k, nulls where a record has no such field."""
    names = ["kind", "name", "qualified_name", "start_line", "end_line", "is_async", "is_method", "docstring", "parent", "http_method", "path", "framework", "handler", "module", "symbols"]
    kinds = dict.fromkeys(names, "varchar") | {"start_line": "int", "end_line": "int", "is_async": "boolean", "is_method": "boolean"}
    each = []
    for seq, (kind, given) in enumerate(rows):
        cells = [f"'{kind}' as kind"] + [f"({given.get(n, 'null')})::{kinds[n]} as {n}" for n in names[1:]]
        each.append(f"select file_path, {seq} as seq, {', '.join(cells)} from k")
    return f"with k as (select {key} as k, {of}) " + " union all ".join(each)


_FIELDS = ("file_path", "seq", "kind", "name", "qualified_name", "start_line", "end_line", "is_async", "is_method", "docstring", "parent", "http_method", "path", "framework", "handler", "module")

_PY_RECORDS = [
    ("import", {"module": "'os'", "symbols": "''", "start_line": "1"}),
    ("import", {"module": "'.mod' || k", "symbols": "'thing,other'", "start_line": "2"}),
    ("class", {"name": "'C' || k", "qualified_name": "'C' || k", "start_line": "3", "end_line": "6", "docstring": "left('Doc ' || k || repeat('y', 450), 400)"}),
    ("inherits", {"name": "'C' || k", "parent": "'Base'"}),
    ("inherits", {"name": "'C' || k", "parent": "'Mix'"}),
    ("function", {"name": "'run'", "qualified_name": "'C' || k || '.run'", "start_line": "5", "end_line": "6", "is_async": "true", "is_method": "true", "docstring": "''", "parent": "'C' || k"}),
    ("function", {"name": "'f' || k", "qualified_name": "'f' || k", "start_line": "7", "end_line": "9", "is_async": "false", "is_method": "false", "docstring": "''"}),
    ("endpoint", {"name": "'/s/' || k", "path": "'/s/' || k", "http_method": "'GET'", "framework": "'fastapi'", "handler": "'f' || k", "start_line": "7"}),
    ("function", {"name": "'g' || k", "qualified_name": "'g' || k", "start_line": "10", "end_line": "11", "is_async": "true", "is_method": "false", "docstring": "''"}),
    ("endpoint", {"name": "'/r/' || k", "path": "'/r/' || k", "http_method": "'POST,PUT'", "framework": "'flask'", "handler": "'g' || k", "start_line": "10"}),
    ("function", {"name": "'h'", "qualified_name": "'h'", "start_line": "12", "end_line": "13", "is_async": "false", "is_method": "false", "docstring": "''"}),
    ("endpoint", {"name": "'/plain'", "path": "'/plain'", "http_method": "'GET'", "framework": "'flask'", "handler": "'h'", "start_line": "12"}),
]


def _records(files: DataFrame) -> DataFrame:
    return symbols.extract_symbols(files).select(*_FIELDS, F.array_join("symbols", ",").alias("symbols"))


@query(_rows_sql("'f' || s_suppkey || '.py' as file_path from supplier", "s_suppkey", _PY_RECORDS))
def python_records(spark, sf_dir):
    """Classes with bases and docstrings, methods, functions, routes of two frameworks and imports; a broken file beside each gives nothing."""
    k = col("s_suppkey")
    code = text("import os\nfrom .mod", k, " import thing, other as o\nclass C", k, '(Base, pkg.Mix):\n    """  Doc ', k, F.repeat(F.lit("y"), 450), '  """\n    async def run(self):\n        pass\n@app.get("/s/', k, '")\ndef f', k, '():\n    def inner(): pass\n@app.route("/r/', k, '", methods=["post", "PUT"])\nasync def g', k, "(): pass\n@app.route('/plain')\ndef h(): return 1\n")
    both = F.array(F.struct(text("f", k, ".py").alias("file_path"), code.alias("content")), F.struct(text("bad", k, ".py").alias("file_path"), F.lit("def f(:").alias("content")), F.struct(text("none", k, ".py").alias("file_path"), F.lit("").alias("content")))
    f = dealt(table(spark, sf_dir, "supplier")).select(F.lit("r").alias("repo_name"), F.lit(".py").alias("file_type"), F.explode(both).alias("f")).select("repo_name", "file_type", "f.*")
    return _records(f)


_JS_RECORDS = [
    ("import", {"module": "'./m' || k", "symbols": "'D,a,c'", "start_line": "1"}),
    ("import", {"module": "'./side.css'", "symbols": "''", "start_line": "2"}),
    ("class", {"name": "'K' || k", "qualified_name": "'K' || k", "start_line": "4", "end_line": "7", "docstring": "''"}),
    ("inherits", {"name": "'K' || k", "parent": "'Base'"}),
    ("function", {"name": "'x'", "qualified_name": "'K' || k || '.x'", "start_line": "5", "end_line": "5", "is_async": "false", "is_method": "true", "docstring": "''", "parent": "'K' || k"}),
    ("function", {"name": "'load'", "qualified_name": "'K' || k || '.load'", "start_line": "6", "end_line": "6", "is_async": "true", "is_method": "true", "docstring": "''", "parent": "'K' || k"}),
    ("function", {"name": "'f' || k", "qualified_name": "'f' || k", "start_line": "8", "end_line": "8", "is_async": "false", "is_method": "false", "docstring": "''"}),
    ("function", {"name": "'g' || k", "qualified_name": "'g' || k", "start_line": "9", "end_line": "9", "is_async": "true", "is_method": "false", "docstring": "''"}),
    ("endpoint", {"name": "'/n/' || k", "path": "'/n/' || k", "http_method": "'GET'", "framework": "'express'", "handler": "'f' || k", "start_line": "10"}),
    ("endpoint", {"name": "'mid' || k", "path": "'mid' || k", "http_method": "'ALL'", "framework": "'express'", "handler": "'g' || k", "start_line": "11"}),
]


@query(_rows_sql("'f' || n_nationkey || '.ts' as file_path from nation", "n_nationkey", _JS_RECORDS))
def script_records(spark, sf_dir):
    """Classes with members, functions, arrows, routes and imports; quotes in regular expressions, strings and comments mislead nobody."""
    k = col("n_nationkey")
    code = text(
        "import D, { a as b, c } from './m", k, "';\nimport \"./side.css\";\nconst parts = s.split(/['\"`]/).map(x => x / 2);\nexport class K", k, " extends ns.Base {\n  x = 1;\n  async load(id) { return `}`; }\n}\nexport function f", k,
        "(a) { return /[/`]{2}/.test(a) ? 1 : 2; }\nconst g", k, " = async (x) => x;\nrouter.get('/n/", k, "', auth, f", k, ");\napp.use(\"mid", k, "\", g", k, ");\n// class No {}\nconst t = 'function no() {}';\n",
    )
    f = table(spark, sf_dir, "nation").select(F.lit("r").alias("repo_name"), text("f", k, ".ts").alias("file_path"), F.lit(".ts").alias("file_type"), code.alias("content"))
    return _records(f)


#: What stands before the class in files of many shapes: code that a scanner without a grammar loses its way in.
_BEFORE = (
    "const a = `x ${b ? `{` : ''} y`;",
    "if (x) /[`{]/.test(y);",
    "export default class extends B {}",
    "type T<U> = U extends { x: infer V } ? V[] : () => void",
    "label: while (n--) { class No {} }",
    "const half = (a + b) / 2, view = o[1] / 3 // it's {",
    "interface I { m(): void; n: { o: '}' } }",
)
_HEADS = ("", "<T extends {x: number}> extends B1<T>", " extends ns.B2 implements I<{a: 1}>")


@query("""with k as (select p_partkey as k, p_partkey % 4 as n, p_partkey % 3 as h, 'f' || p_partkey || '.ts' as file_path from part),
r as (select file_path, 0 as place, 'class' as kind, 'K' || k as name, null as parent, 2 as start_line, 3 + n as end_line, null as is_async from k
union all select file_path, 1, 'inherits', 'K' || k, 'B' || h, null, null, null from k where h > 0
union all select file_path, 2 + i, 'function', 'm' || i, 'K' || k, 3 + i, 3 + i, i % 2 = 1 from k, unnest(range(n)) t(i)
union all select file_path, 9, 'function', 'f' || k, null, 4 + n, 4 + n, k % 2 = 1 from k
union all select file_path, 10, 'endpoint', '/p/' || k, 'f' || k, 5 + n, null, null from k where k % 5 = 0)
select file_path, (row_number() over (partition by file_path order by place) - 1)::int as seq, kind, name, parent, start_line::int as start_line, end_line::int as end_line, is_async from r""")
def script_shapes(spark, sf_dir):
    """Scripts whose parts follow from their keys: what stands before, the class's head, how many members, arrows and routes."""
    k, key = col("p_partkey"), F.col("p_partkey")
    pick = lambda some: F.element_at(F.array(*map(F.lit, some)), (key % len(some) + 1).cast("int"))
    member = lambda i: F.concat(F.when(i % 2 == 1, "  private async m").otherwise("  m"), i.cast("string"), F.lit("<A>(a = {b: ')'}, {c}: {c: A}): Promise<{d: A}> { return `}${a}`; }\n"))
    members = F.array_join(F.transform(F.when(key % 4 > 0, F.sequence(F.lit(0), (key % 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>")), member), "")
    arrow = text("const f", k, F.when(key % 2 == 1, " = async ({a}, b = (1)) => {}\n").otherwise(": (x: string) => {y: 1} = <T>(x: T[]): x is [T] => ({y: 1});\n"))
    code = text(pick(_BEFORE), "\nexport class K", k, pick(_HEADS), " {\n", members, "}\n", arrow, F.when(key % 5 == 0, text("app.get('/p/", k, "', auth(), f", k, ")\n")).otherwise("go(function no() {})\n"))
    f = dealt(table(spark, sf_dir, "part")).select(F.lit("r").alias("repo_name"), text("f", k, ".ts").alias("file_path"), F.lit(".ts").alias("file_type"), code.alias("content"))
    return symbols.extract_symbols(f).select("file_path", "seq", "kind", "name", F.coalesce("parent", "handler").alias("parent"), "start_line", "end_line", "is_async")


# --- the graph -------------------------------------------------------------------------


@query("""with n as (select 'r' || n_regionkey as repo, 'pkg/m' || n_nationkey || '.py' as path, n_nationkey as k from nation)
select 'IMPORT_DEP' as type, sha256(a.repo || '::' || a.path) as src, sha256(b.repo || '::' || b.path) as dst, 'x' as symbols, 1 as line from n a join n b on b.k = (a.k + 5) % 25 and a.repo = b.repo and a.k <> b.k
union all select 'IMPORT_DEP', sha256(a.repo || '::' || a.path), sha256(a.repo || '::lib/util.py'), 'y', 3 from n a""")
def import_edges(spark, sf_dir):
    """Relative, dotted and own imports between generated files: the first file that fits in the same repository, no loops, no strangers."""
    n = table(spark, sf_dir, "nation")
    k, repo = col("n_nationkey"), F.concat(F.lit("r"), col("n_regionkey"))
    code = text("from .m", col("next"), " import x\nimport m", k, "\nfrom lib.util import y\nimport os\n")
    own = n.withColumn("next", (F.col("n_nationkey") + 5) % 25).select(repo.alias("repo_name"), text("pkg/m", k, ".py").alias("file_path"), code.alias("content"))
    more = n.select(repo.alias("repo_name"), F.explode(F.array(F.lit("lib/util.py"), F.lit("lib/videos.py"))).alias("file_path"), F.lit("z = 1\n").alias("content")).distinct()
    f = own.unionByName(more).withColumn("file_type", F.lit(".py"))
    files = f.select(ids.file_id("repo_name", "file_path").alias("file_id"), "repo_name", "file_path")
    return graph.import_edges(symbols.extract_symbols(f), files).select("type", "src", "dst", F.array_join("symbols", ",").alias("symbols"), "line")


def _classes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), col("s_nationkey")).alias("repo_name"), F.concat(F.lit("f"), col("s_suppkey"), F.lit(".py")).alias("file_path"), F.concat(F.lit("K"), (F.col("s_suppkey") % 3).cast("string")).alias("name"), F.concat(F.lit("K"), ((F.col("s_suppkey") + 1) % 4).cast("string")).alias("parent"))
    return s.withColumn("class_id", ids.class_id("repo_name", "file_path", "name"))


@query("""with c as (select 'r' || s_nationkey as repo, 'f' || s_suppkey || '.py' as path, 'K' || (s_suppkey % 3) as name, 'K' || ((s_suppkey + 1) % 4) as parent from supplier),
i as (select *, sha256(repo || '::' || path || '::class::' || name) as id from c)
select 'INHERITS' as type, i.id as src, coalesce(min(p.id) filter (p.path = i.path), min(p.id)) as dst from i join i p on p.repo = i.repo and p.name = i.parent group by i.id""")
def inherits_edges(spark, sf_dir):
    """Parents by name: a class of the same file, else the first in the repository; unknown names give nothing."""
    c = _classes(spark, sf_dir)
    return graph.inherits_edges(c.withColumn("kind", F.lit("inherits")), c).select("type", "src", "dst")


@query("""with o as (select * from supplier where s_suppkey % 3 <> 0), n as (select * from supplier where s_suppkey % 2 = 0)
select 'i' || coalesce(o.s_suppkey, n.s_suppkey) as function_id, case when o.s_suppkey is null then 'new' else 'old' end as name, case when n.s_suppkey is null then 1 else 9 end as start_line, n.s_suppkey is not null as is_async from o full join n using (s_suppkey)""")
def node_upserts(spark, sf_dir):
    """Functions by key: new ones come, known ones get new lines and flags and keep their names."""

    def rows(condition, name, line, flag):
        s = table(spark, sf_dir, "supplier").where(condition)
        given = {"function_id": F.concat(F.lit("i"), col("s_suppkey")), "name": F.lit(name), "start_line": F.lit(line), "end_line": F.lit(line), "is_async": F.lit(flag), "is_method": F.lit(False)}
        kinds = dict(c.split() for c in graph.SCHEMAS["functions"].split(", "))
        return s.select(*[given.get(c, F.lit("x")).cast(t).alias(c) for c, t in kinds.items()])

    old, new = rows("s_suppkey % 3 <> 0", "old", 1, False), rows("s_suppkey % 2 = 0", "new", 9, True)
    again = rows("s_suppkey % 2 = 0", "older", 2, False)  # of equal keys the later line wins
    layout = Layout(graph.SCHEMAS["functions"], ("function_id",), ("function_id",))
    new = new.unionByName(again)
    stored = layered(spark, f"node_upserts {sf_dir}", layout, old, lambda change: (new.select("function_id"), graph.upsert_vertices(change.lookup("rows", new.select("function_id")), new, "functions")))
    return stored.select("function_id", F.when(F.col("name") == "older", "new").otherwise(F.col("name")).alias("name"), "start_line", "is_async")


@query("select 'BELONGS_TO_REPO' as type, sha256(source || '::doc/' || doc_id) as src, sha256(source) as dst from documents")
def repo_edges(spark, sf_dir):
    d = document_chunks(spark, sf_dir)
    return graph.repo_edges(d.withColumn("file_id", ids.file_id("repo_name", "file_path"))).select("type", "src", "dst")


@query("""with p as (select p_brand as repo, 'f' || (p_partkey % 10) as path, p_partkey % 4 as k, p_partkey as seq from part),
i as (select *, sha256(repo || '::' || path || case k when 0 then '::class::c' || seq when 1 then '::function::q' || seq else '::endpoint::GET::/' || seq end) as id from p where k < 3)
select sha256(repo || '::' || path) as doc_id, array_to_string(list(id order by k, seq), ',') as graph_node_ids from i group by repo, path""")
def node_ids_of_files(spark, sf_dir):
    """A file's classes, functions and endpoints, in this order and then by place; imports are no nodes."""
    k = F.col("p_partkey") % 4
    s = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("repo_name"), F.concat(F.lit("f"), (F.col("p_partkey") % 10).cast("string")).alias("file_path"), F.col("p_partkey").cast("int").alias("seq"),
        F.when(k == 0, "class").when(k == 1, "function").when(k == 2, "endpoint").otherwise("import").alias("kind"),
        F.concat(F.lit("c"), col("p_partkey")).alias("name"), F.concat(F.lit("q"), col("p_partkey")).alias("qualified_name"), F.lit("GET").alias("http_method"), F.concat(F.lit("/"), col("p_partkey")).alias("path"),
    )
    return graph.node_ids_per_file(s).select("doc_id", F.array_join("graph_node_ids", ",").alias("graph_node_ids"))


@query("""select 'node' as element, 'repos' as name, (select count(*) from region) as count union all select 'node', 'files', (select count(*) from nation) union all select 'node', 'classes', (select count(*) from supplier)
union all select 'node', 'functions', (select count(*) from customer) union all select 'node', 'endpoints', 0 union all select 'edge', t, case t when 'IMPORT_DEP' then (select count(*) from orders) when 'HANDLES' then (select count(*) from nation) else 0 end
from (select unnest(['BELONGS_TO_REPO', 'CONTAINS_CLASS', 'CONTAINS_FUNCTION', 'METHOD_OF', 'IMPORT_DEP', 'CALLS', 'EXPOSES', 'HANDLES', 'INHERITS', 'CROSS_REPO_CALL']) as t)""")
def graph_counts(spark, sf_dir):
    """Counts of every type of node and edge, zeros included."""
    named = lambda t, key, kind: table(spark, sf_dir, t).select(col(key).alias(graph.KEYS[kind]))
    nodes = {"repos": named("region", "r_regionkey", "repos"), "files": named("nation", "n_nationkey", "files"), "classes": named("supplier", "s_suppkey", "classes"), "functions": named("customer", "c_custkey", "functions"), "endpoints": named("part", "p_partkey", "endpoints").limit(0)}
    edges = table(spark, sf_dir, "orders").select(F.lit("IMPORT_DEP").alias("type")).unionByName(table(spark, sf_dir, "nation").select(F.lit("HANDLES").alias("type")))
    return graph.graph_stats(nodes, edges)


@query("""with dead as (select * from customer where c_nationkey % 5 = 0) select 'function' as what, c_custkey::varchar as id from customer where c_nationkey % 5 <> 0
union all select 'edge', o_orderkey::varchar from orders where o_custkey not in (select c_custkey from dead)""")
def stale_symbols(spark, sf_dir):
    """The symbols of changed files go, with every edge that touches them."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), col("c_custkey")).alias("function_id"), F.lit("r").alias("repo_name"), F.concat(F.lit("n"), col("c_nationkey")).alias("file_path"))
    none = lambda k: c.limit(0).withColumnRenamed("function_id", graph.KEYS[k])
    e = table(spark, sf_dir, "orders").select(F.lit("CALLS").alias("type"), F.concat(F.lit("o"), col("o_orderkey")).alias("src"), F.concat(F.lit("f"), col("o_custkey")).alias("dst"))
    gone = table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(F.lit("r").alias("repo_name"), F.concat(F.lit("n"), col("n_nationkey")).alias("file_path"))
    left, kept = graph.delete_file_symbols({"classes": none("classes"), "functions": c, "endpoints": none("endpoints")}, e, gone)
    one = lambda d, what, key: d.select(F.lit(what).alias("what"), F.substring(key, 2, 99).alias("id"))
    return one(left["functions"], "function", "function_id").unionByName(one(kept, "edge", "src"))


@query("""with f as (select 's' || s_nationkey as repo, 'c' || s_suppkey || '.py' as path, s_suppkey % 25 as k from supplier), e as (select 's' || n_nationkey as repo, 'e' || n_nationkey || '.py' as path, n_nationkey as k from nation)
select 'CROSS_REPO_CALL' as type, sha256(f.repo || '::' || f.path) as src, sha256(e.repo || '::' || e.path) as dst, 'http' as signal, '/api/n/' || f.k as symbols, 1.0::double as confidence from f join e using (k) where f.repo <> e.repo
union all select 'CROSS_REPO_CALL', sha256(f.repo || '::' || f.path), sha256(e.repo || '::' || e.path), 'kafka', 't' || f.k, 1.0::double from f join e on (f.k + 1) % 25 = e.k where f.repo <> e.repo""")
def cross_repo_calls(spark, sf_dir):
    """Callers of other repositories' endpoints, by the path's tail, and producers for their topics."""
    s, n = dealt(table(spark, sf_dir, "supplier")), table(spark, sf_dir, "nation")
    k = (F.col("s_suppkey") % 25).cast("string")
    calls = text('requests.get("http://x/api/n/', k, '?q=1"); p.produce("t', k, '", 1)')
    f = s.select(F.concat(F.lit("s"), col("s_nationkey")).alias("repo_name"), F.concat(F.lit("c"), col("s_suppkey"), F.lit(".py")).alias("file_path"), calls.alias("content"))
    own = [F.concat(F.lit("s"), col("n_nationkey")).alias("repo_name"), F.concat(F.lit("e"), col("n_nationkey"), F.lit(".py")).alias("file_path")]
    hears = text("c.subscribe(['t", ((F.col("n_nationkey") + 24) % 25).cast("string"), "'])")
    e = n.select(*own, F.concat(F.lit("/v1/api/n/"), col("n_nationkey")).alias("path_pattern"))
    return linker.cross_repo_links(f.unionByName(n.select(*own, hears.alias("content"))), e).select("type", "src", "dst", "signal", F.array_join("symbols", ",").alias("symbols"), "confidence")


@query("""with d as (select distinct s_nationkey as q, 'f' || (s_suppkey % 25) as path from supplier), r as (select *, row_number() over (partition by q order by path) as n from d)
select 'q' || q as query_id, path as file_path from r where n <= 5 union select 'q' || n_nationkey, 'f' || n_nationkey from nation""")
def handler_files(spark, sf_dir):
    """Functions' own files, and the first of those whose endpoints they handle."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    path = F.concat(F.lit("f"), col("n_nationkey"))
    matches = n.select(F.concat(F.lit("q"), col("n_nationkey")).alias("query_id"), F.lit("Function").alias("kind"), F.concat(F.lit("fn"), col("n_nationkey")).alias("id"), F.lit("r").alias("repo_name"), path.alias("file_path"))
    files = n.select(path.alias("file_id"), F.lit("r").alias("repo_name"), path.alias("file_path"))
    e = F.concat(F.lit("e"), col("s_suppkey"))
    handles = s.select(F.lit("HANDLES").alias("type"), e.alias("src"), F.concat(F.lit("fn"), col("s_nationkey")).alias("dst"))
    exposes = s.select(F.lit("EXPOSES").alias("type"), F.concat(F.lit("f"), (F.col("s_suppkey") % 25).cast("string")).alias("src"), e.alias("dst"))
    return traverse.related_files(matches, files, handles.unionByName(exposes)).select("query_id", "file_path")


@query("""with m as (select c_nationkey as k, 'm' || c_custkey as m from customer) select 'c' || k as id, array_to_string(list_slice(list_sort(list_distinct(list(m))), 1, 12), ',') as methods from m group by k""")
def class_methods(spark, sf_dir):
    """The first twelve methods of each matched class, by name."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    matches = n.select(F.lit("q").alias("query_id"), F.lit("Class").alias("kind"), F.concat(F.lit("c"), col("n_nationkey")).alias("id"))
    fn = F.concat(F.lit("fn"), col("c_custkey"))
    edges = c.select(F.lit("METHOD_OF").alias("type"), fn.alias("src"), F.concat(F.lit("c"), col("c_nationkey")).alias("dst"))
    out = traverse.methods_of(matches, c.select(fn.alias("function_id"), F.concat(F.lit("m"), col("c_custkey")).alias("name")), edges)
    return out.select("id", F.array_join("methods", ",").alias("methods"))


@query("""with n as (select distinct 'Class' as kind, p_brand as name from part union select distinct 'Function', c_mktsegment from customer union select distinct 'APIEndpoint', '/' || p_type from part)
select kind, name from n qualify row_number() over (partition by kind order by name) <= 20""")
def known_name_list(spark, sf_dir):
    """The graph's distinct names, the first twenty of each kind."""
    p = table(spark, sf_dir, "part")
    return traverse.known_names(p.select(F.col("p_brand").alias("name")), table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")), p.select(F.concat(F.lit("/"), "p_type").alias("path_pattern")), 20)


@query("""select 'q' || n_nationkey as query_id, unnest(['Alpha' || n_nationkey, 'beta-' || n_nationkey, 'two words ' || n_nationkey, 'get_x' || n_nationkey, 'budget.' || n_nationkey]) as entity from nation""")
def known_name_matches(spark, sf_dir):
    """Known names that stand in a question as whole words, in any case, beside names by shape."""
    n = table(spark, sf_dir, "nation")
    k = col("n_nationkey")
    q = n.select(F.concat(F.lit("q"), k).alias("query_id"), text("why does alpha", k, " call beta-", k, ", but not beta-", k, "x, or two  words or two words ", k, " of get_x", k, " and the budget.", k, "?").alias("query"))
    c = n.select(F.concat(F.lit("Alpha"), k).alias("name")).unionByName(n.select(F.concat(F.lit("two words "), k).alias("name")))
    f = n.select(F.concat(F.lit("beta-"), k).alias("name")).unionByName(n.select(F.lit("get").alias("name"))).unionByName(n.select(F.concat(F.lit("budget."), k).alias("name")))
    names = traverse.known_names(c, f, n.select(F.concat(F.lit("/none/"), k).alias("path_pattern")))
    return traverse.extract_entities(q, names)


@query("""select 'q' || n_nationkey as query_id, '* class `K' || n_nationkey || '` (r: p' || n_nationkey || ') with `a`, `b`' || chr(10) || '* async method `K.f' || n_nationkey || '` (r: p' || n_nationkey || ')' || chr(10) || '* function `g` (r)' || chr(10) || '* route `GET /n/' || n_nationkey || '` of flask' as summary from nation""")
def graph_summaries(spark, sf_dir):
    """A line for each match, by kind: classes with their methods, functions with their traits, routes with their framework."""
    n, k = table(spark, sf_dir, "nation"), col("n_nationkey")
    null, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    row = lambda kind, id_, name, path, repo="r", qualified=null, is_async=no, is_method=no, method=null, framework=null: F.struct(F.lit(kind).alias("kind"), F.lit(id_).alias("id"), name.alias("name"), path.alias("file_path"), F.lit(repo).cast("string").alias("repo_name"), qualified.alias("qualified_name"), is_async.alias("is_async"), is_method.alias("is_method"), method.alias("http_method"), framework.alias("framework"))
    at, yes = F.concat(F.lit("p"), k), F.lit(True)
    rows = F.array(
        row("Class", "1", F.concat(F.lit("K"), k), at), row("Function", "2", F.lit("f"), at, qualified=F.concat(F.lit("K.f"), k), is_async=yes, is_method=yes), row("Function", "3", F.lit("g"), null),
        row("APIEndpoint", "4", F.concat(F.lit("/n/"), k), null, None, method=F.lit("GET"), framework=F.lit("flask")),
    )
    matches = n.select(F.concat(F.lit("q"), k).alias("query_id"), F.explode(rows).alias("m")).select("query_id", "m.*")
    methods = n.select(F.concat(F.lit("q"), k).alias("query_id"), F.lit("1").alias("id"), F.array(F.lit("a"), F.lit("b")).alias("methods"))
    return traverse.summarise(matches, methods)


# --- viewer ----------------------------------------------------------------------------


def _shown(spark, sf_dir):
    return _nodes(spark, sf_dir).withColumn("repo_name", F.when(F.col("type").isin("part", "orders"), "goods").when(F.col("type") != "region", "people"))


@query(f"""with {_GRAPH}, kept as (select id, type from nodes where type in ('nation', 'customer', 'supplier') qualify row_number() over (partition by type order by id) <= 50)
select 'node' as what, type, id as a, null as b from kept union all select 'edge', type, src, dst from edges where src in (select id from kept) and dst in (select id from kept)""")
def viewer_scoped(spark, sf_dir):
    """One repository's nodes, fifty of each type, and the edges between them."""
    n, e = viewer.subgraph(_shown(spark, sf_dir), _edges(spark, sf_dir), 50, repo="people")
    return n.select(F.lit("node").alias("what"), "type", F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(e.select(F.lit("edge").alias("what"), "type", F.col("src").alias("a"), F.col("dst").alias("b")))


@query(f"with {_GRAPH} select type, src, dst from edges where type in ('IN_REGION', 'IN_NATION') and src not like 'customer%'")
def viewer_types(spark, sf_dir):
    """Redrawn with some types only: edges with both ends among them."""
    return viewer.subgraph(_shown(spark, sf_dir), _edges(spark, sf_dir), 1_000_000, types=("region", "nation", "supplier"))[1].select("type", "src", "dst")


@query(f"""with {_GRAPH} select 'node' as kind, '{{"id":"' || id || '","type":"' || type || '","label":"' || label || '"}}' as json from nodes where type in ('region', 'nation') union all select 'edge', '{{"type":"' || type || '","src":"' || src || '","dst":"' || dst || '"}}' from edges where type = 'IN_REGION'
union all select 'stats', '{{"element":"node","type":"region","count":' || (select count(*) from region) || '}}' union all select 'stats', '{{"element":"node","type":"nation","count":' || (select count(*) from nation) || '}}' union all select 'stats', '{{"element":"edge","type":"IN_REGION","count":' || (select count(*) from nation) || '}}'
union all select 'stats', '{{"element":"node","count":' || (select count(*) from region) + (select count(*) from nation) || '}}' union all select 'stats', '{{"element":"edge","count":' || (select count(*) from nation) || '}}'""")
def viewer_export(spark, sf_dir):
    """The graph as lines of JSON: nodes, edges and statistics."""
    n = _nodes(spark, sf_dir).where("type in ('region', 'nation')")
    return viewer.export(n, _edges(spark, sf_dir).where("type = 'IN_REGION'").select("type", "src", "dst"))


@query("select 'goods' as repo_name union all select 'people'")
def viewer_repos(spark, sf_dir):
    return viewer.repo_list(_shown(spark, sf_dir))


# --- answering -------------------------------------------------------------------------


def _found(spark, sf_dir):
    """Each source's first documents as a question's results."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.concat(F.lit("why "), "source").alias("query"), F.concat(F.lit("doc/"), F.col("lang")).alias("file_path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
    return search.rank_by(d, 4, F.asc("doc_id"))


_FOUND = "f as (select source as query_id, 'doc/' || lang as file_path, coalesce(text, '') as content, row_number() over (partition by source order by doc_id) as rank from documents qualify rank <= 4)"


@query(f"""with {_FOUND} select query_id, sha256(string_agg('[' || (rank - 1) || '] (' || file_path || ')' || chr(10) || left(content, 600), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)) as list_sha256 from f group by 1""")
def chunk_lists(spark, sf_dir):
    """Numbered chunks as a curator reads them."""
    rows = _found(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file_path", "content"))).alias("r"))
    return rows.select("query_id", F.sha2(ask.chunk_list(F.col("r")), 256).alias("list_sha256"))


@query(f"""with {_FOUND}, u as (select query_id, file_path, min(rank) as r from f group by all), n as (select query_id, string_agg(file_path, ',' order by r) as files from u group by 1)
select query_id, 'plain' as kind, sha256(string_agg(content, chr(10) || chr(10) order by rank)) as summary, any_value(files) as relevant_files, count(*)::int as chunk_count from f join n using (query_id) group by 1
union all select distinct query_id, 'chosen', sha256('S'), 'x,y', 2 from f union all select query_id, 'broken', sha256(string_agg(content, chr(10) || chr(10) order by rank)), any_value(files), count(*)::int from f join n using (query_id) group by 1""")
def curated(spark, sf_dir):
    """Without a curator all is kept; a curator's choice counts indices that exist; an answer that can't be read keeps all."""
    rows, out = _found(spark, sf_dir), None
    chosen = '```json\n{"summary": "S", "relevant_files": ["x", "y"], "kept_chunk_indices": [0, 2, 9, -1]}\n```'
    for kind, model in (("plain", None), ("chosen", lambda c: F.lit(chosen)), ("broken", lambda c: F.concat(F.lit("sorry: "), F.substring(c, 1, 3)))):
        one = ask.curate(rows, model).select("query_id", F.lit(kind).alias("kind"), F.sha2("summary", 256).alias("summary"), F.array_join("relevant_files", ",").alias("relevant_files"), F.col("chunk_count").cast("int").alias("chunk_count"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""select conv_id, turn, 'Question:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Files:' || chr(10) || 'a.py' || chr(10) || 'b.py' || case when turn % 2 = 0 then chr(10) || chr(10) || 'Known from the graph:' || chr(10) || role else '' end || chr(10) || chr(10) || 'Code:' || chr(10) || 'x = 1' as prompt from conversations where coalesce(text, '') <> ''""")
def prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("coalesce(text, '') <> ''")
    return c.select("conv_id", "turn", ask.prompt(F.col("text"), F.lit("x = 1"), F.when(F.col("turn") % 2 == 0, F.col("role")), F.array(F.lit("a.py"), F.lit("b.py"))).alias("prompt"))


@query("""with e as (select 'q' || vec_id as query, vec_id % 97 as t, vec_id as v from embeddings where vec_id % 3 > 0) select query, 0 as hit_count from e order by t desc, v desc limit 40""")
def cache_store(spark, sf_dir):
    """Stored answers, those without a vector left out, cut to the newest."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.lpad(col("vec_id"), 9, "0").alias("id"), F.concat(F.lit("q"), col("vec_id")).alias("query"), F.when(F.col("vec_id") % 3 > 0, F.col("embedding")).alias("embedding"), F.lit("a").alias("answer"), F.timestamp_seconds(F.col("vec_id") % 97).alias("created_at"))
    return cache.store(spark.createDataFrame([], cache.ENTRY), rows, 40).select("query", "hit_count")


@query("""select c_custkey::varchar as id, (c_custkey % 3 + coalesce(n, 0))::int as hit_count, n is not null as hit from customer left join (select o_custkey as c_custkey, count(*) as n from orders group by 1) using (c_custkey)""")
def cache_hits(spark, sf_dir):
    """Hits counted at their entries."""
    kinds = dict(c.split() for c in cache.ENTRY.split(", "))
    given = {"id": col("c_custkey"), "hit_count": F.col("c_custkey") % 3}
    c = table(spark, sf_dir, "customer").select(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])
    return cache.record_hits(c, table(spark, sf_dir, "orders").select(col("o_custkey").alias("id"))).select("id", "hit_count", F.col("last_hit_at").isNotNull().alias("hit"))


@query("""select 'registry' as what, 0 as left_over, count(*)::int as before from documents where lang <> 'fr' union all select 'cache', 0, count(*)::int from embeddings""")
def emptied(spark, sf_dir):
    """Deleting all: nothing is left, and the number deleted is told."""
    from .queries import _cache

    registry = _registry(spark, sf_dir)[0]
    empty, n = cache.invalidate(_cache(spark, sf_dir)[0])
    return spark.createDataFrame([("registry", delta.clear(registry).count(), registry.count()), ("cache", empty.count(), n)], "what string, left_over int, before int")


@query("select * from (values ('none', null, 401), ('key', 'k', 401), ('other', 'Bearer x', 403), ('right', 'Bearer k', 200), ('long', 'Bearer k ', 403), ('scheme', 'bearer k', 401)) t(name, header, status)")
def authorisation(spark, sf_dir):
    """Bearer tokens against a key."""
    cases = [("none", None), ("key", "k"), ("other", "Bearer x"), ("right", "Bearer k"), ("long", "Bearer k "), ("scheme", "bearer k")]
    return spark.createDataFrame([(n, h, service.authorise(h, "k")) for n, h in cases], "name string, header string, status int")


def letters(text):
    """An embedder that SQL can follow: how often each letter stands in it."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])


def stored_index(spark: SparkSession, sf_dir: str) -> Index:
    """The documents as an index on disk, built once in a session: chunks with vectors, postings and terms; no graph."""

    def build(path):
        d = document_chunks(spark, sf_dir)
        given = {"chunk_id": F.lpad(col("chunk_id"), 12, "0"), "embedding": letters(F.col("content"))}
        kinds = dict(c.split() for c in CHUNKS.split(", "))
        change = Index(spark, path).store.begin()
        files = d.count()
        change.replace("chunks", d.select(*[given.get(c, F.col(c) if c in d.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns(CHUNKS)]), files)
        stored = change.table("chunks")
        put_bm25(change, stored, stored.limit(0), stored.limit(0), lambda df: df.persist(), files)
        change.commit()

    return Index(spark, store.once(spark, "index", sf_dir, build))


_LETTERS = "list_transform(range(97, 123), lambda c: (length({0}) - length(replace({0}, chr(c::int), '')))::double)"


@query(f"""with {_BM25.format(where='')}, e as (select doc_id, {_LETTERS.format("lower(coalesce(text, ''))")} as v from documents), q as (select item_id, {_LETTERS.format("lower(coalesce(text, ''))")} as v from benchmark),
en as (select *, sqrt(list_dot_product(v, v)) as n from e), qn as (select *, sqrt(list_dot_product(v, v)) as n from q),
p as (select item_id as query_id, doc_id as chunk_id, case when qn.n = 0 or en.n = 0 then 0.0 else list_dot_product(qn.v, en.v) / (qn.n * en.n) end as score from qn join en on true),
dn as (select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank, score from p),
keyed as (select l.*, sha256(coalesce(d.text, '')) as key from (select query_id, chunk_id, rank, 0 as list from dn where rank <= 20 and score >= 0.3 union all select query_id, chunk_id, rank, 1 as list from bm) l join documents d on d.doc_id = l.chunk_id),
fused as (select query_id, key, sum(1.0 / (60 + rank)) as score, max_by(chunk_id, list * 1000000 + rank) as chunk_id, min(list * 1000000 + rank) as f, count(*) filter (list = 0) as a, count(*) filter (list = 1) as b from keyed group by 1, 2),
out as (select *, row_number() over (partition by query_id order by round(score, 9) desc, f, key) as rank, sum(a) over (partition by query_id) as dense, sum(b) over (partition by query_id) as sparse from fused)
select query_id::varchar as query_id, lpad(chunk_id::varchar, 12, '0') as chunk_id, 'doc/' || chunk_id as file_path, round(score, 6) as score, rank::int as rank, dense::int as dense, sparse::int as sparse from out where rank <= 5""")
def ask_ranking(spark, sf_dir):
    """The flagship: what answering retrieves for every benchmark question from the stored index, dense and sparse lists fused."""
    q = _questions(spark, sf_dir).select(col("query_id").alias("query_id"), "query")
    out = ask.retrieve(stored_index(spark, sf_dir), q, 5, use_graph=False, embedder=letters)
    return out.select("query_id", "chunk_id", "file_path", F.round("score", 6).alias("score"), "rank", F.col("found")[0].alias("dense"), F.col("found")[1].alias("sparse"))


@query("""select 'q' || n_nationkey as query_id, len(regexp_extract_all('ab_1 c.d (' || n_name || ')', '\\w+|[^\\w\\s]+')) as tokens, list_distinct(list_filter(['get', 'user', n_name], lambda x: length(x) > 3)) is not null as any from nation""".replace("\\\\", "\\"))
def token_counts(spark, sf_dir):
    """The estimate of tokens for models that report none."""
    t = F.concat(F.lit("ab_1 c.d ("), "n_name", F.lit(")"))
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("q"), col("n_nationkey")).alias("query_id"), ask.token_count(t).cast("long").alias("tokens"), (F.size(code_tokens(t)) >= 0).alias("any"))
