import duckdb
import pytest
import xxhash

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    """Every query covers its table and, where there is SQL, gives its rows."""
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in queries.ORACLE_SQL:
        ids = {r[cols.index("doc_id")] for r in got}
        assert ids == {r[0] for r in duck.execute("select doc_id from documents").fetchall()}
        return
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)


def test_settings_stay_as_they_were(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(k) for k in keys]
    queries.op2_toxicity(spark, SF).collect()
    queries.op1_token_output(spark, SF).collect()
    assert [spark.conf.get(k) for k in keys] == before


def test_xxh64_in_sql():
    texts = ["", "a", "abcdefg", "abcdefgh", "abcdefghijkl", "x" * 31, "y" * 32, "é" * 17, "hello world foo", "z" * 100, "q" * 67, "0123456789" * 13]
    con = duckdb.connect()
    con.execute("create table t(s varchar)")
    con.executemany("insert into t values (?)", [(t,) for t in texts])
    got = dict(con.execute(f"with d as (select s from t),{queries._xxh64()} select s, h from x").fetchall())
    assert got == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}
