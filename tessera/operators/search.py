"""Retrieval: exact dense search, BM25 over a postings table, reciprocal rank fusion, reranking.

Every operator takes many queries at once; ranks are columns.  Scores that agree to nine
decimals are ties, so that the order of additions can't decide; ties go by id.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_tokens
from ..settings import get_settings
from . import dense

log = logging.getLogger(__name__)


def _bounded(df: DataFrame, row_bytes: int = 200) -> DataFrame:
    """The frame marked for broadcast where its rows, of about so many bytes each, are few enough; what was read to count them is what is sent."""
    s = get_settings()
    most = max(1, min(s.broadcast_rows, s.broadcast_bytes // row_bytes))
    some = df.limit(most + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(some, df.schema)) if some.num_rows <= most else df


def _near(score: str = "score") -> Column:
    return F.round(score, 9).desc()


def rank_by(df: DataFrame, k: int | None, *order: Column, by: str = "query_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    out = df.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def vector_search(chunks: DataFrame, queries: DataFrame, top_k: int | None = None, min_score: float | None = None, scope: Column | None = None, metric: str = "cosine", id_col: str = "chunk_id") -> DataFrame:
    """(query_id, chunk_id, score, rank) of the nearest chunks: the threshold is applied after top_k.

    scope: a condition on chunks that reaches the scan.  queries: (query_id, embedding), a batch of any size; see :mod:`dense`.
    """
    s = get_settings()
    top_k, min_score = top_k or s.top_k_results, s.min_relevance_score if min_score is None else min_score
    found = dense.nearest(chunks if scope is None else chunks.where(scope), queries, top_k, F.col(id_col), metric=metric)
    found = found.select("query_id", F.col("key").alias("chunk_id"), "score")
    return rank_by(found, top_k, _near(), F.asc("chunk_id")).where(F.col("score") >= min_score)


@dataclass(frozen=True)
class Bm25Index:
    """postings (bucket, term, chunk_id, tf, dl), terms (term, df, idf) and the scalars of the corpus. A bucket is a hash of the term."""

    postings: DataFrame
    terms: DataFrame
    n_chunks: int
    avg_length: float


K1, B, EPSILON = 1.5, 0.75, 0.25
BUCKETS = 64


def bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings_of(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, term, chunk_id, tf, dl, head) and the columns to keep; head marks one row of each chunk, so that chunks are counted without a shuffle.

    Chunks without tokens have one row without a term, so that averages count them.  A chunk's own tokens are
    counted within its row: nothing is shuffled.
    """
    tokens = chunks.select(F.col(id_col).alias("chunk_id"), *keep, F.sort_array(code_tokens(text_col)).alias("t")).withColumn("dl", F.size("t").cast("long"))
    # in a sorted list a term's count is where its run ends less where it begins
    ends = F.expr("filter(transform(t, (x, i) -> if(i = size(t) - 1 or t[i + 1] <> x, i + 1, 0)), i -> i > 0)")
    runs = tokens.select("chunk_id", *keep, "dl", "t", ends.alias("ends"))
    runs = runs.select("chunk_id", *keep, "dl", F.expr("transform(ends, (e, i) -> struct(t[e - 1] as term, cast(e - if(i = 0, 0, ends[i - 1]) as bigint) as tf))").alias("r"))
    rows = runs.select("chunk_id", *keep, "dl", F.posexplode_outer("r").alias("p", "r")).select("chunk_id", *keep, "dl", "r.term", "r.tf", (F.coalesce("p", F.lit(0)) == 0).alias("head"))
    return rows.select(F.coalesce(bucket(), F.lit(0)).alias("bucket"), "term", "chunk_id", "tf", "dl", "head", *keep)


def raw_idf(n: int) -> Column:
    """A term's idf among n chunks, before common terms are lifted."""
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def lifted(idf: Column, mean: float) -> Column:
    """Terms in more than half of the chunks get a share of the mean."""
    return F.when(idf < 0, F.lit(EPSILON * mean)).otherwise(idf)


def index_of(postings: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> Bm25Index:
    """Statistics of postings, all from one grouping by term. keep(frame, name) stores its small table and returns it read back; without it the postings are read for each use."""
    by = postings.groupBy("term").agg(F.count("*").alias("df"), F.count_if("head").alias("n"), F.sum(F.when(F.col("head"), F.col("dl"))).alias("length"))
    by = keep(by, "terms") if keep else by
    n, total = by.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("length")).first()
    raw = by.where("term is not null").select("term", "df", raw_idf(n).alias("_idf"))
    mean = raw.agg(F.avg("_idf")).first()[0] or 0.0
    terms = raw.select("term", "df", lifted(F.col("_idf"), mean).alias("idf"))
    return Bm25Index(postings, terms, n, (total or 0) / n if n else 0.0)


def build_bm25(chunks: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None, id_col: str = "chunk_id", text_col: str = "content") -> Bm25Index:
    """Postings and statistics. keep(frame, name) stores a table and returns it read back; without it they are computed where they are used."""
    postings = postings_of(chunks, id_col, text_col)
    return index_of(keep(postings, "postings") if keep else postings, keep)


#: Chunks and queries, about, that one task scores against each other.
CHUNKS_A_PART, QUERIES_A_PART = 8192, 1024


def bm25_search(index: Bm25Index, queries: DataFrame, top_k: int | None = None, scope: DataFrame | None = None, normalise: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, rank): positive scores only, best first, divided by the best one.

    queries: (query_id, query).  scope: chunk_ids to keep; statistics stay the corpus's own.
    Only postings of the queries' terms are read on, and only their buckets from a stored index.  They are regrouped by
    chunk, once for each block of queries, and a task scores its chunks for all of a block's queries and gives the best of
    each: what moves are postings and the best, never pairs of a query and a chunk.
    """
    top_k = top_k or get_settings().bm25_top_k
    parts, blocks = max(1, -(-index.n_chunks // CHUNKS_A_PART)), max(1, -(-queries.count() // QUERIES_A_PART))
    asked = queries.select("query_id", F.explode(code_tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    weighted = asked.join(index.terms.select("term", "idf"), "term").select("block", "term", "query_id", (F.col("qtf") * F.col("idf")).alias("w"))
    number = F.row_number().over(Window.partitionBy("block").orderBy("term"))  # of a block's terms
    terms = weighted.select("block", "term").distinct().withColumn("t", number).withColumn("bucket", bucket())
    tf = F.col("tf")
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(index.avg_length or 1.0)))
    postings = index.postings if scope is None else index.postings.join(_bounded(scope.select("chunk_id").distinct(), 16), "chunk_id", "left_semi")
    hits = postings.join(_bounded(terms), ["bucket", "term"])
    hits = hits.select("block", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part"), "chunk_id", "t", part.alias("x"))
    weights = weighted.join(terms.select("block", "term", "t"), ["block", "term"]).select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "t", "query_id", "w")
    shape = f"query_id {dict(weights.dtypes)['query_id']}, chunk_id {dict(hits.dtypes)['chunk_id']}, score double"
    weights = weights.toDF(*weights.columns)  # columns of its own, as both sides come from terms
    scored = hits.groupBy("block", "part").cogroup(weights.groupBy("block", "part")).applyInArrow(_best_of(top_k), shape)
    best = rank_by(scored, top_k, _near(), F.asc("chunk_id"))
    if not normalise:
        return best.select("query_id", "chunk_id", "score", "rank")
    top = F.max("score").over(Window.partitionBy("query_id"))
    return best.select("query_id", "chunk_id", (F.col("score") / top).alias("score"), "rank")


def _best_of(k: int) -> Callable:
    """Of chunks' hits (chunk_id, t, x) and queries' weights (t, query_id, w): each query's best k positive scores, and by the least id of those that agree."""

    def score(hits, weights):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["query_id", "chunk_id", "score"]
        kinds = [weights.schema.field("query_id").type, hits.schema.field("chunk_id").type, pa.float64()]

        def coded(column):
            """The different values in order, and each row's place among them."""
            d = column.combine_chunks().dictionary_encode()
            d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
            order = pc.sort_indices(d.dictionary)
            place = np.empty(len(order), np.int64)
            place[order.to_numpy()] = np.arange(len(order))
            return d.dictionary.take(order), place[d.indices.to_numpy()]

        found = []
        if hits.num_rows and weights.num_rows:
            chunks, row = coded(hits["chunk_id"])
            asked, q = coded(weights["query_id"])
            t, by_term = hits["t"].to_numpy(), np.argsort(hits["t"].to_numpy(), kind="stable")
            row, x, t = row[by_term], hits["x"].to_numpy()[by_term], t[by_term]
            by_query = np.argsort(q, kind="stable")
            q, w, wanted = q[by_query], weights["w"].to_numpy()[by_query], weights["t"].to_numpy()[by_query]
            first, last = np.searchsorted(t, wanted, "left"), np.searchsorted(t, wanted, "right")
            bounds = np.searchsorted(q, np.arange(len(asked) + 1))
            for n in range(len(asked)):
                total = np.zeros(len(chunks))
                for i in range(bounds[n], bounds[n + 1]):
                    if last[i] > first[i]:
                        total += np.bincount(row[first[i] : last[i]], x[first[i] : last[i]] * w[i], len(chunks))
                some = np.flatnonzero(total > 0)
                near = np.round(total[some], dense.DIGITS)
                if len(some) > k:
                    least = -np.partition(-near, k - 1)[k - 1]
                    equal = near == least
                    some = some[(near > least) | (equal & (np.cumsum(equal) <= k))]
                if len(some):
                    found.append(pa.table([asked.take(pa.array(np.full(len(some), n))), chunks.take(pa.array(some)), pa.array(total[some])], names))
        return pa.concat_tables(found) if found else pa.table([pa.array([], kind) for kind in kinds], names)

    return score


def fusion_key(key: str = "content_hash") -> Column:
    """What makes results one: the content's hash (or the chunk's id), else the path and the first 80 characters."""
    fallback = F.concat(F.coalesce("file_path", F.lit("")), F.lit("::"), F.substring(F.coalesce("content", F.lit("")), 1, 80))
    return F.coalesce(F.nullif(F.col(key), F.lit("")), fallback)


def rrf_fuse(lists: list[DataFrame], top_k: int | None = None, k: int | None = None, counts: bool = False) -> DataFrame:
    """(query_id, key, chunk_id, score, rank): sums 1 / (k + rank) by key over the lists (query_id, key, chunk_id, rank).

    Ties: the key that came first, by list and rank.  The last one seen stands for the key.
    counts: adds found, how many rows each list has for the query.
    """
    s = get_settings()
    k, top_k = k or s.hybrid_rrf_k, top_k or s.top_k_results
    place = F.struct(F.col("_list"), F.col("rank"))
    rows = reduce(DataFrame.unionByName, [d.select("query_id", "key", "chunk_id", "rank").withColumn("_list", F.lit(i)) for i, d in enumerate(lists)])
    fused = rows.groupBy("query_id", "key").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.max_by("chunk_id", place).alias("chunk_id"), F.min(place).alias("_first"), *[F.count_if(F.col("_list") == i).alias(f"_n{i}") for i in range(len(lists))])
    every = Window.partitionBy("query_id")
    fused = fused.withColumn("found", F.array(*[F.sum(f"_n{i}").over(every) for i in range(len(lists))]))
    return rank_by(fused, top_k, _near(), F.asc("_first"), F.asc("key")).select("query_id", "key", "chunk_id", "score", "rank", *(["found"] if counts else []))


def rerank(results: DataFrame, model: Callable[[Column, Column], Column] | None, top_k: int | None = None) -> DataFrame:
    """Orders results (query_id, query, content, rank, ...) by the model's score of query and text.

    Without a model, and with one that can't be called, the order and the scores stay; a query for which it gives no
    score for some text (null: it failed there) keeps its order too.
    """
    as_it_was = results if top_k is None else results.where(F.col("rank") <= top_k)
    if model is None:
        return as_it_was
    try:
        given = model(F.col("query"), F.substring("content", 1, 2000))
    except Exception:
        log.exception("reranker failed; the order stays")
        return as_it_was
    whole = F.count("_new").over(Window.partitionBy("query_id")) == F.count("*").over(Window.partitionBy("query_id"))
    scored = results.withColumn("_new", given).withColumn("_whole", whole).withColumnRenamed("rank", "_was")
    if "score" in results.columns:
        scored = scored.withColumn("score", F.when(F.col("_whole"), F.col("_new")).otherwise(F.col("score")))
    else:
        scored = scored.withColumn("score", F.when(F.col("_whole"), F.col("_new")))
    return rank_by(scored, top_k, F.when(F.col("_whole"), F.col("_new")).desc_nulls_last(), F.asc("_was")).drop("_was", "_new", "_whole")


def graph_chunks(chunks: DataFrame, related: DataFrame, top_k: int | None = None, most_files: int = 8, per_file: int = 3, score: float = 0.5) -> DataFrame:
    """(query_id, chunk_id, score, rank): the first chunks of each query's first related files (query_id, repo_name, file_path)."""
    top_k = top_k or get_settings().top_k_results
    files = rank_by(related.select("query_id", "repo_name", "file_path").distinct(), most_files, F.asc("file_path"), F.asc("repo_name")).drop("rank")
    found = chunks.select("chunk_id", "repo_name", "file_path", "chunk_index").join(_bounded(files), ["repo_name", "file_path"])
    nth = F.row_number().over(Window.partitionBy("query_id", "repo_name", "file_path").orderBy("chunk_index", "chunk_id"))
    found = found.withColumn("_n", nth).where(F.col("_n") <= per_file)
    ranked = rank_by(found, top_k, F.asc("file_path"), F.asc("repo_name"), F.asc("chunk_index"), F.asc("chunk_id"))
    return ranked.select("query_id", "chunk_id", F.lit(score).alias("score"), "rank")
