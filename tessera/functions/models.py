"""Pluggable models with deterministic offline defaults: embedder, reranker, curator, answerer, judge.

A model that is a Python object goes through :func:`guarded`: it is loaded once in a worker, and rows for which it
fails get null, which callers take as "unavailable".

An embedder is a Column -> Column function giving array<double>; null means it is
unavailable, and callers degrade (a cache miss, no drift verdict).
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .text import code_tokens

log = logging.getLogger(__name__)
Embedder = Callable[[Column], Column]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def hashing_embedder(size: int = 64) -> Embedder:
    """Signed feature hashing of code tokens, normalised: no model file, no Python worker."""

    def embed(text: Column) -> Column:
        # a token is a slot and a sign, as one number; sorted, equal numbers are runs, whose lengths are their counts
        numbers = F.transform(code_tokens(text), lambda t: F.xxhash64(t))
        numbers = F.array_sort(F.transform(numbers, lambda h: (F.pmod(h, F.lit(size)) * 2 + F.shiftrightunsigned(h, 63)).cast("int")))

        def counted(s: Column) -> Column:
            last = lambda i: (i == F.size(s) - 1) | (F.get(s, i + 1) != F.get(s, i))
            ends = F.filter(F.transform(s, lambda _, i: F.when(last(i), i + 1).otherwise(F.lit(0))), lambda e: e > 0)
            return _let(ends, lambda e: F.map_from_arrays(F.transform(e, lambda x: F.get(s, x - 1)), F.transform(e, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1)))))

        of = lambda m, k: F.coalesce(F.try_element_at(m, k.cast("int")), F.lit(0))
        slots = F.sequence(F.lit(0), F.lit(size - 1))
        raw = _let(numbers, lambda s: _let(counted(s), lambda m: F.transform(slots, lambda i: (of(m, i * 2) - of(m, i * 2 + 1)).cast("double"))))
        scaled = lambda r: _let(F.sqrt(F.aggregate(r, F.lit(0.0), lambda t, x: t + x * x)), lambda n: F.transform(r, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
        return _let(raw, scaled)

    return embed


def overlap_reranker(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has."""
    q = F.array_distinct(code_tokens(query))
    t = code_tokens(F.substring(text, 1, 2000))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def extractive_answer(question: Column, summary: Column) -> Column:
    """The first 600 characters of the context: a stand-in for an answering model."""
    return F.substring(summary, 1, 600)


def guarded(load: Callable[[], Callable[..., list]], result: str, retries: int = 1, batch_rows: int = 64) -> Callable[..., Column]:
    """A model as a function of columns: load() gives a function of lists, one for each column, that returns a list.

    The model is loaded once in a Python worker.  A batch for which it fails is tried again, then row by row;
    a row that fails by itself, one with a null, and all rows where the model can't be loaded, get null.
    """

    def once(model: Callable[..., list], rows: list[tuple]) -> list:
        out = list(model(*map(list, zip(*rows, strict=True))))
        if len(out) != len(rows):
            raise ValueError(f"the model gave {len(out)} results for {len(rows)} rows")
        return out

    def safely(model: Callable[..., list], rows: list[tuple]) -> list:
        for _ in range(1 + retries):
            try:
                return once(model, rows)
            except Exception:
                log.warning("a model failed on %d rows", len(rows), exc_info=True)
        return [None] if len(rows) == 1 else [x for row in rows for x in safely(model, [row])]

    def score(batches: Iterator, kind: pa.DataType) -> Iterator:
        try:
            model = load()
        except Exception:
            log.warning("a model could not be loaded", exc_info=True)
            model = None
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
            known = [k for k, r in enumerate(rows) if None not in r]
            out: list = [None] * len(rows)
            for a in range(0, len(known) if model else 0, batch_rows):
                some = known[a : a + batch_rows]
                for k, x in zip(some, safely(model, [rows[k] for k in some]), strict=True):
                    out[k] = x
            yield pa.array(out, kind)

    def call(*columns: Column) -> Column:
        kind = to_arrow_type(T.StructType.fromDDL(f"x {result}")["x"].dataType)

        def one(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return score(column, kind)

        def several(given: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            return score(given, kind)

        return F.arrow_udf(one if len(columns) == 1 else several, result)(*columns)

    return call
