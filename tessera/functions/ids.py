"""Stable identifiers: SHA-256 of parts joined by '::', as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(*parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("::", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def repo_id(name) -> Column:
    return _joined(name)


def file_id(repo, path) -> Column:
    return _joined(repo, path)


def chunk_id(repo, path, index) -> Column:
    return _joined(repo, path, index)


def class_id(repo, path, name) -> Column:
    return _joined(repo, path, F.lit("class"), name)


def function_id(repo, path, qualified_name) -> Column:
    return _joined(repo, path, F.lit("function"), qualified_name)


def endpoint_id(repo, path, method, pattern) -> Column:
    return _joined(repo, path, F.lit("endpoint"), method, pattern)


def content_hash(text) -> Column:
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)
