"""Text functions: code tokens, entities, paths, call-site patterns, JSON recovery. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_tokens(text) -> Column:
    """Lower-cased tokens of two or more characters; camelCase and acronyms are parted."""
    parted = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"([a-z])([A-Z])", "$1 $2")
    parted = F.regexp_replace(parted, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.regexp_extract_all(parted, F.lit(r"[a-zA-Z][a-zA-Z0-9]+|[0-9]{2,}"), 0), F.lower)


def text_entities(text) -> Column:
    """Names that a question mentions: CamelCase, snake_case and URL paths; distinct and sorted."""
    t = F.coalesce(_col(text), F.lit(""))
    camel = F.regexp_extract_all(t, F.lit(r"\b([A-Z][a-zA-Z0-9]{2,})\b"), 1)
    snake = F.filter(F.regexp_extract_all(t, F.lit(r"\b([a-z][a-z0-9_]{3,})\b"), 1), lambda x: F.contains(x, F.lit("_")))
    paths = F.regexp_extract_all(t, F.lit(r"(/[a-zA-Z0-9_/-]+)"), 1)
    return F.array_sort(F.array_distinct(F.concat(camel, snake, paths)))


def basename(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def suffix(path) -> Column:
    """The last dot and what follows, lower-cased; empty for dot files and names without a dot."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def parent(path) -> Column:
    """The directory of a path, '' for none."""
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def url_path(url) -> Column:
    """Path of an absolute URL or of a rooted path; null for anything else, '' and '/'."""
    u = _col(url)
    absolute = F.regexp_extract(u, r"^https?://[^/?#]*([^?#]*)", 1)
    rooted = F.regexp_extract(u, r"^(/[^?#]*)", 1)
    path = F.when(u.rlike(r"^https?://"), absolute).when(u.startswith("/"), rooted)
    return F.when(~path.isin("", "/"), path)


def json_object(raw) -> Column:
    """The JSON object in a model's answer: in a code fence, in backticks, or between the outermost braces; null if none parses."""
    r = _col(raw)
    tries = [F.regexp_extract(r, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(r, r"(?s)`([^`]*)`", 1), F.regexp_extract(r, r"(?s)(\{.*\})", 1), r]
    return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull() & F.trim(t).startswith("{"), F.trim(t)) for t in tries])


def judge_scores(raw) -> Column:
    """Struct of faithfulness, completeness, relevance (3.0 where missing) and explanation; 'parse_failed' where nothing parses."""
    found = json_object(raw)
    parsed = F.try_parse_json(found)
    score = lambda k: F.when(found.isNull(), F.lit(3.0)).otherwise(F.coalesce(F.try_variant_get(parsed, f"$.{k}", "double"), F.lit(3.0)))
    why = F.when(found.isNull(), F.lit("parse_failed")).otherwise(F.coalesce(F.try_variant_get(parsed, "$.explanation", "string"), F.lit("")))
    return F.struct(*[score(k).alias(k) for k in ("faithfulness", "completeness", "relevance")], why.alias("explanation"))


def judge_mean(scores) -> Column:
    s = _col(scores)
    return (s["faithfulness"] + s["completeness"] + s["relevance"]) / 3


def file_recall(expected, retrieved) -> Column:
    """Share of expected base names among the retrieved ones; 1 where nothing is expected."""
    names = lambda c: F.array_distinct(F.transform(F.coalesce(_col(c), F.array().cast("array<string>")), basename))
    e, r = names(expected), names(retrieved)
    return F.when(F.size(e) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(e, r)) / F.size(e))
