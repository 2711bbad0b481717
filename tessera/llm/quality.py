"""Operator 3: quality rules with thresholds adapted to each language and source. DataFrame functions only.

Counts of each text come from one pass of built-in functions.  A mergeable quantile
sketch of each measure is kept for each (language, source): integers rounded down to
their seven leading bits and counted (a log-linear histogram), so that quantiles have
a relative error under 1/64, sketches merge by adding counts, and the same rows give
the same sketch in any order.  A group's sketch is a few hundred rows whatever its
size, and a hot group is partial sums.

A threshold is a fence set by the group's own quantiles: the upper one ``spread`` times
as far above a high quantile as that is above the reference quantile (median, or the
opposite quartile), plus a small tolerance in the measure's unit; word length has a lower
fence as well.  No constant stands in for a quantile.  A small group leans on the sketch
of its language by weight, not by a switch: its own rows are joined by ``prior_rows``
rows' worth of the language's sketch, and the language's by as much of all, so that a
group's own quantiles take over as it grows.  Thresholds join the rows by (language,
source): broadcast up to ``most_groups`` groups, else by a shuffle in which hot groups
are split.

Cases: a null text has no words and fails the base rules; null languages and sources
are groups of their own; equal rows get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WORDS = r"[^\x20\x09-\x0D]+"
_BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row's text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.translate(text, _BLANKS, " " * len(_BLANKS))
    df = docs.select(
        *keep,
        F.filter(F.split(blank, " "), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "").alias("_lines"),
        F.length(F.translate(text, _BLANKS + " ", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    rest = ", ".join(f"_hashes[i + {k}]" for k in range(1, WINDOW))
    windows = F.expr(f"transform(slice(_hashes, 1, greatest(size(_hashes) - {WINDOW - 1}, 0)), (h, i) -> xxhash64(h, {rest}))")
    df = df.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    # windows found again, in order of position: neighbours in the order of (hash, position) with equal hashes
    df = df.select("*", (F.size("_windows") > F.size(F.array_distinct("_windows"))).alias("_again"))
    df = df.withColumn("_sorted", F.when(F.col("_again"), F.expr("array_sort(transform(_windows, (h, i) -> struct(h as h, i as i)))")))
    df = df.withColumn("_at", F.expr("array_sort(transform(filter(_sorted, (x, k) -> (k > 0 and x.h = _sorted[greatest(k - 1, 0)].h) or (k < size(_sorted) - 1 and x.h = _sorted[least(k + 1, size(_sorted) - 1)].h)), x -> x.i))"))
    covered = F.expr(f"aggregate(_at, named_struct('n', 0, 'upto', 0), (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(a.upto, p), 'upto', p + {WINDOW}), a -> a.n)")
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


#: Measure -> (integer expression, percentile of the upper fence, percentile that it is measured from, spread, tolerance, is there a mirrored lower fence).
RULES = {
    "symbols": ("n_symbols * 10000 div greatest(word_chars, 1)", 90, 50, 2, 100, False),
    "dup_lines": ("n_dup_lines * 10000 div greatest(n_words, 1)", 95, 50, 2, 100, False),
    "repeats": ("n_repeat_words * 10000 div greatest(n_words, 1)", 95, 50, 2, 500, False),
    "word_length": ("word_chars * 1000 div greatest(n_words, 1)", 75, 25, 5, 0, True),
}


def sketch_bin(value: Column) -> Column:
    """The value rounded down to its seven leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    size = F.pow(F.lit(2), drop)
    return (F.floor(value / size) * size).cast("long")


def _lean(sketch: DataFrame, prior: DataFrame, by: list[str], on: list[str], prior_rows: int) -> DataFrame:
    """The sketches of the groups ``by``, in thousandths of a row, joined by prior_rows rows' worth of the sketch of the group ``on`` that each belongs to."""
    own = sketch.select(*by, "measure", "bin", (F.col("n") * 1000).alias("n"))
    total = prior.groupBy(*on, "measure").agg(F.sum("n").alias("of"))
    share = _same(prior, total, [*on, "measure"]).select(*on, "measure", "bin", F.expr(f"n * {1000 * prior_rows} div of").alias("n"))
    groups = sketch.select(*by).distinct()
    lent = _same(groups, share, on) if on else groups.crossJoin(share)  # a sketch for each group: a few hundred rows
    return own.unionByName(lent.select(*by, "measure", "bin", "n")).groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join by columns in which null equals null."""
    other = right.withColumnsRenamed({c: "_" + c for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col("_" + c))
    return left.join(other, same).drop(*["_" + c for c in on])


def thresholds(rows: DataFrame, prior_rows: int = 50) -> DataFrame:
    """One row for each (lang, source): upper and lower bounds of every measure, from merged sketches."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(r[0]).cast("long").alias("value")) for m, r in RULES.items()])
    fine = rows.select("lang", "source", F.explode(pairs).alias("m")).select("lang", "source", "m.measure", sketch_bin(F.col("m.value")).alias("bin")).groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))
    fine = scratch.keep(fine, "sketches")
    whole = fine.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    by_lang = scratch.keep(_lean(fine.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n")), whole, ["lang"], [], prior_rows), "language-sketches")
    sketch = _lean(fine, by_lang, ["lang", "source"], ["lang"], prior_rows)
    part = Window.partitionBy("lang", "source", "measure")
    ranked = sketch.select("lang", "source", "measure", "bin", F.sum("n").over(part.orderBy("bin")).alias("upto"), F.sum("n").over(part).alias("total"))
    levels = sorted({p for r in RULES.values() for p in r[1:3]})
    marks = ranked.groupBy("lang", "source", "measure").agg(*[F.min(F.expr(f"if(upto * 100 >= total * {p}, bin, null)")).alias(f"p{p}") for p in levels])
    fences = []
    for m, (_, high, base, spread, tolerance, lower) in RULES.items():
        one = lambda e, m=m: F.max(F.when(F.col("measure") == m, F.expr(e))).cast("long")
        fences.append(one(f"p{high} + {spread} * (p{high} - p{base}) + {tolerance}").alias(f"{m}_high"))
        if lower:
            fences.append(one(f"p{base} - {spread} * (p{high} - p{base}) - {tolerance}").alias(f"{m}_low"))
    return marks.groupBy("lang", "source").agg(*fences)


def judge(docs: DataFrame, prior_rows: int = 50, most_groups: int = 10_000) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept of each row."""
    rows = scratch.keep(measures(docs, "doc_id", "lang", "source"), "measures")
    with scratch.brief(docs.sparkSession):
        bounds = scratch.keep(thresholds(rows, prior_rows), "thresholds", outer=True)
    other = bounds.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    if bounds.count() <= most_groups:
        other = F.broadcast(other)
    joined = rows.join(other, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    sound = F.lit(True)
    for m, (e, *_, lower) in RULES.items():
        sound = sound & (F.expr(e) <= F.col(f"{m}_high"))
        if lower:
            sound = sound & (F.expr(e) >= F.col(f"{m}_low"))
    return joined.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & sound).alias("kept"))
