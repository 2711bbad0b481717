"""Operator 10: mixing sources to target weights by weighted sampling with exponential keys. DataFrame functions only.

Targets: sources share a budget by weight; none gets more than ``most_epochs`` times
its own size, and what it can't take goes to the others by weight (water filling, in
closed form over the sources ordered by where they fill up).

A source with target T and size S gives ``floor(T / S)`` complete epochs of all its
documents, then a fraction: documents in order of exponential keys, ``-ln(u) / weight``
(Efraimidis and Spirakis), until their sizes reach what is left.  u is a hash of the
document's id and its text's length, so that reruns agree.

The order within a source is never made in one task.  A key's place (``key / (1 + key)``
in 48 bits) has four digits of twelve bits.  Sizes are summed by (source, first digit)
and prefix sums find the digit where the budget ends; where more than ``edge_rows``
rows of a source share it, the next digit is summed for these rows alone, and so on.
The rows of the last edge, ids and keys only, are put in order to find the key and id
at which the source is cut; every row then compares itself with its source's cut.

Cases: a document whose weight is null, NaN, 0 or less comes in complete epochs and never in
the fraction, so a source that has too few others falls short of its target by what they lack;
a null source is a source, the last; null texts have size 0; documents of size 0
are taken 0 words; equal rows are taken apart by nothing and share one fate, so a
source of one repeated text may miss its target by that group; sources without words
have target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Digits of a key's place, and the bits of each.
DIGITS, BITS = 4, 12
#: Sources up to which their small table is broadcast.
MOST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII blanks."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.length(F.replace(F.regexp_replace(flat, "[^ ]+", "x"), F.lit(" "), F.lit(""))).cast("long")


def uniform(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """A number above 0 and below 1 for each document: 52 bits of a SHA-256 of its id, its text's length and the seed."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.length(text).cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.sha2(name, 256), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def targets(sources: DataFrame, share: float = 1.5, most_epochs: float = 2.0) -> DataFrame:
    """(source, source_size, target) of (source, source_size, weight): one row for each source, so its windows are small."""
    cap = F.col("source_size") * F.lit(most_epochs)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    filled = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.withColumn("cap", cap).withColumn("budget", F.sum("source_size").over(every) * F.lit(share)).withColumn("weights", F.sum("weight").over(every))
    # the water level if all sources that fill up earlier have reached their caps
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(filled), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("weight").over(filled), F.lit(0)))
    level = (F.col("budget") - F.col("full")) / (F.col("weights") - F.col("gone"))
    # the first source in order that its share doesn't fill sets the level for itself and all after it
    first = F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("place"), level.alias("level")))).over(every)
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("level", first["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def ranked_weights(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, source_size, weight): weights go round by the sources' order, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row for each source
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")))


def mix(
    docs: DataFrame,
    size: Column,
    weight: Column,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most_epochs: float = 2.0,
    seed: int = 0,
    keep: tuple[str, ...] = (),
    edge_rows: int = 100_000,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row, and the columns to keep.

    size and weight are expressions of the row.  A kept column with the name of one of the others is given as kept_<name>.
    """
    weight = weight.cast("double")
    key = -F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / F.when((weight > 0) & ~F.isnan(weight), weight)
    keep = tuple(c for c in keep if c not in ("doc_id", "source"))
    # kept columns go by number meanwhile, so that no name clashes
    held = [f"_keep{k}" for k in range(len(keep))]
    rows = docs.select("doc_id", "source", *[F.col(c).alias(h) for c, h in zip(keep, held, strict=True)], size.cast("long").alias("size"), key.alias("key"))
    place = F.floor(F.col("key") / (F.col("key") + 1.0) * float(1 << DIGITS * BITS)).cast("long")
    rows = scratch.keep(rows.withColumn("place", place), "sizes")
    digit = lambda level: F.shiftright("place", BITS * (DIGITS - 1 - level))  # noqa: E731  the first level + 1 digits
    sums = lambda some, level: some.groupBy("source", digit(level).alias("digits")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    with scratch.brief(docs.sparkSession):
        by_digit = scratch.keep(sums(rows, 0), "digits")
        goals = targets(ranked_weights(by_digit.groupBy("source").agg(F.sum("size").alias("source_size")), weights), share, most_epochs)
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        goals = goals.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        goals = scratch.keep(goals, "targets")

        # the digits at which each source's budget ends, and the words before them
        edges = _edges(by_digit.where("digits is not null").join(_small(_named(goals.select("source", "rest"), "s")), F.col("source").eqNullSafe(F.col("s_source"))), F.lit(0), "s_rest")
        found = None
        for level in range(DIGITS):
            edges = scratch.keep(edges.withColumn("level", F.lit(level)), "edges")
            final = (F.col("n") <= edge_rows) | F.lit(level == DIGITS - 1)
            found = edges.where(final) if found is None else found.unionByName(edges.where(final))
            wide = edges.where(~final)
            if level == DIGITS - 1 or wide.isEmpty():
                break
            inside = rows.select("source", "place", "size").join(_small(_named(wide, "s")), F.col("source").eqNullSafe(F.col("s_source")) & (digit(level) == F.col("s_digits")))
            finer = inside.groupBy("source", "s_before", "s_rest", digit(level + 1).alias("digits")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
            edges = _edges(finer, F.col("s_before"), "s_rest")
        same = F.expr(f"shiftright(place, cast({BITS} * ({DIGITS - 1} - s_level) as int)) = s_digits")
        close = rows.select("source", "doc_id", "key", "place", "size").join(_small(_named(found, "s")), F.col("source").eqNullSafe(F.col("s_source")) & same)
        # equal ids with equal keys are one entry: a group of copies is a row
        close = close.groupBy("source", "key", "doc_id", "size", "s_before", "s_rest").agg(F.count("*").alias("n"))
        upto = F.col("s_before") + F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("source").orderBy("key", "doc_id"))  # edge_rows rows of a source, or rows of one key
        # the document that the budget ends in is taken if that comes nearer
        chosen = close.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2.0 <= F.col("s_rest"))
        id_ = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
        cut = chosen.groupBy("source").agg(F.max(F.struct("key", id_("doc_id").alias("id"), "upto")).alias("cut"))
        first = found.select("source", F.col("digits"), F.col("level"))
        plan = goals.join(_named(first, "f"), F.col("source").eqNullSafe(F.col("f_source")), "left").join(_named(cut, "c"), F.col("source").eqNullSafe(F.col("c_source")), "left")
        plan = scratch.keep(plan.select("source", "source_size", "target", "epochs", "rest", F.col("f_digits").alias("digits"), F.col("f_level").alias("level"), "c_cut.key", "c_cut.id", "c_cut.upto"), "plan", outer=True)

    joined = rows.join(_small(_named(plan, "p")), F.col("source").eqNullSafe(F.col("p_source")))
    own = F.expr(f"shiftright(place, cast({BITS} * ({DIGITS - 1} - p_level) as int))")
    here = (F.col("key") < F.col("p_key")) | ((F.col("key") == F.col("p_key")) & ((id_("doc_id") < F.col("p_id")) | ((id_("doc_id") == F.col("p_id")) & (F.col("p_upto") - F.col("size") / 2.0 <= F.col("p_rest")))))
    taken = F.when(F.col("p_level").isNull(), F.lit(False)).when(own != F.col("p_digits"), own < F.col("p_digits")).otherwise(F.coalesce(here, F.lit(False)))
    copies = F.col("p_epochs") + F.when(taken, 1).otherwise(0)
    results = ("size", "source_size", "target", "copies", "taken")
    named = [F.col(h).alias(f"kept_{c}" if c in results else c) for c, h in zip(keep, held, strict=True)]
    out = joined.select("doc_id", "source", *named, "size", F.col("p_source_size").alias("source_size"), F.col("p_target").alias("target"), copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def _named(table: DataFrame, prefix: str) -> DataFrame:
    return table.select([F.col(c).alias(f"{prefix}_{c}") for c in table.columns])


def _edges(sums: DataFrame, base: Column, rest: str) -> DataFrame:
    """(source, digits, n, before, rest): the last digits of each source before which its budget isn't used up; one row for each of a source's digits goes in."""
    before = base + F.sum("size").over(Window.partitionBy("source").orderBy("digits")) - F.col("size")
    reached = sums.withColumn("before", before).where(F.col("before") < F.col(rest))
    last = reached.groupBy("source").agg(F.max(F.struct("digits", "n", "before", F.col(rest).alias("rest"))).alias("e"))
    return last.select("source", "e.*")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MOST_SOURCES else table
