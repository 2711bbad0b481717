"""The training-data pipeline: documents in, packed sequences out, in five stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, scratch, shingles, simhash, substrings, toxicity
from tessera.llm.queries import cleanliness, table, tokenizer_path, toxicity_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_SCOPE = "pipeline"


def _stage(f):
    """What a stage keeps in the shared folder goes when the next one begins: its result is written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark, _SCOPE)
        scratch.tidy(spark)
        with scratch.scope(_SCOPE):
            return f(spark, docs, sf_dir)

    return run


@_stage
def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    kept = toxicity.score(docs.select(*COLUMNS), model, "_score").where("_score < 0.7").select(*COLUMNS)
    return scratch.keep(kept, "not-toxic")  # here, so that the texts go to Python in small batches


@_stage
def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once; without any id, one document.

    Near duplicates are texts whose SimHash fingerprints differ in at most 3 bits, or whose five-word
    shingle sets have a Jaccard similarity of 0.8 or more; a group holds all that such links connect.
    """
    found = simhash.near_duplicates(docs, more_links=shingles.copy_links)
    # of rows with one id the least hash of a text stays
    each = found.groupBy("root", "doc_id", "row").agg(F.count("*").alias("_n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "_n")).alias("s")
    stay = scratch.keep(each.groupBy("root").agg(least).select("s.doc_id", "s.row", "s._n"), "stay")
    ids = stay.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    kept = docs.select(*COLUMNS).withColumn("_h", F.xxhash64("text")).join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_row")), "left_semi")
    if stay.where("_n > 1").isEmpty():
        return kept.select(*COLUMNS)
    again = stay.where("_n > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_row"))
    return kept.join(again, same, "left_anti").select(*COLUMNS).unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_h"]).select(*COLUMNS))


@_stage
def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that an earlier document's windows hold go; a document that loses none keeps its text as it is."""
    return substrings.cut_texts(docs.select(*COLUMNS))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    out = mixing.mix(docs.select(*COLUMNS), mixing.word_count(F.col("text")), cleanliness(), keep=("text", "lang", "source", "n_chars"))
    return out.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_dedup", near_duplicates_out),
    ("substring_dedup", repeats_out),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on the table documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = scratch.keep(out, f"stage-{name}")
        if before is not None:
            scratch.forget(before)
        before = docs
    return docs


#: SQL has no tokenizer, no XXH64 and no online learning; tests hold the stages against brute force.
ORACLE_SQL = None
