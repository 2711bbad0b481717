"""Stored tables: versioned directories with an atomic pointer, JSON-lines readers and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTION = "id string, question string, expected_files array<string>, tags array<string>, difficulty string, notes string"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), keep_old: bool = False) -> str:
    """Writes a new version below ``path`` and then moves the pointer to it by a rename that replaces the old one.

    Readers see the old version or the new one, never a part; a failed write changes nothing.  The version
    before stays, for readers that have opened it; older ones go (none with ``keep_old``).
    """
    spark = df.sparkSession
    fs, root = _fs(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    old = _current(spark, path)
    df.write.partitionBy(*partition_by).parquet(f"{path}/{version}")
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_current.{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/_current")), replace)
    if not keep_old:
        for f in fs.listStatus(root):
            if f.getPath().getName().startswith("v-") and f.getPath().getName() not in (version, old):
                fs.delete(f.getPath(), True)
    return version


def _current(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, f"{path}/_current")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    return _current(spark, path) is not None


def open_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The published version; an empty table of the schema, or an error, where there is none."""
    version = _current(spark, path)
    if version is None:
        if schema is None:
            raise FileNotFoundError(f"no table at {path}; build the index first")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/{version}")  # one write made it: all files have one schema


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions from JSON lines; blank lines and '#' comments are skipped, broken ones raise with their number and text.

    The file is read whole into one row, as lines have numbers only there: it is a list of questions, not a data set.
    """
    whole = spark.read.text(path, wholetext=True)
    return parse_questions(whole.select(F.posexplode(F.split("value", "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1))


def parse_questions(lines: DataFrame) -> DataFrame:
    """Questions of lines (value, and line if numbers are known)."""
    lines = lines.where(F.trim("value") != "").where(~F.trim("value").startswith("#"))
    number = F.concat(F.lit("line "), "line", F.lit(": ")) if "line" in lines.columns else F.lit("")
    broken = F.try_parse_json("value").isNull()
    q = F.from_json("value", QUESTION)
    bad = lambda why: F.raise_error(F.concat(number, F.lit(f"{why}: "), F.substring("value", 1, 200))).cast("string")
    need = lambda k: F.when(broken, bad("invalid JSON")).when(q[k].isNull(), bad(f"missing {k}")).otherwise(q[k]).alias(k)
    empty = F.array().cast("array<string>")
    return lines.select(
        need("id"),
        need("question"),
        F.coalesce(q["expected_files"], empty).alias("expected_files"),
        F.coalesce(q["tags"], empty).alias("tags"),
        F.coalesce(q["difficulty"], F.lit("medium")).alias("difficulty"),
        F.coalesce(q["notes"], F.lit("")).alias("notes"),
    )


def append_traces(df: DataFrame, path: str) -> None:
    """One JSON line for each answered query."""
    df.write.mode("append").json(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Structured logs as written by :mod:`tessera.logs`."""
    return spark.read.schema("timestamp string, level string, logger string, message string, extra map<string,string>").json(path)
