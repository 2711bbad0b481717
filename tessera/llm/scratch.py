"""Intermediate tables and files in the folder that the whole cluster shares.

The folder is the session's ``spark.checkpoint.dir``; where that is unset and the
master is local (tests, a single machine) it is a folder of this process's own, and on
a cluster an error.  Tables written here
cut lineage, survive lost executors and are read again without recomputation.  They
go when :func:`release` is called for their scope, or when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[str] = ["session"]
_PATHS: dict[str, list[str]] = {}
_HOOKED: set[int] = set()
_OWN: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder, as a URI or path."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "own" not in _OWN:  # one machine, one process
        _OWN["own"] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN["own"]


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def place(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A new path below the shared folder; outer: it belongs to the scope around the present one."""
    if id(spark._jsc) not in _HOOKED:
        _HOOKED.add(id(spark._jsc))
        atexit.register(lambda: [release(spark, s) for s in list(_PATHS)])
    fs, at = _filesystem(spark, root(spark))
    path = f"{fs.makeQualified(at).toString().rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(_SCOPES[-2 if outer else -1], []).append(path)
    return path


def folder(spark: SparkSession, name: str) -> str:
    """A new, existing folder for files of our own."""
    path = place(spark, name)
    fs, at = _filesystem(spark, path)
    fs.mkdirs(at)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: An Arrow batch is held whole on either side of the pipe, so its bytes are bounded while a table is written.
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting for a while; what it was afterwards."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Arrow batches of 4 MB and ``rows`` rows at most, for the jobs that run inside."""
    with setting(spark, _BYTES, "4m"), setting(spark, _ROWS, str(rows)) if rows else contextlib.nullcontext():
        yield


def keep(df: DataFrame, name: str, rows: int | None = None, outer: bool = False) -> DataFrame:
    """Writes the rows below the shared folder and returns the table read back; rows: most rows of an Arrow batch meanwhile.

    Once the table is written nothing needs the shuffle files of the plan, and Spark is told to delete them at once.
    """
    spark = df.sparkSession
    path = place(spark, name, outer)
    with setting(spark, _CLEANUP, "true"), small_batches(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        fs, at = _filesystem(spark, path)
        fs.delete(at, True)


def forget(table: DataFrame) -> None:
    """Deletes a table that :func:`keep` returned."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if "/tessera/" in path:
            drop(table.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """What is made inside belongs to ``name``."""
    _SCOPES.append(name)
    try:
        yield
    finally:
        _SCOPES.pop()


@contextlib.contextmanager
def brief(spark: SparkSession) -> Iterator[None]:
    """Tables made inside go at its end, but those kept with ``outer``; what reads them must be written by then."""
    name = uuid.uuid4().hex
    try:
        with scope(name):
            yield
    finally:
        release(spark, name)


def release(spark: SparkSession, name: str) -> None:
    """Deletes what was made in the scope; results that read it must be written before."""
    for path in _PATHS.pop(name, []):
        drop(spark, path)
