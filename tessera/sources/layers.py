"""Stored tables that change by groups of rows, all of them under one manifest.

A table has a base, cut into buckets by a hash of some columns, and layers.  A layer
holds the new rows of the groups that a change touched (a file's rows, a key's row) and
a mark for each such group, so a group without rows is one that went.  A reader takes
each group from the newest layer that marks it and the rest from the base; only the
layers, which are small, are compared.  A change writes bytes in proportion to what it
touches.  Where a bucket's layers have grown to a share of its base, that bucket alone
is written anew, so that each row is rewritten a bounded number of times for each one
that comes.

A manifest is a file with a number that names the base and layers of every table.  It
appears by one rename that doesn't replace: of two changes that began from one manifest
the second fails and has changed nothing.  A reader keeps to the manifest that it has
opened; the files of the one before the newest stay for such readers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A bucket is written anew when its layers have this share of its base's rows, and so many at least.
SHARE, LEAST_ROWS = 0.25, 1000
#: Tables that are written at once.
SIDE_BY_SIDE = 6
#: Layers that a table has at most.
MOST_LAYERS = 16
#: Groups in a bucket, about, when a table is written whole, and buckets at most.
GROUPS_A_BUCKET, MOST_BUCKETS = 4096, 256
#: Groups that a task writes at most, about: above MOST_BUCKETS tasks each gets more of them, up to this.
GROUPS_A_TASK = 262_144


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


@dataclass(frozen=True)
class Layout:
    schema: str
    #: Columns, never null, whose rows change together.
    group: tuple[str, ...]
    #: Columns whose hash tells a row's bucket.
    bucket: tuple[str, ...]
    #: How many buckets; by default in proportion to the groups.
    buckets: int | None = None

    @property
    def columns(self) -> list[str]:
        return T.StructType.fromDDL(self.schema).names


class Snapshot:
    """The tables of one manifest."""

    def __init__(self, store: Store, number: int, tables: dict):
        self.store, self.number, self._tables = store, number, tables

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def has(self, name: str) -> bool:
        return name in self._tables

    def table(self, name: str, buckets: list[int] | None = None, with_bucket: str | None = None) -> DataFrame:
        """The table's rows, or those of some buckets; with_bucket: a column for the bucket's number."""
        layout, entry = self.store.layouts[name], self._tables.get(name)
        shown = [*layout.columns, *([F.col("_bucket").alias(with_bucket)] if with_bucket else [])]
        if entry is None:
            return self.spark.createDataFrame([], f"{layout.schema}, _bucket int").select(*shown)
        if not entry["layers"]:
            return self._base(layout, entry, buckets).select(*shown)
        # only buckets that a layer touches are compared with it
        touched = self._touched(layout, entry)
        own = [int(b) for b in entry["base"] if buckets is None or int(b) in buckets]
        base, rest = self._base(layout, entry, [b for b in own if b in touched]), [b for b in own if b not in touched]
        group = list(layout.group)
        layered = self._layers(layout, entry)
        marks = layered.where("_mark").groupBy(*group).agg(F.max("_layer").alias("_last"))
        folded = F.array(*[F.lit(entry["folded"].get(str(b), 0)) for b in range(entry["n"])])[F.col("_bucket")]
        stay = base.join(marks, group, "left").where(F.col("_last").isNull() | (F.col("_last") <= folded))
        fresh = layered.where("not _mark").join(marks, group).where((F.col("_layer") == F.col("_last")) & (F.col("_layer") > folded))
        if buckets is not None:
            fresh = fresh.where(F.col("_bucket").isin(buckets))
        shows = stay.select(*shown).unionByName(fresh.select(*shown))
        return self._base(layout, entry, rest).select(*shown).unionByName(shows) if rest else shows

    def _touched(self, layout: Layout, entry: dict) -> set[int]:
        """The buckets whose base rows a layer may stand above."""
        if not set(layout.bucket) <= set(layout.group):  # a mark's group may have rows in any bucket
            return set(range(entry["n"]))
        return {int(b) for k, _, rows in entry["layers"] for b in rows if k > entry["folded"].get(b, 0)}

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows that agree with a row of keys in its columns; where these tell the bucket, only such buckets are read."""
        layout, entry, on = self.store.layouts[name], self._tables.get(name), keys.columns
        keys, buckets = keys.distinct(), None
        if entry is not None and set(layout.bucket) <= set(on):
            # at most as many numbers as there are buckets
            buckets = [r[0] for r in keys.select(_bucket(layout, entry["n"]).alias("b")).distinct().collect()]
        return self.table(name, buckets).join(keys, on, "left_semi").select(*layout.columns)

    def _base(self, layout: Layout, entry: dict, buckets: list[int] | None) -> DataFrame:
        by_dir: dict[str, list[str]] = {}
        for b, (at, _) in entry["base"].items():
            if buckets is None or int(b) in buckets:
                by_dir.setdefault(at, []).append(b)
        schema = f"{layout.schema}, _bucket int"
        read = [self.spark.read.schema(schema).option("basePath", f"{self.store.path}/{at}").parquet(*[f"{self.store.path}/{at}/_bucket={b}" for b in own]) for at, own in by_dir.items()]
        return reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], schema)

    def _layers(self, layout: Layout, entry: dict) -> DataFrame:
        read = [self.spark.read.schema(f"{layout.schema}, _mark boolean").parquet(f"{self.store.path}/{at}").withColumn("_layer", F.lit(k)) for k, at, _ in entry["layers"]]
        return reduce(DataFrame.unionByName, read).withColumn("_bucket", _bucket(layout, entry["n"]))

    def paths(self) -> set[str]:
        return {at for e in self._tables.values() for at in (*(d for d, _ in e["base"].values()), *(d for _, d, _ in e["layers"]))}


def _bucket(layout: Layout, n: int) -> Column:
    return F.pmod(F.xxhash64(*layout.bucket), F.lit(n)).cast("int")


class Change(Snapshot):
    """A snapshot that takes new rows and shows them; others see them when it is committed."""

    def __init__(self, store: Store, number: int, tables: dict):
        super().__init__(store, number, json.loads(json.dumps(tables)))
        self._made: list[str] = []

    def _place(self, name: str) -> str:
        self._made.append(f"{name}/{uuid.uuid4().hex}")
        return self._made[-1]

    def replace(self, name: str, rows: DataFrame, groups: int = 0, sized: DataFrame | None = None) -> None:
        """The table's whole content; groups: about how many there are, which sets the number of buckets.

        sized: about the same rows, if they are cheap to count; where a bucket holds many groups of one value, each is then dealt by its own size.
        """
        layout = self.store.layouts[name]
        n = layout.buckets or min(MOST_BUCKETS, -(-groups // GROUPS_A_BUCKET) or 1)
        sizes = dict.fromkeys(range(n), -(-groups // n))
        if sized is not None and set(layout.group) - set(layout.bucket):
            sizes = dict(sized.groupBy(_bucket(layout, n)).count().collect())  # a row for each bucket
        entry = {"n": n, "base": {}, "folded": {}, "layers": [], "last": 0}
        self._write_base(entry, layout, rows.select(*layout.columns, _bucket(layout, n).alias("_bucket")), name, sizes)
        self._tables[name] = entry

    def _write_base(self, entry: dict, layout: Layout, rows: DataFrame, name: str, sizes: dict[int, int]) -> None:
        """sizes: about how many groups a bucket gets; tasks share a bucket, so that none has more than a bounded number of them."""
        at = self._place(name)
        most = min(GROUPS_A_TASK, max(GROUPS_A_BUCKET, sum(sizes.values()) // MOST_BUCKETS))
        pieces = [-(-sizes.get(b, 0) // most) or 1 for b in range(entry["n"])]
        before = [0, *accumulate(pieces)]
        of = lambda numbers: F.array(*[F.lit(k) for k in numbers])[F.col("_bucket")]
        # not the hash that tells the bucket, of which a bucket has few remainders
        piece = F.pmod(F.hash(*layout.group), of(pieces)) if max(pieces) > 1 else F.lit(0)
        rows.repartitionById(before[-1], of(before) + piece).write.partitionBy("_bucket").parquet(f"{self.store.path}/{at}")
        written = self.spark.read.schema(f"{layout.schema}, _bucket int").parquet(f"{self.store.path}/{at}")
        counted = [(0, written.count())] if entry["n"] == 1 else written.groupBy("_bucket").count().collect()  # a row for each bucket
        entry["base"] |= {str(b): [at, k] for b, k in counted if k}

    def replace_groups(self, name: str, groups: DataFrame, rows: DataFrame) -> None:
        """The rows of the groups are now these; rows of other groups must not be among them."""
        layout, entry = self.store.layouts[name], self._tables.get(name)
        if entry is None:
            self.replace(name, rows, groups.distinct().count())
            return
        cols, at = layout.columns, self._place(name)
        kinds = {f.name: f.dataType for f in T.StructType.fromDDL(layout.schema)}
        marks = groups.select(*layout.group).distinct().select(*[F.col(c) if c in layout.group else F.lit(None).cast(kinds[c]).alias(c) for c in cols], F.lit(True).alias("_mark"))
        layer = rows.select(*cols, F.lit(False).alias("_mark")).unionByName(marks)
        layer.hint("rebalance").write.parquet(f"{self.store.path}/{at}")
        written = self.spark.read.schema(f"{layout.schema}, _mark boolean").parquet(f"{self.store.path}/{at}")
        n = written.count()
        if not n:
            return
        entry["last"] += 1
        if entry["n"] == 1:
            entry["layers"].append([entry["last"], at, {"0": n}])
            return
        by_bucket = set(layout.bucket) <= set(layout.group)  # marks then have a bucket of their own, too
        counted = written.select(_bucket(layout, entry["n"]).alias("b"), "_mark").groupBy("b").agg(F.count("*").alias("n"), F.sum(F.when(F.col("_mark"), 1).otherwise(0)).alias("m")).collect()
        entry["layers"].append([entry["last"], at, {str(r["b"]): r["n"] if by_bucket else r["n"] - r["m"] for r in counted}])

    def together(self, *steps: Callable[[], None]) -> None:
        """Runs steps that change different tables side by side: each is a few small jobs."""
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(step)) for step in steps]:
                done.result()

    def _fold(self, name: str) -> None:
        """Writes the buckets anew that have much in layers."""
        layout, entry = self.store.layouts[name], self._tables[name]
        in_layers: dict[str, int] = {}
        for k, _, rows in entry["layers"]:
            for b, n in rows.items():
                in_layers[b] = in_layers.get(b, 0) + n * (k > entry["folded"].get(b, 0))
        every = range(entry["n"]) if len(entry["layers"]) > MOST_LAYERS else ()
        due = sorted({int(b) for b, n in in_layers.items() if n and n >= max(LEAST_ROWS, SHARE * entry["base"].get(b, [None, 0])[1])} | set(every))
        if not due:
            return
        merged = self.table(name, due, "_b").withColumnRenamed("_b", "_bucket")
        sizes = {b: entry["base"].pop(str(b), [None, 0])[1] + in_layers.get(str(b), 0) for b in due}
        self._write_base(entry, layout, merged, name, sizes)
        entry["folded"] |= {str(b): entry["last"] for b in due}
        least = min(entry["folded"].get(str(b), 0) for b in range(entry["n"]))
        entry["layers"] = [x for x in entry["layers"] if x[0] > least]

    def commit(self) -> int:
        """Shows the change to all, or raises :class:`Conflict` and changes nothing."""
        try:
            self.together(*[partial(self._fold, name) for name, entry in self._tables.items() if entry["layers"]])
            self.store._publish(self.number + 1, self._tables)
        except BaseException:
            self.abort()
            raise
        keep = self.paths()
        for at in set(self._made) - keep:  # layers that this change has folded itself
            self.store._delete(at)
        self._made = []
        self.store._tidy(self.number + 1)
        return self.number + 1

    def abort(self) -> None:
        """Deletes what the change has written."""
        for at in self._made:
            self.store._delete(at)
        self._made = []


class Store:
    """Tables of known layouts below one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, layouts: dict[str, Layout]):
        self.spark, self.path, self.layouts = spark, path.rstrip("/"), layouts

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        fs, at = self._fs()
        if not fs.exists(at):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(at))
        return sorted(int(n[10:-5]) for n in names if n.startswith("_manifest-") and n.endswith(".json"))

    def _load(self, number: int) -> dict:
        fs, _ = self._fs()
        stream = fs.open(self._path(f"_manifest-{number:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self._numbers())

    def snapshot(self) -> Snapshot:
        """The newest manifest's tables."""
        n = (self._numbers() or [0])[-1]
        return Snapshot(self, n, self._load(n) if n else {})

    def begin(self) -> Change:
        s = self.snapshot()
        return Change(self, s.number, s._tables)

    def _publish(self, number: int, tables: dict) -> None:
        fs, root = self._fs()
        fs.mkdirs(root)
        fresh = self._path(f"_new.{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fs.makeQualified(fresh), fs.makeQualified(self._path(f"_manifest-{number:09d}.json")), never)
        except Exception as e:
            fs.delete(fresh, False)
            if number in self._numbers():
                raise Conflict(f"manifest {number} of {self.path} was committed by another change") from e
            raise

    def _delete(self, name: str) -> None:
        fs, _ = self._fs()
        fs.delete(self._path(name), True)

    def _tidy(self, newest: int) -> None:
        """Deletes manifests before the last two, and what only they name."""
        old = [n for n in self._numbers() if n < newest - 1]
        if not old:
            return
        keep = set().union(*(Snapshot(self, n, self._load(n)).paths() for n in self._numbers() if n >= newest - 1))
        for n in old:
            try:
                gone = Snapshot(self, n, self._load(n)).paths() - keep
            except Py4JJavaError:  # another change has just done it
                continue
            for at in gone:
                self._delete(at)
            self._delete(f"_manifest-{n:09d}.json")
