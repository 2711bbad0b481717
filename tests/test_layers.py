import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import layers
from tessera.sources.layers import Conflict, Layout, Store

LAYOUTS = {
    "rows": Layout("k string, part long, v string, n array<long>", ("k",), ("k",)),
    "words": Layout("word string, k string", ("k",), ("word",), 8),
}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), LAYOUTS)


def frame(spark, rows):
    return spark.createDataFrame(rows, LAYOUTS["rows"].schema)


def keys(spark, some):
    return spark.createDataFrame([(k,) for k in some], "k string")


def content(snapshot, name="rows", **how):
    return sorted(tuple(r) for r in snapshot.table(name, **how).collect())


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_changes_against_a_dictionary(spark, store, monkeypatch):
    """Random changes, with several layers and buckets folded on the way; every manifest shows what it should."""
    monkeypatch.setattr(layers, "GROUPS_A_BUCKET", 10)
    monkeypatch.setattr(layers, "LEAST_ROWS", 4)
    rnd, want = random.Random(3), {}
    for step in range(5):
        change = store.begin()
        touched = {f"k{rnd.randrange(60)}" for _ in range(40 if step == 0 else rnd.choice([1, 3, 20]))}
        new = {k: [(k, p, f"{step}-{p}", [step, p]) for p in range(rnd.randrange(0, 4))] for k in touched}
        want = {k: v for k, v in {**want, **new}.items() if v}
        rows = [r for v in new.values() for r in v]
        if step == 0:
            change.replace("rows", frame(spark, rows), groups=60)
            assert change._tables["rows"]["n"] == 6
        else:
            change.replace_groups("rows", keys(spark, touched), frame(spark, rows))
        given = [(f"w{r[1]}", r[0]) for r in rows]
        change.replace_groups("words", keys(spark, touched), spark.createDataFrame(given, "word string, k string"))
        flat = sorted(r for v in want.values() for r in v)
        assert step != 1 or content(change) == flat
        assert change.commit() == step + 1
        if step in (1, 3):
            continue
        now = store.snapshot()
        assert content(now) == flat and content(now, "words") == sorted((f"w{r[1]}", r[0]) for r in flat)
        some = rnd.sample(sorted({r[0] for r in flat}), min(3, len(want))) + ["none"]
        assert sorted(tuple(r) for r in now.lookup("rows", keys(spark, some)).collect()) == [r for r in flat if r[0] in some]
        found = now.lookup("words", spark.createDataFrame([("w1",)], "word string"))
        assert sorted(tuple(r) for r in found.collect()) == sorted(("w1", r[0]) for r in flat if r[1] == 1)
    assert len(store._numbers()) == 2 and set(os.listdir(store.path + "/rows")) == {p.split("/")[1] for n in store._numbers() for p in layers.Snapshot(store, n, store._load(n)).paths() if p.startswith("rows/")}


def test_a_small_change_writes_little(spark, store):
    first = store.begin()
    first.replace("rows", frame(spark, [(f"k{i}", 0, "x" * 50 + str(random.Random(i).random()), [i]) for i in range(20_000)]), groups=20_000)
    first.commit()
    before = size(store.path)
    change = store.begin()
    change.replace_groups("rows", keys(spark, ["k5", "k9"]), frame(spark, [("k5", 0, "new", [1])]))
    change.commit()
    assert size(store.path) - before < before / 50
    now = store.snapshot()
    assert now.table("rows").count() == 19_999 and now.table("rows").where("k = 'k5'").first()["v"] == "new"


def test_only_full_buckets_are_written_anew(spark, store, monkeypatch):
    monkeypatch.setattr(layers, "GROUPS_A_BUCKET", 100)
    monkeypatch.setattr(layers, "LEAST_ROWS", 10)
    first = store.begin()
    first.replace("rows", frame(spark, [(f"k{i}", 0, "a", [i]) for i in range(1000)]), groups=1000)
    first.commit()
    snapshot = store.snapshot()
    own = [r["k"] for r in snapshot.table("rows", [4]).collect()]
    other = [r["k"] for r in snapshot.table("rows", [7]).collect()][:1]
    change = store.begin()
    change.replace_groups("rows", keys(spark, own + other), frame(spark, [(k, 0, "b", [0]) for k in own + other]))
    change.commit()
    before, after = snapshot._tables["rows"], store.snapshot()._tables["rows"]
    assert {b for b in after["base"] if after["base"][b] != before["base"].get(b)} == {"4"} and len(after["layers"]) == 1
    assert store.snapshot().table("rows").where("v = 'b'").count() == len(own) + 1 and store.snapshot().table("rows").count() == 1000


def test_a_reader_keeps_its_manifest(spark, store):
    for v in "abc":
        change = store.begin()
        change.replace("rows", frame(spark, [("k", 0, v, None)]))
        change.commit()
        if v == "b":
            held = store.snapshot()
    assert content(held) == [("k", 0, "b", None)] and content(store.snapshot()) == [("k", 0, "c", None)]


def test_of_two_changes_one_loses(spark, store):
    one, two = store.begin(), store.begin()
    for change, v in ((one, "one"), (two, "two")):
        change.replace("rows", frame(spark, [("k", 0, v, None)]))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert content(store.snapshot()) == [("k", 0, "one", None)] and len(os.listdir(store.path + "/rows")) == 1
    again = store.begin()
    again.replace_groups("rows", keys(spark, ["l"]), frame(spark, [("l", 0, "two", None)]))
    again.commit()
    assert [r[2] for r in content(store.snapshot())] == ["one", "two"]


def test_what_fails_leaves_nothing(spark, store):
    change = store.begin()
    change.replace("rows", frame(spark, [("k", 0, "v", None)]))
    change.commit()
    change = store.begin()
    change.replace_groups("rows", keys(spark, ["k"]), frame(spark, [("k", 0, "w", None)]))
    with pytest.raises(Exception, match="boom"):
        change.replace_groups("words", keys(spark, ["k"]), spark.range(1).select(F.raise_error(F.lit("boom")).cast("string").alias("word"), F.lit("k").alias("k")))
        change.replace_groups("words", keys(spark, ["k"]), spark.range(1).select(F.raise_error(F.lit("boom")).cast("string").alias("word"), F.lit("k").alias("k")))
    change.abort()
    assert content(store.snapshot()) == [("k", 0, "v", None)] and content(store.snapshot(), "words") == []


def test_no_table_yet(spark, store):
    assert not store.exists() and content(store.snapshot()) == [] and not store.snapshot().has("rows")
    assert store.snapshot().lookup("rows", keys(spark, ["a"])).count() == 0


def test_first_groups_of_a_table_are_dealt_into_buckets(spark, tmp_path, monkeypatch):
    """A table whose first rows come as groups, and one whose buckets are fixed, are written by tasks of a bounded number of groups."""
    from tessera.sources import layers

    monkeypatch.setattr(layers, "GROUPS_A_BUCKET", 10)
    store = layers.Store(spark, f"file://{tmp_path}/t", {"rows": layers.Layout("k long, v string", ("k",), ("k",)), "fixed": layers.Layout("k long, v string", ("k",), ("v",), 2)})
    rows = spark.range(100).selectExpr("id as k", "'v' as v")
    change = store.begin()
    change.replace_groups("rows", rows.select("k"), rows)
    change.replace("fixed", rows, groups=100)
    change.commit()
    found = store.snapshot()
    assert found._tables["rows"]["n"] == 10 and found.table("rows").count() == found.table("fixed").count() == 100
    files = {r["f"] for r in found.table("fixed").selectExpr("input_file_name() as f").collect()}
    assert len(files) == 5  # one bucket has all rows, and five tasks wrote it


def test_large_tables_are_written_by_few_tasks_that_share_every_bucket(spark, tmp_path, monkeypatch):
    """Above MOST_BUCKETS tasks each takes more groups up to a bound, whether buckets are even or one has nearly all rows."""
    monkeypatch.setattr(layers, "GROUPS_A_BUCKET", 10)
    monkeypatch.setattr(layers, "MOST_BUCKETS", 4)
    monkeypatch.setattr(layers, "GROUPS_A_TASK", 50)
    store = Store(spark, str(tmp_path / "t"), {"even": Layout("k long, v string", ("k",), ("k",)), "typed": Layout("k long, v string", ("v", "k"), ("v",))})
    even, typed = spark.range(1000).selectExpr("id as k", "'v' as v"), spark.range(1000).selectExpr("id as k", "if(id < 990, 'many', 'few') as v")
    change = store.begin()
    change.replace("even", even, groups=1000)
    change.replace("typed", typed, groups=1000, sized=typed)
    change.commit()
    found = store.snapshot()
    files = lambda name: [r["count"] for r in found.table(name).selectExpr("input_file_name() as f").groupBy("f").count().collect()]
    assert len(files("even")) == 20 and max(files("even")) < 100 and sum(files("even")) == 1000
    assert len(files("typed")) in (20, 21) and max(files("typed")) < 100 and sum(files("typed")) == 1000


def test_only_touched_buckets_are_compared_with_layers(spark, tmp_path, monkeypatch):
    """A bucket that no layer touches is read as it is; where a bucket isn't told by the group, all are compared."""
    store = Store(spark, str(tmp_path / "t"), {"rows": Layout("type string, k long, v string", ("type", "k"), ("type",), 64), "loose": Layout("type string, k long, v string", ("k",), ("type",), 64)})
    rows = spark.range(40).selectExpr("concat('t', id % 4) as type", "id as k", "'old' as v")
    change = store.begin()
    for name in ("rows", "loose"):
        change.replace(name, rows, groups=40)
    change.commit()
    change = store.begin()
    new = spark.createDataFrame([("t1", 1, "new"), ("t1", 99, "new")], "type string, k long, v string")
    change.replace_groups("rows", new.union(spark.createDataFrame([("t1", 5, "")], new.schema)), new)  # t1's 5 goes
    change.replace_groups("loose", spark.createDataFrame([(2,)], "k long"), new.where("k = 99").selectExpr("type", "2L as k", "v"))
    change.commit()
    found, read = store.snapshot(), []
    base = found._base
    monkeypatch.setattr(found, "_base", lambda layout, entry, buckets: read.append(set(buckets)) or base(layout, entry, buckets))
    want = {("t1", 99, "new")} | {(f"t{k % 4}", k, "new" if k == 1 else "old") for k in range(40) if k != 5}
    table = found.table("rows")
    assert {tuple(r) for r in table.collect()} == want and table.count() == 40
    assert [len(b) for b in read] == [1, 3]
    assert {tuple(r) for r in found.lookup("rows", spark.createDataFrame([("t1", 99), ("t1", 5), ("t2", 2)], "type string, k long")).collect()} == {("t1", 99, "new"), ("t2", 2, "old")}
    assert {tuple(r) for r in found.table("loose").collect()} == {(f"t{k % 4}", k, "old") for k in range(40) if k != 2} | {("t1", 2, "new")}
