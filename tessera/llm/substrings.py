"""Operator 4: removal of word sequences that an earlier document has, by fixed-block anchors.

Any window of ``window`` words holds a whole block of ``window // 2`` words that starts at
a multiple of ``window // 2`` in its document.  So:

1. Index: each document's non-overlapping blocks.  Probe: every rolling window of a
   block's length.  Both are keyed by their least 8-word hash (equal blocks have equal
   keys, and neighbouring windows mostly share one, so a run of windows is one row).
   Whole-document copies are settled first by a hash of all words.
2. A key counts if the least document with a block under it is less than the greatest
   document that probes it; runs and blocks under such keys are hits.
3. Extension: all ``window``-word windows around the hits are hashed (96 bits of two
   independent hashes) and the least document of each hash is found.  Windows that an
   earlier document also has, merged where they overlap, are the maximal exact repeats.

No list of a key's documents and no pairs are ever made.  Steps 2 and 3 are one shuffle
each: rows sorted by key and document are judged as they stream by.  Before it, each
task judges the rows of a key that it holds itself and sends on only those that its
own cannot settle, so that a key with a third of all documents is a few rows a task.
A window that a document repeats is one row with all its places, and what is settled
travels as runs of places.

Cases: a null text has no words; a null doc_id counts as greater than any other; rows
that share a doc_id don't remove from each other, and equal rows get equal results;
documents shorter than a window keep all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, workers
from .words import SECOND, Words, mix, slices, utf8, window_hashes

_GRAM = 8
_LAST = (1 << 63) - 1
#: Parts over which the copies of a document are dealt.
_PARTS = 16
#: Rows that a task settles at a time.
_HELD = 1 << 19
_SPAN = {"doc": "long", "row": "long", "lo": "int", "hi": "int"}


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, row, text): row tells rows of one doc_id with different texts apart."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64("text").alias("row"),
        F.col("text"),
    )


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i:i + width] for each i; the last few cover less."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _anchors(batch: pa.RecordBatch, block: int) -> dict[str, np.ndarray]:
    """Runs of rolling windows with one key: key, doc, row, first and last position, and whether a block starts in it."""
    w = Words(*utf8(batch.column("text")))
    h, room, pos = w.hashes(), w.room(), w.positions()
    n = len(h)
    grams = np.where(room >= _GRAM, window_hashes(h, _GRAM), np.uint64(0)) if n else h
    key = _window_minimum(grams, block - _GRAM + 1) if n else grams
    at = np.flatnonzero(room >= block)
    first = np.ones(len(at), dtype=bool)
    first[1:] = (key[at[1:]] != key[at[:-1]]) | (at[1:] != at[:-1] + 1) | (pos[at[1:]] == 0)
    a = at[first]
    b = at[np.append(first[1:], True)] if len(at) else at
    lo, hi = pos[a].astype(np.int32), pos[b].astype(np.int32)
    own = np.repeat(np.arange(batch.num_rows), w.counts)[a]
    doc, row = (batch.column(c).to_numpy()[own] for c in ("doc", "row"))
    return {"key": key[a].view(np.int64), "doc": doc, "row": row, "lo": lo, "hi": hi, "block": hi // block * block >= lo}


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and the number of each row's run."""
    first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, dtype=bool)
    return np.flatnonzero(first), np.cumsum(first) - 1


def _judge_anchors(x: dict[str, np.ndarray], block: int, window: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Of rows sorted by (key, doc): which are hits, which are the last of their key, the spans of window starts around hits and indexed blocks, and whose they are."""
    starts, group = _groups(x["key"])
    least = np.minimum.reduceat(np.where(x["block"], x["doc"], _LAST), starts)[group] if len(starts) else x["doc"]
    most = np.maximum.reduceat(x["doc"], starts)[group] if len(starts) else x["doc"]
    hit, used = x["doc"] > least, x["block"] & (x["doc"] < most)
    lo = np.where(hit, x["lo"], -(-x["lo"] // block) * block) - (window - block)
    hi = np.where(hit, x["hi"], x["hi"] // block * block)
    own = np.flatnonzero((hit | used) & x["ask"])
    spans = {"doc": x["doc"][own], "row": x["row"][own], "lo": np.maximum(lo[own], 0).astype(np.int32), "hi": hi[own].astype(np.int32)}
    return hit, x["doc"] == most, spans, own


def _settle_anchors(x: dict[str, np.ndarray], block: int, window: int) -> dict[str, np.ndarray]:
    """A task's own rows: those that it can settle become spans (kind 1); the rest, and a mark of each key's greatest document, go on."""
    order = np.lexsort((x["doc"], x["key"]))
    x = {c: v[order] for c, v in x.items()} | {"ask": np.ones(len(order), dtype=bool)}
    hit, last, spans, own = _judge_anchors(x, block, window)
    done = hit[own]  # a used block may yet be a hit of a document elsewhere
    starts, group = _groups(x["key"])
    marked = np.zeros(len(starts), dtype=bool)
    marked[group[last & ~hit]] = True
    mark = np.zeros(len(hit), dtype=bool)
    i = np.flatnonzero(last & hit & ~marked[group])
    mark[i[np.unique(group[i], return_index=True)[1]]] = True
    go = np.flatnonzero(~hit | mark)
    sent = {c: x[c][go] for c in ("key", "doc", "row", "lo", "hi", "block")} | {"ask": ~mark[go], "kind": np.zeros(len(go), dtype=np.int8)}
    sent["block"] = sent["block"] & sent["ask"]
    kept = {c: v[done] for c, v in spans.items()}
    n = int(done.sum())
    route = mix(kept["doc"].astype(np.uint64) + kept["lo"].astype(np.uint64)).view(np.int64)
    kept |= {"key": route, "block": np.zeros(n, dtype=bool), "ask": np.zeros(n, dtype=bool), "kind": np.ones(n, dtype=np.int8)}
    return {c: np.concatenate([sent[c], kept[c]]) for c in _ANCHOR}


_ANCHOR = {"key": "long", "doc": "long", "row": "long", "lo": "int", "hi": "int", "block": "boolean", "ask": "boolean", "kind": "byte"}
_WINDOW = {"h1": "long", "h2": "int", "doc": "long", "row": "long", "kind": "byte", "at": "array<int>"}


def _settle_windows(x: dict[str, np.ndarray]) -> dict[str, np.ndarray | pa.Array]:
    """A task's own windows: those that an earlier document in it has are settled, as runs of places (kind 1, first and last); of the rest each document's places of a window are a row."""
    order = np.lexsort((x["pos"], x["row"], x["doc"], x["h2"], x["h1"]))
    x = {c: v[order] for c, v in x.items()}
    late = _late(x)
    open_ = {c: v[~late] for c, v in x.items()}
    first = np.ones(len(open_["doc"]), dtype=bool)
    first[1:] = np.logical_or.reduce([open_[c][1:] != open_[c][:-1] for c in ("h1", "h2", "doc", "row")])
    begin = np.flatnonzero(first)
    done = {c: x[c][late] for c in ("doc", "row", "pos")}
    order = np.lexsort((done["pos"], done["row"], done["doc"]))
    done = {c: v[order] for c, v in done.items()}
    first = np.ones(len(order), dtype=bool)
    first[1:] = (done["doc"][1:] != done["doc"][:-1]) | (done["row"][1:] != done["row"][:-1]) | (done["pos"][1:] != done["pos"][:-1] + 1)
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], len(order)) - 1 if len(lo) else lo
    route = mix(mix(done["row"][lo].view(np.uint64)) + done["pos"][lo].astype(np.uint64)).view(np.int64)
    n, m = len(begin), len(lo)
    at = np.concatenate([open_["pos"], np.stack([done["pos"][lo], done["pos"][hi]], axis=1).ravel()]).astype(np.int32)
    ends = np.concatenate([begin, len(open_["doc"]) + 2 * np.arange(m + 1)]).astype(np.int32)
    return {
        "h1": np.concatenate([open_["h1"][begin], route]),
        "h2": np.concatenate([open_["h2"][begin], np.zeros(m, dtype=np.int32)]),
        "doc": np.concatenate([open_["doc"][begin], done["doc"][lo]]),
        "row": np.concatenate([open_["row"][begin], done["row"][lo]]),
        "kind": np.repeat(np.array([0, 1], dtype=np.int8), (n, m)),
        "at": pa.ListArray.from_arrays(pa.array(ends), pa.array(at)),
    }


def _late(x: dict[str, np.ndarray]) -> np.ndarray:
    """Of windows sorted by (h1, h2, doc): is there an earlier document with the same."""
    first = np.ones(len(x["doc"]), dtype=bool)
    first[1:] = (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1])
    return x["doc"] > x["doc"][np.flatnonzero(first)][np.cumsum(first) - 1] if len(first) else first


def _record(x: dict[str, np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
    return workers.parts(pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in x.values()], names=list(x)))


def _gathered(parts: Iterator[dict[str, np.ndarray]], settle) -> Iterator[pa.RecordBatch]:
    """Settles rows of a task, many at a time."""
    workers.release()
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x["doc"])
        if n >= _HELD:
            whole = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            held, n = [], 0
            yield from _record(settle(whole))
    if held:
        yield from _record(settle({c: np.concatenate([h[c] for h in held]) for c in held[0]}))


def _open_key(x: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
    """Of rows sorted by (key, doc) what later rows of the last key may need: its least document's blocks, or only a mark of them if a greater document has come."""
    own = np.flatnonzero((x["key"] == x["key"][-1]) & x["block"])
    if not len(own):
        return None  # no block yet: what came before the first one is no hit and not used
    least = x["doc"][own].min()
    if x["doc"][-1] > least:
        return {c: v[own[:1]] for c, v in x.items()} | {"ask": np.zeros(1, dtype=bool)}
    return {c: v[own] for c, v in x.items()}


def _hits(batches: Iterator[pa.RecordBatch], block: int, window: int) -> Iterator[pa.RecordBatch]:
    """Spans around hits, of rows sorted by (key, doc). Of a key only its least document's blocks are kept from batch to batch."""
    workers.release()
    carried = None
    for x in batches:
        known = x.column("kind").to_numpy() == 1
        yield from _record(_columns(x, known, _SPAN))
        rows = _columns(x, ~known, _ANCHOR)
        if carried is not None:
            rows = {c: np.concatenate([carried[c], v]) for c, v in rows.items()}
        if len(rows["key"]):
            yield from _record(_judge_anchors(rows, block, window)[2])
            carried = _open_key(rows)


def _late_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of windows that an earlier document has, of rows sorted by (h1, h2, doc). From batch to batch only the last window's first document is kept."""
    workers.release()
    names = ("h1", "h2", "doc")
    first = None
    for x in batches:
        known = x.column("kind").to_numpy() == 1
        at = x.column("at")
        ends = at.filter(pa.array(known)).flatten().to_numpy().reshape(-1, 2)
        yield from _record(_columns(x, known, ("doc", "row")) | {"lo": ends[:, 0].copy(), "hi": ends[:, 1].copy()})
        own = np.flatnonzero(~known)
        if not len(own):
            continue
        rows = _columns(x, own, names)
        if first is not None:
            rows = {c: np.concatenate([first[c], v]) for c, v in rows.items()}
        late = _late(rows)[len(rows["doc"]) - len(own) :]
        begin = np.flatnonzero((rows["h1"] == rows["h1"][-1]) & (rows["h2"] == rows["h2"][-1]))[:1]
        first = {c: v[begin] for c, v in rows.items()}
        own = own[late]
        lists = at.take(pa.array(own))
        places = lists.flatten().to_numpy()
        yield from _record({c: np.repeat(v, lists.value_lengths().to_numpy(zero_copy_only=False)) for c, v in _columns(x, own, ("doc", "row")).items()} | {"lo": places, "hi": places})


def _columns(batch: pa.RecordBatch, own: np.ndarray, names) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False)[own] for c in names}


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each document's number of words and a 128-bit hash of them all."""
    w = Words(*utf8(batch.column("text")))
    cols = [batch.column("doc"), batch.column("row"), pa.array(w.counts.astype(np.int64)), *map(pa.array, w.wholes().T.copy())]
    return pa.RecordBatch.from_arrays(cols, names=["doc", "row", "n_words", "h1", "h2"])


def _by_slice(f, *args):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for whole in batches:
            for batch in slices(whole, "text"):
                yield f(batch, *args)

    return run


def _islands(spans: DataFrame, apart: int) -> DataFrame:
    """(doc, row, lo, hi): spans of a document (both ends inclusive) merged where the next begins at most ``apart`` after the last one's end."""
    order = Window.partitionBy("doc", "row").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("lo") > before + apart, 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc", "row", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _listed(spans: DataFrame) -> DataFrame:
    """(doc, row, spans): a document's own merged spans."""
    return spans.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def find_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc, row, spans): maximal spans of word positions, hi exclusive, that an earlier document has too."""
    with scratch.brief(docs.sparkSession):
        return _find_repeats(docs, window)


def _find_repeats(docs: DataFrame, window: int) -> DataFrame:
    spark = docs.sparkSession
    block = window // 2
    if block < _GRAM:
        raise ValueError(f"windows of less than {2 * _GRAM} words are not supported")
    texts = _keyed(docs)
    shape = lambda columns: ", ".join(f"{c} {t}" for c, t in columns.items())

    whole = scratch.keep(texts.mapInArrow(_by_slice(_whole), "doc long, row long, n_words long, h1 long, h2 long").where(F.col("n_words") >= window), "documents")
    least = whole.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    # a text that very many documents have is dealt over several tasks
    dealt = whole.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(_PARTS)).cast("int"))
    least = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    copies = scratch.keep(dealt.join(least.hint("merge"), ["h1", "h2", "part"]).where("doc > least").select("doc", "row", "n_words").distinct(), "copies")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered((_anchors(b, block) for whole in batches for b in slices(whole, "text")), lambda x: _settle_anchors(x, block, window))

    runs = texts.mapInArrow(anchors, shape(_ANCHOR)).repartition("key").sortWithinPartitions("key", "doc")
    around = _islands(runs.mapInArrow(lambda batches: _hits(batches, block, window), shape(_SPAN)), 1).join(copies.hint("merge"), ["doc", "row"], "left_anti")
    ranges = scratch.keep(_listed(around), "ranges")
    scratch.tidy(spark)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered((_windows(b, window) for whole in batches for b in slices(whole, "text")), _settle_windows)

    near = texts.join(ranges.hint("merge"), ["doc", "row"]).select("doc", "row", "text", "spans")  # grows with the corpus: never a broadcast
    seen = near.mapInArrow(windows, shape(_WINDOW)).repartition("h1").sortWithinPartitions("h1", "h2", "doc")
    found = _islands(seen.mapInArrow(_late_spans, shape(_SPAN)), window).withColumn("hi", F.col("hi") + window)
    all_copy = copies.select("doc", "row", F.array(F.struct(F.lit(0).alias("lo"), F.col("n_words").cast("int").alias("hi"))).alias("spans"))
    repeats = scratch.keep(_listed(found).unionByName(all_copy), "repeats", outer=True)
    scratch.tidy(spark)
    return repeats


def _windows(batch: pa.RecordBatch, window: int) -> dict[str, np.ndarray]:
    """Hashes of the windows that start in a document's spans."""
    w = Words(*utf8(batch.column("text")))
    spans = batch.column("spans")
    flat, begin = spans.flatten(), spans.offsets.to_numpy() - spans.offsets[0].as_py()
    owner = np.repeat(np.arange(batch.num_rows), np.diff(begin))
    lo, hi = (flat.field(k).to_numpy() for k in (0, 1))
    top = w.cuts[1:][owner] - window  # the last start of a window in the document
    a, b = w.cuts[:-1][owner] + lo, np.minimum(w.cuts[:-1][owner] + hi, top) + 1
    keep = b > a
    wanted = np.zeros(len(w.starts) + 1, dtype=np.int64)
    np.add.at(wanted, a[keep], 1)
    np.add.at(wanted, b[keep], -1)
    i = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
    own = np.repeat(np.arange(batch.num_rows), w.counts)[i]
    doc, row = (batch.column(c).to_numpy()[own] for c in ("doc", "row"))
    h1 = window_hashes(w.hashes(), window)[i].view(np.int64) if len(i) else np.zeros(0, dtype=np.int64)
    h2 = (window_hashes(w.hashes(SECOND), window)[i] >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(i) else np.zeros(0, dtype=np.int32)
    return {"h1": h1, "h2": h2, "doc": doc, "row": row, "pos": w.positions()[i].astype(np.int32)}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")


def _kept_words(words: str, spans: str) -> Column:
    """The words outside the spans, joined by one blank; spans is not empty."""
    gaps = f"concat(array(struct(0 as lo, {spans}[0].lo as hi)), transform({spans}, (s, i) -> struct(s.hi as lo, coalesce(get({spans}, i + 1).lo, size({words})) as hi)))"
    return F.expr(f"array_join(flatten(transform({gaps}, g -> slice({words}, g.lo + 1, g.hi - g.lo))), ' ')")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Each row's doc_id, row (a hash of its text), n_words, n_removed and kept_text: kept words joined by one blank."""
    repeats = find_repeats(docs, window)
    out = _keyed(docs).join(repeats.hint("merge"), ["doc", "row"], "left").withColumn("words", _words(F.col("text")))
    return out.select(
        F.expr(f"nullif(doc, {_LAST})").alias("doc_id"),
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.expr("coalesce(aggregate(spans, 0L, (a, s) -> a + s.hi - s.lo), 0L)").alias("n_removed"),
        F.when(F.col("spans").isNull(), F.array_join("words", " ")).otherwise(_kept_words("words", "spans")).alias("kept_text"),
    )


def cut_texts(docs: DataFrame, window: int = 50) -> DataFrame:
    """The rows with repeats cut from their texts; a text that loses no word stays as it is. n_chars follows, where it is a column; other columns, of any name, stay."""
    # the columns go by number meanwhile, so that no name clashes
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    text, doc_id = F.col(at["text"]), F.col(at["doc_id"])
    keyed = docs.toDF(*at.values()).withColumn("_d", F.coalesce(doc_id.cast("long"), F.lit(_LAST))).withColumn("_r", F.xxhash64(text))
    joined = keyed.join(find_repeats(docs, window).hint("merge"), (F.col("_d") == F.col("doc")) & (F.col("_r") == F.col("row")), "left")
    joined = joined.withColumn("words", F.when(F.col("spans").isNotNull(), _words(text)))
    out = joined.withColumn("kept", F.when(F.col("spans").isNull(), text).otherwise(_kept_words("words", "spans")))
    given = {c: F.col(n) for c, n in at.items()} | {"text": F.col("kept")}
    if "n_chars" in at:
        given["n_chars"] = F.when(F.col("spans").isNull(), F.col(at["n_chars"])).otherwise(F.length("kept")).cast("long")
    return out.select(*[v.alias(c) for c, v in given.items()])
