"""Operator 12: fill-in-the-middle, with cuts found by a parallel scan of a finite automaton.

The automaton reads bytes.  A transition may complete a unit (a code point, by
:func:`code_points`) and may complete a mark (a string that a text must not hold).
What a run of bytes does is a function of the state in which it is entered: the state
it is left in, the units it completes and whether it completes a mark.  Such functions
compose, and composition is associative, so:

1. Scan: a chunk's bytes are cut into lanes of 256; all lanes, from all states at
   once, step through their bytes together.  Lanes compose to the chunk's function.
2. Resolve: the functions of a document's chunks, a few numbers each, are composed in
   order; that gives the state in which each chunk is entered and the units before it,
   the document's units, and so the chunks that its cuts fall in.
3. Select: in these chunks alone the lane with the cut is found by the lanes' composed
   counts, and the byte by one more pass over that lane.

A text of up to ``chunk_bytes`` is one chunk and needs no shuffle: all three steps are
one pass.  Chunks of longer ones are dealt over the cluster; nothing of a long text
but its own row is ever in one place, and the outputs are put together by the JVM.

Cases: a null or empty text has no units and stays plain; so does one with a mark; a
null id hashes as an empty one; rows that repeat get equal results; columns other than
doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, workers
from .words import utf8

#: Bytes that one lane steps through.
LANE = 256
#: The byte that fills up a lane: it changes nothing.
_PAD = 256
#: The strings that mark a document's parts.
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Automaton:
    """Transitions of states over bytes, from state 0; ``emits`` and ``marks`` tell which of them complete a unit or a mark."""

    next: np.ndarray  # [states, 256]
    emits: np.ndarray
    marks: np.ndarray

    @property
    def states(self) -> int:
        return len(self.next)

    @property
    def packed(self) -> np.ndarray:
        """At byte * states + state: the next state, from bit 8 on a unit, from bit 20 on a mark."""
        out = np.zeros((257, self.states), dtype=np.uint32)
        out[:256] = (self.next.astype(np.uint32) | self.emits.astype(np.uint32) << 8 | self.marks.astype(np.uint32) << 20).T
        out[_PAD] = np.arange(self.states)
        return out.ravel()


@cache
def code_points(marks: tuple[str, ...] = MARKS) -> Automaton:
    """Units are code points, complete with their last UTF-8 byte; marks are found wherever they end."""
    words = [m.encode() for m in marks]
    heads = {w[:k] for w in words for k in range(len(w))} | {b""}

    def after(state: tuple[int, bytes], byte: int) -> tuple[tuple[int, bytes], bool, bool]:
        left, seen = state
        seen += bytes([byte])
        found = any(seen.endswith(w) for w in words)
        seen = next(seen[k:] for k in range(len(seen) + 1) if seen[k:] in heads)
        if byte & 0xC0 == 0x80 and left:
            left -= 1
        else:
            left = 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
        return (left, seen), left == 0, found

    known, rows = {(0, b""): 0}, []
    for state in (queue := [(0, b"")]):
        row = [after(state, byte) for byte in range(256)]
        for s, _, _ in row:
            if s not in known:
                known[s] = len(known)
                queue.append(s)
        rows.append([(known[s], emit, mark) for s, emit, mark in row])
    table = np.array(rows)
    return Automaton(table[:, :, 0].astype(np.uint8), table[:, :, 1].astype(bool), table[:, :, 2].astype(bool))


@dataclass
class Functions:
    """What runs of bytes do, by the state in which they are entered: [runs, states] each."""

    next: np.ndarray
    units: np.ndarray
    marks: np.ndarray

    def __getitem__(self, own) -> Functions:
        return Functions(self.next[own], self.units[own], self.marks[own])

    def then(self, other: Functions) -> Functions:
        """The runs of this followed by those of the other, one by one."""
        through = self.next.astype(np.int64)
        pick = lambda a: np.take_along_axis(a, through, axis=1)
        return Functions(pick(other.next), self.units + pick(other.units), self.marks | pick(other.marks))

    def upto(self, place: np.ndarray) -> Functions:
        """Each run composed with those before it in its group, by doubling; place: its number in its group."""
        out, step = self[:], 1
        while step <= place.max(initial=0):
            own = np.flatnonzero(place >= step)
            both = out[own - step].then(out[own])
            out.next[own], out.units[own], out.marks[own] = both.next, both.units, both.marks
            step *= 2
        return out


class Scan:
    """The lanes of some pieces of bytes, each composed with those before it in its piece."""

    def __init__(self, machine: Automaton, data: np.ndarray, offsets: np.ndarray):
        """data: bytes of all pieces; offsets: where each begins, and the end."""
        size = np.diff(offsets)
        lanes = np.maximum(1, -(-size // LANE))  # an empty piece has a lane that changes nothing
        self.machine, self.first = machine, np.concatenate([[0], np.cumsum(lanes)])
        self.place = np.arange(self.first[-1]) - np.repeat(self.first[:-1], lanes)
        start = np.repeat(offsets[:-1], lanes) + self.place * LANE
        end = np.minimum(start + LANE, np.repeat(offsets[1:], lanes))
        at = start[None, :] + np.arange(LANE)[:, None]
        self.bytes = np.where(at < end, np.append(data, np.uint8(0))[np.minimum(at, len(data))], np.int64(_PAD)).astype(np.int32)  # [LANE, lanes]
        self.upto = self._run().upto(self.place)

    def _run(self) -> Functions:
        s, table = self.machine.states, self.machine.packed
        state = np.tile(np.arange(s, dtype=np.int32), (self.bytes.shape[1], 1))
        total = np.zeros(state.shape, dtype=np.uint32)
        for column in self.bytes:
            got = table[(column * s)[:, None] + state]
            total += got >> 8
            state = (got & 0xFF).view(np.int32)
        return Functions(state.astype(np.uint8), (total & 0xFFF).astype(np.int64), total >> 12 > 0)

    def pieces(self) -> Functions:
        """The function of each piece."""
        return self.upto[self.first[1:] - 1]

    def locate(self, piece: np.ndarray, entered: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Where in its piece, entered in a state, so many units are complete: the byte after; 0 for no units."""
        out = np.zeros(len(piece), dtype=np.int64)
        own = np.flatnonzero(unit > 0)
        piece, entered, unit = piece[own], entered[own].astype(np.int64), unit[own]
        low, high = self.first[piece], self.first[piece + 1] - 1
        while (low < high).any():  # the first lane by whose end they are complete
            mid = (low + high) // 2
            done = self.upto.units[mid, entered] >= unit
            low, high = np.where(done, low, np.minimum(mid + 1, high)), np.where(done, mid, high)
        begins, before = low == self.first[piece], np.maximum(low - 1, 0)
        state = np.where(begins, entered, self.upto.next[before, entered]).astype(np.int32)
        left = unit - np.where(begins, 0, self.upto.units[before, entered])
        s, table, at = self.machine.states, self.machine.packed, np.zeros(len(own), dtype=np.int64)
        for k, column in enumerate(self.bytes):
            got = table[column[low] * s + state]
            state = (got & 0xFF).astype(np.int32)
            left -= got >> 8 & 1
            at[(left == 0) & (at == 0)] = k + 1
        out[own] = (low - self.first[piece]) * LANE + at
        return out


def _slices(columns: list[pa.Array], most: int = 1 << 19) -> Iterator[list[pa.Array]]:
    """The rows in order, so many at a time that the first column has at most so many bytes, or one row."""
    size = np.cumsum(np.append(0, np.diff(utf8(columns[0])[1])))
    a, n = 0, len(columns[0])
    while a < n:
        b = max(a + 1, int(np.searchsorted(size, size[a] + most, side="right")) - 1)
        yield [c.slice(a, b - a) for c in columns]
        a = b


def _cuts(machine: Automaton):
    """n, marked, and the bytes at which a text's cuts are, of texts that are one chunk each."""

    @F.arrow_udf("struct<n:long,marked:boolean,a:long,b:long>")
    def cuts(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        workers.release()
        for batch in columns:
            found = []
            for text, x, y in _slices(list(batch)):
                scan = Scan(machine, *utf8(text))
                whole = scan.pieces()
                n = whole.units[:, 0]
                places = [v.to_numpy() % (n + 1) for v in (x, y)]
                every, start = np.arange(len(n)), np.zeros(len(n), dtype=np.int64)
                a, b = (scan.locate(every, start, f(*places)) for f in (np.minimum, np.maximum))
                found.append((n, whole.marks[:, 0], a, b))
            parts = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in (np.int64, bool, np.int64, np.int64)]
            yield pa.StructArray.from_arrays([pa.array(c) for c in parts], names=["n", "marked", "a", "b"])

    return cuts


def hashes(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four 32-bit numbers of a document's id and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _long_cuts(long: DataFrame, machine: Automaton, chunk_bytes: int) -> DataFrame:
    """(id, row, n, marked, a, b) of texts of many chunks, by scan, resolve and select."""
    spark, s = long.sparkSession, machine.states
    data = F.col("text").cast("binary")
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / chunk_bytes).cast("int"))).alias("k")
    chunks = long.select("id", "row", "x", "y", "text", chunk).select("id", "row", "x", "y", "k", F.substring(data, F.col("k") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"))
    chunks = scratch.keep(chunks.repartition("id", "row", "k"), "chunks")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for batch in batches:
            for data, *keys in _slices([_data(batch), *map(batch.column, ("id", "row", "k", "x", "y"))]):
                f = Scan(machine, *utf8(data)).pieces()
                columns = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (f.next, f.units, f.marks)]
                yield pa.RecordBatch.from_arrays([*keys, *columns], names=["id", "row", "k", "x", "y", "next", "units", "marks"])

    functions = chunks.select("id", "row", "k", "x", "y", "data").mapInArrow(scan, "id long, row long, k int, x long, y long, next binary, units binary, marks binary")
    functions = functions.repartition("id", "row").sortWithinPartitions("id", "row", "k")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's chunks are at most as many as a text of 2 GB has; a row here is a few numbers."""
        workers.release()
        out: list[tuple] = []
        for (doc, row, x, y), rows in _documents(batches):
            f = Functions(*(np.frombuffer(b"".join(r[c] for r in rows), dtype=t).reshape(len(rows), s) for c, t in (("next", np.uint8), ("units", np.int64), ("marks", bool))))
            upto = Functions(f.next.copy(), f.units.copy(), f.marks.copy()).upto(np.arange(len(rows)))
            done = upto.units[:, 0]
            n, marked = int(done[-1]), bool(upto.marks[-1, 0])
            for which, unit in enumerate(sorted((x % (n + 1), y % (n + 1)))):
                k = int(np.searchsorted(done, unit, side="left"))
                entered, before = (int(upto.next[k - 1, 0]), int(done[k - 1])) if k else (0, 0)
                out.append((doc, row, n, marked, which, k, entered, unit - before))
            if len(out) >= 4096:
                yield _cut_rows(out)
                out = []
        yield _cut_rows(out)

    wanted = scratch.keep(functions.mapInArrow(resolve, _CUT), "wanted")
    given = chunks.select(F.col("id").alias("c_id"), F.col("row").alias("c_row"), F.col("k").alias("c_k"), "data").hint("merge")
    pairs = wanted.join(given, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("row") == F.col("c_row")) & (F.col("k") == F.col("c_k"))).drop("c_id", "c_row", "c_k")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        names = ["id", "row", "n", "marked", "which", "k", "entered", "unit"]
        for batch in batches:
            for data, *columns in _slices([_data(batch), *map(batch.column, names)]):
                x = dict(zip(names, columns, strict=True))
                k, entered, unit = (x[c].to_numpy() for c in ("k", "entered", "unit"))
                at = Scan(machine, *utf8(data)).locate(np.arange(len(k)), entered, unit)
                yield pa.RecordBatch.from_arrays([*(x[c] for c in ("id", "row", "n", "marked", "which")), pa.array(k.astype(np.int64) * chunk_bytes + at)], names=["id", "row", "n", "marked", "which", "at"])

    found = pairs.mapInArrow(select, "id long, row long, n long, marked boolean, which int, at long")
    side = lambda which: F.max(F.when(F.col("which") == which, F.col("at")))
    return scratch.keep(found.groupBy("id", "row", "n", "marked").agg(side(0).alias("a"), side(1).alias("b")), "cuts", outer=True)


_CUT = "id long, row long, n long, marked boolean, which int, k int, entered int, unit long"


def _cut_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"id": pa.int64(), "row": pa.int64(), "n": pa.int64(), "marked": pa.bool_(), "which": pa.int32(), "k": pa.int32(), "entered": pa.int32(), "unit": pa.int64()}
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Each document's rows in order, of rows sorted by (id, row, k); a repeated chunk of equal rows once."""
    key, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            own = (r["id"], r["row"], r["x"], r["y"])
            if own != key:
                if rows:
                    yield key, rows
                key, rows = own, []
            if not rows or rows[-1]["k"] != r["k"]:
                rows.append(r)
    if rows:
        yield key, rows


def _data(batch: pa.RecordBatch) -> pa.Array:
    """A chunk's bytes, which may begin and end within a character."""
    return batch.column("data").cast(pa.large_binary()).view(pa.large_string())


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, chunk_bytes: int = 1 << 16, machine: Automaton | None = None) -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units and output of each row.

    percent of the documents are cut, spm_percent of these give their suffix first.
    """
    machine = machine or code_points()
    x, y, turn, order = hashes(F.col("doc_id").cast("long"), seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), x.alias("x"), y.alias("y"), turn.alias("turn"), order.alias("order"))
    is_long = F.octet_length("text") > chunk_bytes
    short = rows.where(~is_long).withColumn("c", _cuts(machine)("text", "x", "y")).select("id", "text", "x", "y", "turn", "order", "c.*")
    long = rows.where(is_long).withColumn("row", F.xxhash64("text"))
    with scratch.brief(docs.sparkSession):
        cuts = _long_cuts(long.select("id", "row", "x", "y", "text"), machine, chunk_bytes)
    cuts = cuts.select(F.col("id").alias("c_id"), F.col("row").alias("c_row"), "n", "marked", "a", "b")
    long = long.join(cuts, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("row") == F.col("c_row"))).select(*short.columns)
    out = short.unionByName(long)
    form = F.when((F.col("n") == 0) | F.col("marked") | (F.col("turn") % 100 >= percent), "plain").when(F.col("order") % 100 < spm_percent, "spm").otherwise("psm")
    data = F.col("text").cast("binary")
    part = lambda begin, size: F.substring(data, begin.cast("int") + 1, size.cast("int")).cast("string")
    a, b = F.col("a"), F.col("b")
    prefix, middle, suffix = part(F.lit(0), a), part(a, b - a), part(b, F.octet_length("text") - b)
    text = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    text = text.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    places = [F.col(c) % (F.col("n") + 1) for c in "xy"]
    cut = lambda v: F.when(F.col("form") != "plain", v)
    return out.withColumn("form", form).select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        cut(F.least(*places)).alias("prefix_units"),
        cut(F.greatest(*places) - F.least(*places)).alias("middle_units"),
        text.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the form was made from: a text that is cut holds no mark, so an output has each mark once."""
    parts = F.split(output, "|".join(MARKS), -1)
    first, second, third = (F.element_at(parts, k) for k in (2, 3, 4))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))
