"""Operator 13: tokens of two tokenizers aligned by the bytes that they cover, and id pairs counted over the corpus.

A and B cut the same bytes.  Between two neighbouring ends of either lies one stretch,
and it lies in one token of each: the stretches of a document are its links (all A-B
pairs that overlap), and ends of both are where its groups end.

1. Align: blocks of documents are encoded; a block's links become counts of its id
   pairs, one for each (pair, document) and, summed, one for each pair.
2. Count: pairs go to stripes by B id (id modulo the number of stripes, so that frequent
   ids, which are near each other, are dealt out).  A stripe is a dense matrix of counts
   (its B ids by all A ids), filled with ``np.add.at``.  A stripe with very many blocks
   is filled in parts, which are summed; then row maxima tell each B id's best.
3. Score: a stripe's final counts meet the same blocks' pairs again in the same stripes
   and parts, and answer each with its count, negative where it is a B id's highest.
   Answers go back to their blocks, where documents sum them over their links.

What moves is a block's different pairs, not its links: one row for a block and stripe.
A stripe's matrix and a block (``BLOCK`` characters, or one document's pairs) bound a
task's memory.  Long texts are encoded in segments, cut where both tokenizers begin anew.

Cases: a null or empty text, or one whose tokens don't spell its bytes, has no tokens:
zeros and an empty hash; strings of special tokens are plain text; rows that repeat an
id are documents of their own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, workers
from .bpe import Encoder, _Table
from .words import SECOND, Spans

#: Characters of text in a block, unless one document has more.
BLOCK = 1 << 22
#: Characters that are encoded at a time, and of a segment of a long text, about.
SEGMENT = 1 << 19
#: B ids in a stripe: its matrix has so many rows and a column for each A id.
ROWS = 64
#: Blocks that a part of a stripe answers, on average.
BLOCKS_A_PART = 512
#: Both tokenizers begin anew here: a blank after a character that isn't one, before an ASCII letter.
_ANEW = re.compile(r"(?<=\S) (?=[A-Za-z])")
_SPELL = 1 << 20
#: Bits of a document's number in its block, and of an A id, in a pair's key.
_DOC, _A = 22, 18


class PieceEncoder:
    """Ids of a SentencePiece model for texts that begin with the blank that the model adds; each distinct stretch between blanks goes to the library once.

    No piece holds the model's blank after another character, so nothing merges across the beginning of a run of blanks.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece of this model runs over a blank")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        self.blank = self.model.piece_to_id("▁")
        self._start_anew()

    def _start_anew(self, room: int = 0) -> None:
        self._table = _Table(max(_SPELL.bit_length(), (2 * room).bit_length()))
        self._pool, self._ends, self._check = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint64)

    def _spell(self, stretch: str) -> list[int]:
        """Ids of a stretch that begins with a blank; the library puts that blank there."""
        return self.model.encode(stretch[1:]) if len(stretch) > 1 else [self.blank]

    def _learn(self, keys: np.ndarray, checks: np.ndarray, stretches: list[str]) -> None:
        """Keeps the ids of new stretches; of one that they don't spell, none, so that it isn't mistaken for one that they do."""
        some = [s[1:] for s in stretches]
        found = self.model.encode(some)
        ids = [[self.blank] if s == "" else got for s, got in zip(some, found, strict=True)]
        ids = [got if b"".join(map(self.bytes.__getitem__, got)) == s.encode() else [] for s, got in zip(stretches, ids, strict=True)]
        self._table.put(keys, np.arange(len(self._check), len(self._check) + len(keys), dtype=np.int32))
        self._check = np.concatenate([self._check, checks])
        self._pool = np.concatenate([self._pool, np.array([i for got in ids for i in got], dtype=np.int32)])
        self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum([len(got) for got in ids])])

    def encode_many(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, None where they don't spell it. A text isn't empty and begins with a blank."""
        whole = "".join(texts)
        data = np.frombuffer(whole.encode(), dtype=np.uint8)
        size = np.array([len(t.encode()) for t in texts])
        heads = np.cumsum(size) - size
        start = data == 32
        start[1:] &= data[:-1] != 32
        start[heads] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data))
        spans = Spans(data)
        keys, checks = spans.hashes(begin, end), spans.hashes(begin, end, SECOND)
        entry = self._table.find(keys)
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            new, at = np.unique(keys[lost], return_index=True)
            if self._table.held + len(new) > _SPELL:
                new, at = np.unique(keys, return_index=True)
                self._start_anew(len(new))
                lost = np.arange(len(keys))
            self._learn(new, checks[lost[at]], [data[b:e].tobytes().decode() for b, e in zip(begin[lost[at]].tolist(), end[lost[at]].tolist(), strict=True)])
            entry[lost] = self._table.find(keys[lost])
        first = self._ends[entry]
        count = self._ends[entry + 1] - first
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self._pool[np.arange(upto[-1]) + np.repeat(first - upto[:-1], count)]
        cuts = upto[np.searchsorted(begin, np.append(heads, len(data)))]
        out: list[np.ndarray | None] = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        odd = begin[(count == 0) | (self._check[entry] != checks)]
        for k in set((np.searchsorted(heads, odd, side="right") - 1).tolist()):  # the library's own ids, and whether they spell the text
            own = self._spell(texts[k])
            out[k] = np.array(own, dtype=np.int32) if b"".join(map(self.bytes.__getitem__, own)) == texts[k].encode() else None
        return out


class Aligner:
    """Both tokenizers, with the size in bytes of each token."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Encoder(path_a, plain_specials=True), PieceEncoder(path_b)
        if self.a.tokenizer.normalizer is not None:
            raise ValueError("A must spell a text's bytes")
        names = sorted(self.a.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.n_a, self.n_b = names[-1][1] + 1, len(self.b.bytes)
        self.size_a, self.size_b = np.zeros(self.n_a, dtype=np.int64), np.array([len(x) for x in self.b.bytes])
        for name, k in names:
            self.size_a[k] = len(name)  # a character of an entry stands for a byte
        if self.n_a > 1 << _A or self.n_b > 1 << (62 - _A - _DOC):
            raise ValueError("too many ids")
        digits = [str(k).encode() for k in range(max(self.n_a, self.n_b))]
        self.digits = np.array([len(d) for d in digits])
        self.wide = int(self.digits.max()) + 1
        self.written = np.frombuffer(b"".join(d.ljust(self.wide) for d in digits), dtype=np.uint8).reshape(-1, self.wide)

    def align(self, texts: list[str]) -> tuple[np.ndarray, ...] | None:
        """Of texts that each begin with a blank: which have tokens, then for those n_a, n_b, n_groups, n_links, A and B of each link in order, the groups written out and where each text's end."""
        got_a, got_b = self.a.encode_many(texts), self.b.encode_many(texts)
        good = np.array([y is not None and int(self.size_a[x].sum()) == int(self.size_b[y].sum()) for x, y in zip(got_a, got_b, strict=True)])
        if not good.any():
            return good, *[np.zeros(0, dtype=np.int64)] * 8
        got_a, got_b = ([x[k] for k in np.flatnonzero(good)] for x in (got_a, got_b))
        a, b = np.concatenate(got_a).astype(np.int64), np.concatenate(got_b).astype(np.int64)
        n_a, n_b = (np.array([len(x) for x in got]) for got in (got_a, got_b))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.zeros((2, int(end_a[-1]) + 1), dtype=bool)
        ends[0, end_a] = ends[1, end_b] = True
        at = np.flatnonzero(ends[0] | ends[1])  # where stretches end
        in_a, in_b = ends[0, at], ends[1, at]
        link_a, link_b = a[np.cumsum(in_a) - in_a], b[np.cumsum(in_b) - in_b]
        both = in_a & in_b
        group = np.cumsum(both) - both
        stop = np.searchsorted(at, end_a[np.cumsum(n_a) - 1], side="right")
        n_links = np.diff(stop, prepend=0)
        n_groups = np.diff(np.cumsum(both)[stop - 1], prepend=0)
        text, cuts = self._write(a, b, group[in_a], group[in_b], np.cumsum(n_a + n_b))
        return good, n_a, n_b, n_groups, n_links, link_a, link_b, text, cuts

    def _write(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids as text: those of a group with commas between, a bar before B's, a semicolon after them; upto: tokens by the end of each document."""
        every = group_b[-1] + 1
        before_b = np.cumsum(np.bincount(group_b, minlength=every)) - np.bincount(group_b, minlength=every)
        with_a = np.cumsum(np.bincount(group_a, minlength=every))
        n = len(a) + len(b)
        ids, mark = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
        place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + with_a[group_b]
        ids[place_a], ids[place_b] = a, b
        mark[place_a[np.append(group_a[1:] != group_a[:-1], True)]] = ord("|")
        mark[place_b[np.append(group_b[1:] != group_b[:-1], True)]] = ord(";")
        rows, size = self.written[ids], self.digits[ids]
        rows[np.arange(n), size] = mark
        return rows[np.arange(self.wide) <= size[:, None]], np.cumsum(size + 1)[upto - 1]


def aligner(path_a: str, path_b: str) -> Aligner:
    return workers.kept("aligner", f"{path_a}|{path_b}", lambda: Aligner(path_a, path_b))


def segments(text: str, most: int) -> Iterator[str]:
    """Parts of a text of about so many characters, cut where both tokenizers begin anew; a text without such a place stays whole."""
    a = 0
    while len(text) - a > most and (m := _ANEW.search(text, a + most)):
        yield text[a : m.start()]
        a = m.start()
    yield text[a:]


def _begins(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


class _Block:
    """Documents whose links are counted together; ``counts`` are (stripe, B id, A id, document) keys and how many links each has."""

    def __init__(self, both: Aligner, stripes: int, segment: int):
        self.both, self.stripes, self.segment = both, stripes, segment
        self.ids: list[int | None] = []
        self.stats = np.zeros((0, 4), dtype=np.int64)
        self.hashes: list = []
        self.bad: set[int] = set()
        self.begun: set[int] = set()
        self.waiting: list[tuple[int, str]] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.pending = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        slot = len(self.ids)
        self.ids.append(doc_id)
        self.hashes.append(None)
        for part in segments(" " + text, self.segment) if text else ():
            self.waiting.append((slot, part))
            self.size, self.pending = self.size + len(part), self.pending + len(part)
            if self.pending >= self.segment:
                self.settle()

    def settle(self) -> None:
        self.stats = np.concatenate([self.stats, np.zeros((len(self.ids) - len(self.stats), 4), dtype=np.int64)])
        if not self.waiting:
            return
        slots = np.array([s for s, _ in self.waiting])
        good, *counts, link_a, link_b, text, cuts = self.both.align([t for _, t in self.waiting])
        self.waiting, self.pending = [], 0
        self.bad.update(slots[~good].tolist())
        slots = slots[good]
        np.add.at(self.stats, slots, np.stack(counts, axis=1))
        for slot, a, b in zip(slots.tolist(), np.append(0, cuts)[:-1].tolist(), cuts.tolist(), strict=True):
            h = self.hashes[slot] = self.hashes[slot] or sha256()
            h.update(b";" * (slot in self.begun) + text[a : b - 1].tobytes())
            self.begun.add(slot)
        rows = -(-self.both.n_b // self.stripes)
        key = (link_b % self.stripes * rows + link_b // self.stripes) << (_A + _DOC) | link_a << _DOC | np.repeat(slots, counts[3])
        if len(key):
            self.parts.append(np.unique(key, return_counts=True))
        if len(self.parts) > 32:  # a document of very many segments
            self.parts = [self._summed()]

    def _summed(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = _begins(key)
        return key[first], np.add.reduceat(n, first)

    def rows(self, number: int) -> pa.RecordBatch:
        """One row for the block (stripe -1), and one for each stripe with its pairs."""
        self.settle()
        key, n = self._summed() if self.parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        if self.bad:
            keep = ~np.isin(key & ((1 << _DOC) - 1), sorted(self.bad))
            key, n = key[keep], n[keep]
            self.stats[sorted(self.bad)] = 0
        pair = key >> _DOC
        first = _begins(pair)
        docs_of = np.diff(np.append(first, len(pair)))
        total = np.add.reduceat(n, first) if len(first) else n
        pair = pair[first]
        rows = -(-self.both.n_b // self.stripes)
        b, a = pair >> _A, (pair & ((1 << _A) - 1)).astype(np.int32)
        stripe = b // rows
        cut = _begins(stripe)
        stop = np.append(cut, len(pair))[1:]
        slices = [(int(stripe[x]), a[x:y], (b[x:y] % rows).astype(np.int32), total[x:y]) for x, y in zip(cut.tolist(), stop.tolist(), strict=True)]
        groups = ["" if h is None or k in self.bad else h.hexdigest() for k, h in enumerate(self.hashes)]
        m = 1 + len(slices)
        none = [None] * len(slices)
        columns = {
            "block": pa.array([number] * m, pa.int64()),
            "stripe": pa.array([-1, *(s for s, *_ in slices)], pa.int32()),
            "ids": pa.array([self.ids, *none], pa.list_(pa.int64())),
            "stats": pa.array([self.stats.ravel(), *none], pa.list_(pa.int64())),
            "groups": pa.array([groups, *none], pa.list_(pa.string())),
            "one": pa.array([docs_of.astype(np.int32).tobytes(), *(x.tobytes() for _, x, _, _ in slices)], pa.binary()),
            "two": pa.array([(key & ((1 << _DOC) - 1)).astype(np.int32).tobytes(), *(x.tobytes() for _, _, x, _ in slices)], pa.binary()),
            "three": pa.array([n.tobytes(), *(x.astype(np.int64).tobytes() for *_, x in slices)], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_ROW = "block long, stripe int, ids array<long>, stats array<long>, groups array<string>, one binary, two binary, three binary"
_PART = "stripe int, a binary, b binary, n binary"


def _ints(data: bytes, kind: str = "i4") -> np.ndarray:
    return np.frombuffer(data, dtype=f"<{kind}")


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that come sorted by the keys, a run of equal keys at a time; only one row is held."""
    rows = (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist())
    return ((key, own) for key, own in groupby(rows, key=lambda r: tuple(r[k] for k in keys)))


def _encoded(docs: DataFrame, path_a: str, path_b: str, stripes: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        block = _Block(both, stripes, SEGMENT)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                block.add(doc_id, text.as_py())
                if block.size >= BLOCK or len(block.ids) >= 1 << 16:
                    yield from workers.parts(block.rows(number), 64)
                    number, block = number + 1, _Block(both, stripes, SEGMENT)
        if block.ids:
            yield from workers.parts(block.rows(number), 64)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scratch.keep(rows.mapInArrow(encode, _ROW), "blocks")


def _filled(pairs: DataFrame, by: list[str], n_a: int, best: bool) -> DataFrame:
    """Sums the counts of each run of ``by`` in a dense matrix; its counts that aren't 0, those highest for their B id negative if ``best``."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        matrix = np.zeros((ROWS, n_a), dtype=np.int64)
        flat = matrix.ravel()
        for key, rows in _runs(batches, *by):
            for r in rows:
                np.add.at(flat, _ints(r["b"]).astype(np.int64) * n_a + _ints(r["a"]), _ints(r["n"], "i8"))
            at = np.flatnonzero(flat)
            b, a, n = (at // n_a).astype(np.int32), (at % n_a).astype(np.int32), flat[at]
            if best:
                n = np.where(n == matrix.max(axis=1)[b], -n, n)
            flat[at] = 0
            yield pa.RecordBatch.from_pydict({"stripe": pa.array([key[0]], pa.int32()), "a": [a.tobytes()], "b": [b.tobytes()], "n": [n.tobytes()]})

    return pairs.repartition(*by).sortWithinPartitions(*by).mapInArrow(fill, _PART)


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    spark = docs.sparkSession
    both = Aligner(path_a, path_b)
    n_a, stripes = both.n_a, -(-both.n_b // ROWS)
    with scratch.brief(spark):
        blocks = _encoded(docs, path_a, path_b, stripes)
        parts = max(1, -(-blocks.where("stripe < 0").count() // BLOCKS_A_PART))
        part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part")
        pairs = blocks.where("stripe >= 0").select("stripe", part, "block", F.col("one").alias("a"), F.col("two").alias("b"), F.col("three").alias("n"))
        counts = _filled(_filled(pairs.select("stripe", "part", "a", "b", "n"), ["stripe", "part"], n_a, False), ["stripe"], n_a, True)
        counts = scratch.keep(counts, "counts")

        # a stripe's counts come before the blocks that ask for them
        every = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).cast("long").alias("block"), "a", "b", "n")
        asked = every.unionByName(pairs).repartition("stripe", "part").sortWithinPartitions("stripe", "part", "block")

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            workers.release()
            flat, filled = np.zeros(ROWS * n_a, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for _, rows in _runs(batches, "stripe", "part"):
                for r in rows:
                    at = _ints(r["b"]).astype(np.int64) * n_a + _ints(r["a"])
                    if r["block"] == -1:
                        flat[filled] = 0
                        flat[at], filled = _ints(r["n"], "i8"), at
                    else:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]], pa.int64()), "stripe": pa.array([r["stripe"]], pa.int32()), "count": [flat[at].tobytes()]})

        answers = asked.mapInArrow(answer, "block long, stripe int, count binary")
        none = lambda kind: F.lit(None).cast(kind)
        answers = answers.select("block", "stripe", none("array<long>").alias("ids"), none("array<long>").alias("stats"), none("array<string>").alias("groups"), none("binary").alias("one"), none("binary").alias("two"), F.col("count").alias("three"))
        whole = blocks.where("stripe < 0").unionByName(answers).repartition("block").sortWithinPartitions("block", "stripe")
        return scratch.keep(whole.mapInArrow(_scored, _RESULT), "aligned", outer=True)


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's row, then its answers by stripe, which is the order of its pairs."""
    workers.release()
    for _, rows in _runs(batches, "block"):
        block = next(rows)
        count = np.concatenate([np.zeros(0, dtype=np.int64), *(_ints(r["three"], "i8") for r in rows)])
        docs_of, slot, n = _ints(block["one"]), _ints(block["two"]), _ints(block["three"], "i8")
        count = np.repeat(count, docs_of)
        m = len(block["ids"])
        best, total = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        np.add.at(best, slot, n * (count < 0))
        np.add.at(total, slot, n * np.abs(count))
        stats = np.array(block["stats"], dtype=np.int64).reshape(m, 4)
        columns = [pa.array(block["ids"], pa.int64()), *map(pa.array, stats.T.copy()), pa.array(best), pa.array(total), pa.array(block["groups"], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RESULT.split(", ")])
