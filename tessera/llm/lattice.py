"""Operator 7: language-model scores by subword lattices.

An existing subword vocabulary gives the pieces; their unigram probabilities are
learned from the training documents, smoothed, with an end symbol for documents: at
first from the vocabulary's own segmentation of each distinct word, weighted by the
word's count, then by rounds of forward-backward over the words' lattices (expectation
maximisation), so that they are the lattices' own.  A word's probability is the sum
over all its segmentations into pieces, by a forward recursion in log space over its
UTF-8 bytes; single bytes are pieces too, so no text has probability zero.  A
document's score is the log10 of the product over its words and its end.

Each distinct word goes through the lattice once, in the table of distinct words.
Words with a share of ``head_share`` or more of all tokens (so at most 1 / head_share
of them) are broadcast; all other occurrences join the table by a shuffle.  So nothing
that grows with the vocabulary is broadcast or collected, and the joined words are
rare ones, without a hot key.

A word-unigram score with additive smoothing (``base_score``) comes from the same
table of counts.

Cases: a null or empty text is the end symbol alone; a null doc_id is not learned from
and not held out; rows may repeat, each is scored (and learned from); without training
documents all counts are zero and pieces equally likely; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, workers
from .words import SECOND, Spans, Words, slices, span_hashes, take, utf8

SMOOTH = 0.1
#: Words of a partition that are summed before they are sent on.
_HELD = 1 << 19


@dataclass(frozen=True)
class Pieces:
    """Natural log probabilities of pieces as byte strings (a blank marks a word's beginning), and of the end."""

    text: list[bytes]
    logp: np.ndarray
    end: float


@cache
def _vocabulary(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text: list[bytes | None] = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            text.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            text.append(None)
        else:
            text.append(sp.id_to_piece(i).replace("▁", " ").encode())
    return sp, text


def _sum_by(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each first stands, and column sums of the values."""
    key, value = np.concatenate(keys), np.concatenate(values)
    u, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    out = np.zeros((len(u), value.shape[1]), dtype=np.int64)
    for c in range(value.shape[1]):
        out[:, c] = np.bincount(inverse, weights=value[:, c], minlength=len(u)).astype(np.int64)
    return u, at, out


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n_train, n_all) of (text, train): lower-cased words, summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        words: list[pa.Array] = []
        held = 0
        workers.release()

        def merged():
            u, at, total = _sum_by(keys, sums)
            return u, pa.concat_arrays(words).take(pa.array(at)), total

        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(*utf8(batch.column("text")), lower=True)
                train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), w.counts)
                h = w.hashes()
                u, at, total = _sum_by([h], [np.stack([train.astype(np.int64), np.ones(len(h), dtype=np.int64)], axis=1)])
                keys.append(u)
                sums.append(total)
                words.append(take(w.data, w.starts[at], w.ends[at]))
                held += len(u)
                if held > _HELD:
                    u, text, total = merged()
                    keys, sums, words, held = [u], [total], [text], len(u)
                    if held > _HELD // 2:
                        yield from workers.parts(pa.RecordBatch.from_arrays([text, pa.array(total[:, 0]), pa.array(total[:, 1])], names=["word", "n_train", "n_all"]))
                        keys, sums, words, held = [], [], [], 0
        if keys:
            _, text, total = merged()
            yield from workers.parts(pa.RecordBatch.from_arrays([text, pa.array(total[:, 0]), pa.array(total[:, 1])], names=["word", "n_train", "n_all"]))

    parts = texts.select("text", "train").mapInArrow(count, "word binary, n_train long, n_all long")
    return parts.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def learn_pieces(counts: DataFrame, vocabulary: str, n_docs: int, smooth: float = SMOOTH, rounds: int = 1) -> Pieces:
    """Unigram probabilities of the vocabulary's pieces from words and their training counts."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, text = _vocabulary(vocabulary)
        total = np.zeros(len(text), dtype=np.int64)
        for batch in batches:
            words = [x.decode("utf-8", "replace") for x in batch.column("word").to_pylist()]
            ids = sp.encode(words, num_threads=1)
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            n = np.repeat(batch.column("n_train").to_numpy(), size)
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(size.sum()))
            total += np.bincount(flat, weights=n, minlength=len(text)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

    _, text = _vocabulary(vocabulary)
    known = counts.where("n_train > 0").select("word", "n_train")
    with scratch.small_batches(counts.sparkSession):
        got = known.mapInArrow(segment, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece of the vocabulary at most
    n = np.zeros(len(text))
    for r in got:
        n[r["piece"]] += r["n"]
    joint: dict[bytes, float] = {}
    for t, x in zip(text, n.tolist(), strict=True):  # a byte may also be a piece of its own
        if t:
            joint[t] = joint.get(t, 0.0) + x
    names = list(joint)
    pieces = _smoothed(names, np.array(list(joint.values())), n_docs, smooth)
    for _ in range(rounds):
        pieces = _smoothed(names, expected_counts(known, pieces), n_docs, smooth)
    return pieces


def _smoothed(names: list[bytes], n: np.ndarray, n_docs: int, smooth: float) -> Pieces:
    n = n + smooth
    whole = float(n.sum()) + n_docs + smooth
    return Pieces(names, np.log(n / whole), float(np.log((n_docs + smooth) / whole)))


def expected_counts(words: DataFrame, pieces: Pieces) -> np.ndarray:
    """How often each piece is expected in (word, n_train), over all segmentations of each word; in millionths of a count, so that any order of adding gives the same."""
    held = words.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        model = Lattice(held.value)
        total = np.zeros(len(held.value.text))
        for batch in batches:
            total += model.expected(batch.column("word"), batch.column("n_train").to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.rint(total[some] * 1e6).astype(np.int64))], names=["piece", "n"])

    out = np.zeros(len(pieces.text))
    with scratch.small_batches(words.sparkSession):
        for r in words.mapInArrow(expect, "piece long, n long").groupBy("piece").agg((F.sum(F.col("n").cast("double")) / 1e6).alias("n")).collect():  # the vocabulary's rows
            out[r["piece"]] = r["n"]
    return out


class Lattice:
    """Marginal log probabilities of many words at once."""

    def __init__(self, pieces: Pieces):
        data = np.frombuffer(b"".join(pieces.text), dtype=np.uint8)
        end = np.cumsum([len(t) for t in pieces.text])
        key = span_hashes(data, np.append(0, end[:-1]), end)
        self.order = np.argsort(key)
        self.key, self.logp = key[self.order], pieces.logp[self.order]
        self.sizes = sorted({len(t) for t in pieces.text})
        self.bits = 20
        self.first = np.searchsorted(self.key >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are pieces', the pieces' places in the sorted table)."""
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        own = np.flatnonzero(at < stop)
        hits, places = [], []
        while len(own):
            same = self.key[at[own]] == h[own]
            hits.append(own[same])
            places.append(at[own[same]])
            own = own[~same]
            at[own] += 1
            own = own[at[own] < stop[own]]
        return (np.concatenate(hits), np.concatenate(places)) if hits else (own, own)

    def _blocks(self, column: pa.Array):
        """Bytes with a blank at each word's beginning, and in blocks, from long words to short: which words, where they begin, their sizes."""
        data, at = utf8(column.cast(pa.large_binary()).view(pa.large_string()))
        size = np.diff(at)
        data = np.insert(data, at[:-1], 32)  # the mark of a word's beginning
        start, size = at[:-1] + np.arange(len(size)), size + 1
        order = np.argsort(-size, kind="stable")
        for block in np.array_split(order, max(1, int(size.sum()) // 200_000)):
            if len(block):
                yield data, block, start[block], size[block]

    def words(self, column: pa.Array) -> np.ndarray:
        """Natural log probability of each word of a binary column."""
        out = np.zeros(len(column))
        for data, block, start, size in self._blocks(column):
            out[block] = self._forward(data, start, size)[0]
        return out

    def expected(self, column: pa.Array, n: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words that come n times."""
        out = np.zeros(len(self.key))
        for data, block, start, size in self._blocks(column):
            whole, reach, arcs = self._forward(data, start, size, keep=True)
            rest = np.full(reach.shape, -np.inf)  # log probability of what follows, from each place on
            rest[size, np.arange(len(size))] = 0.0
            for j, k, hit, piece in reversed(arcs):
                through = self.logp[piece] + rest[j, hit]
                rest[j - k, hit] = np.logaddexp(rest[j - k, hit], through)
                out += np.bincount(piece, weights=np.exp(reach[j - k, hit] + through - whole[hit]) * n[block[hit]], minlength=len(out))
        given = np.empty(len(out))
        given[self.order] = out
        return given

    def _forward(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
        """Of words from the longest to the shortest: log probabilities, those of each beginning, and, to keep, the lattices' arcs (end, length, words, pieces)."""
        longest = int(size[0])
        reach = np.full((longest + 1, len(size)), -np.inf)
        reach[0] = 0.0
        lo = int(start.min())
        own = data[lo : int((start + size).max())]
        if len(own) > 4 * int(size.sum()) + 1024:  # far apart: bring them together
            gather = np.arange(int(size.sum())) + np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size)
            own, start = data[gather], np.append(0, np.cumsum(size)[:-1])
            lo = 0
        start = start - lo
        spans, arcs = Spans(own), []
        for j in range(1, longest + 1):
            n = int(np.searchsorted(-size, -j, side="right"))
            now = reach[j]
            for k in self.sizes:
                if k > j:
                    break
                at = start[:n] + (j - k)
                hit, piece = self._find(spans.hashes(at, at + k))
                if len(hit):
                    now[hit] = np.logaddexp(now[hit], reach[j - k, hit] + self.logp[piece])
                    if keep:
                        arcs.append((j, k, hit, piece))
        return reach[size, np.arange(len(size))], reach, arcs


def score_documents(docs: DataFrame, vocabulary: str, held_out: Column, head_share: float = 1e-6, smooth: float = SMOOTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(doc_id.alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out")).withColumn("train", ~F.col("held_out") & F.col("doc_id").isNotNull())
    with scratch.brief(spark):
        counts = scratch.keep(count_words(texts), "word-counts")
        n_docs = texts.where("train").count()
        n = counts.agg(F.sum("n_train").alias("tokens"), F.sum("n_all").alias("every"), F.sum(F.expr("if(n_train > 0, 1, 0)")).alias("types")).first()
        tokens = (n["tokens"] or 0) + n_docs
        bottom = np.log10(tokens + smooth * ((n["types"] or 0) + (n_docs > 0) + 1))
        pieces = spark.sparkContext.broadcast(learn_pieces(counts, vocabulary, n_docs))  # as large as the vocabulary

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            workers.release()
            model = Lattice(pieces.value)
            for batch in batches:
                word, c = batch.column("word"), batch.column("n_train").to_numpy()
                w = Words(*utf8(word.cast(pa.large_binary()).view(pa.large_string())))
                cols = [pa.array(w.hashes().view(np.int64)), pa.array((w.hashes(SECOND) >> np.uint64(32)).astype(np.uint32).view(np.int32))]
                cols += [batch.column("n_train"), batch.column("n_all"), pa.array(np.log10(c + smooth) - bottom), pa.array(model.words(word) / np.log(10))]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "g", "n_train", "n_all", "base", "lattice"])

        lexicon = scratch.keep(counts.mapInArrow(weigh, "h long, g int, n_train long, n_all long, base double, lattice double"), "lexicon", outer=True)

    often = max(2.0, (n["every"] or 0) * head_share)
    head = lexicon.where(F.col("n_all") >= often).select("h", "base", "lattice", F.col("n_train") > 0).toArrow()  # 1 / head_share rows at most
    h = head.column(0).to_numpy().view(np.uint64)
    order = np.argsort(h)
    table = spark.sparkContext.broadcast((h[order], *(np.asarray(head.column(k).to_numpy(), dtype=np.float64)[order] for k in (1, 2, 3))))
    end = (float(np.log10(n_docs + smooth) - bottom), pieces.value.end / np.log(10), int(n_docs > 0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with the sums over its frequent words, and one for each other word in it."""
        from pyspark import TaskContext

        known, *values = table.value
        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text"):
                m = batch.num_rows
                w = Words(*utf8(batch.column("text")), lower=True)
                h, row = w.hashes(), np.repeat(np.arange(m), w.counts)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                common = known[at] == h if len(known) else np.zeros(len(h), dtype=bool)
                sums = [np.bincount(row[common], weights=v[at[common]], minlength=m) + e for v, e in zip(values, end, strict=True)]
                nulls = lambda kind: pa.nulls(m, kind)
                ids = uid + np.arange(m)
                cols = [pa.array(ids), batch.column("doc_id"), batch.column("held_out"), pa.array(w.counts.astype(np.int64) + 1), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])]
                names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "h", "g", "tf"]
                yield pa.RecordBatch.from_arrays([*cols, nulls(pa.int64()), nulls(pa.int32()), nulls(pa.int64())], names=names)
                rare = np.flatnonzero(~common)
                if len(rare):
                    g = (w.hashes(SECOND)[rare] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    line = np.lexsort((g, h[rare], row[rare]))
                    key = np.stack([row[rare][line], h[rare][line].view(np.int64), g[line].astype(np.int64)], axis=1)
                    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
                    tf = np.diff(np.append(first, len(rare)))
                    k, no = len(first), [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                    cols = [pa.array(ids[key[first, 0]]), *(pa.nulls(k, t) for t in no), pa.array(key[first, 1]), pa.array(key[first, 2].astype(np.int32)), pa.array(tf)]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                uid += m

    shape = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, h long, g int, tf long"
    found = scratch.keep(texts.select("doc_id", "text", "held_out").mapInArrow(score, shape), "scored")
    rest = lexicon.where(F.col("n_all") < often).select("h", "g", "n_train", F.col("base").alias("word_base"), "lattice")
    rare = found.where("tf is not null").select("uid", "h", "g", "tf").join(rest, ["h", "g"])
    rare = rare.groupBy("uid").agg(F.sum(F.expr("if(n_train > 0, tf, 0)")).alias("more_known"), F.sum(F.col("tf") * F.col("word_base")).alias("more_base"), F.sum(F.col("tf") * F.col("lattice")).alias("more_score"))
    out = found.where("tf is null").drop("h", "g", "tf").join(rare, "uid", "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + more("more_known")).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base")).alias("base_score"),
        (F.col("score") + more("more_score")).alias("score"),
    )
