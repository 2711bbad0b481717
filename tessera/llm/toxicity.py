"""Operator 2: toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Features of a text, present or not: each word (lower-cased, parted at ASCII blanks and
punctuation) and its stems, each pair of neighbours, and each pair with one word
between, hashed into ``2**bits`` coordinates.  FTRL-proximal keeps a rate for each coordinate
and an L1 pull to zero, so that the model is a short list of weights: it is broadcast,
and its size is bounded by ``2**bits`` whatever the data.

Learning reads a bounded sample of the labelled rows (``max_rows``, the rows with the
smallest hashes of their ids): it is one online pass after another over that sample
in a single task.  The sample's features are a file in the shared folder that the task
streams in each pass, so that its memory is the model's, however long the texts are.
Scoring covers every text, whole, without a shuffle.

Cases: a null or empty text has no features and scores the bias alone; null labels
are not learned from; without labels, or with one class only, the model is the bias;
rows may repeat: each is scored, and equal ones are one example.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files, scratch, workers
from .words import BLANK, Spans, Words, mix, slices, utf8

_PARTS = BLANK.copy()
_PARTS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
#: Distance of the second word of a pair from the first: neighbours, and skip-grams over one word.
_GAPS = (1, 2)
#: Bytes of a word that stand for its stem; inflected and compounded forms of a slur share one.
_STEMS = (4, 5, 6)


@dataclass(frozen=True)
class Model:
    """Sparse weights: coordinates, their weights, and the bias."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every feature of every text; a feature may come more than once."""
    w = Words(*utf8(column), lower=True, between=_PARTS)
    h, room, spans = w.hashes(), w.room(), Spans(w.data)
    row = np.repeat(np.arange(len(w.counts)), w.counts)
    rows, keys = [row], [h]
    for size in _STEMS:
        i = np.flatnonzero(w.ends - w.starts > size)
        rows.append(row[i])
        keys.append(spans.hashes(w.starts[i], w.starts[i] + size))
    for gap in _GAPS:
        i = np.flatnonzero(room > gap)
        rows.append(row[i])
        keys.append(mix(h[i] * np.uint64(3) + h[i + gap] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(gap)))
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)


class Examples:
    """(features, label) of a sample, from a file of all features one after another; a few million values are in memory at a time."""

    def __init__(self, path: str, bounds: list[int], labels: list[int]):
        self.path, self.bounds, self.labels = path, bounds, labels

    def __iter__(self) -> Iterator[tuple[np.ndarray, int]]:
        read, at, i = files.reader(self.path, np.dtype("<i4")), self.bounds, 0
        while i < len(self.labels):
            j = i + 1
            while j < len(self.labels) and at[j + 1] - at[i] <= 1 << 22:
                j += 1
            own = np.array(read(at[i], at[j]))
            for k in range(i, j):
                yield own[at[k] - at[i] : at[k + 1] - at[i]], self.labels[k]
            i = j


def ftrl(examples: Iterable[tuple[np.ndarray, int]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, positive: float = 1.0) -> Model:
    """Online FTRL-proximal; the bias is the last coordinate, without L1. positive: weight of examples with label 1."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    pull = np.full(size + 1, l1)
    pull[size] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= pull[i], 0.0, -(zi - np.sign(zi) * pull[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for own, label in examples:
            i = np.append(own, size)
            w = weights(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - label) * (positive if label else 1.0)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    index = np.flatnonzero(w[:size])
    return Model(bits, index.astype(np.int32), w[index].astype(np.float32), float(w[size]))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    allowed: Column | None = None,
    max_rows: int = 8192,
    bits: int = 20,
    alpha: float = 3.0,
    beta: float = 1.0,
    l1: float = 8.0,
    l2: float = 0.0,
    epochs: int = 6,
    positive: float = 3.0,
) -> Model:
    """Learns from at most max_rows of the labels that ``allowed`` (a condition on doc_id) admits."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    if allowed is not None:
        known = known.where(allowed)
    order = F.xxhash64("doc_id", "label")
    sample = known.withColumn("_order", order).orderBy("_order", "doc_id", "label").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # max_rows rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for whole in batches:
            for batch in slices(whole, "text"):
                row, key = features(batch.column("text"), bits)
                pairs = np.unique(row * (np.int64(1) << bits) + key)
                row, key = pairs >> bits, (pairs & ((1 << bits) - 1)).astype(np.int32)
                at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                cols = [batch.column(c) for c in example] + [pa.ListArray.from_arrays(pa.array(at), pa.array(key))]
                yield pa.RecordBatch.from_arrays(cols, names=[*example, "features"])

    example = ["_order", "doc_id", "label", "row"]
    found = texts.select("_order", "doc_id", "label", F.xxhash64("text").alias("row"), "text").mapInArrow(extract, "_order long, doc_id long, label int, row long, features array<int>")
    found = scratch.keep(found, "examples")
    # ids may repeat in docs: the bound holds for what the task learns from
    chosen = found.select(*example).distinct().orderBy(*example).limit(max_rows)
    chosen = found.join(F.broadcast(chosen), example).repartition(1).sortWithinPartitions(*example)  # max_rows rows
    folder = scratch.folder(spark, "features")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, bounds, known, last = files.Writer(f"{folder}/features.bin"), [0], [], None
        for batch in batches:
            lists = batch.column("features")
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k, own in enumerate(zip(*(batch.column(c).to_pylist() for c in example), strict=True)):
                if own != last:
                    out.write(flat[at[k] : at[k + 1]].astype("<i4").tobytes())
                    bounds.append(bounds[-1] + int(at[k + 1] - at[k]))
                    known.append(own[2])
                    last = own
        out.close()
        if known:
            m = ftrl(Examples(out.path, bounds, known), bits, alpha, beta, l1, l2, epochs, positive)
            yield pa.RecordBatch.from_pydict({"index": pa.array([m.index]), "weight": pa.array([m.weight]), "bias": pa.array([m.bias])})

    with scratch.small_batches(spark):
        fitted = chosen.mapInArrow(learn, "index array<int>, weight array<float>, bias double").collect()
    if not fitted:
        return Model(bits, np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    (m,) = fitted
    return Model(bits, np.array(m["index"], np.int32), np.array(m["weight"], np.float32), m["bias"])


def score_batch(column: pa.Array, model: Model, table: np.ndarray) -> np.ndarray:
    total = np.full(len(column), model.bias)
    row, key = features(column, model.bits)
    hit = np.flatnonzero(table[key])
    pairs = np.unique(row[hit] * (np.int64(1) << model.bits) + key[hit])
    np.add.at(total, pairs >> model.bits, table[pairs & ((1 << model.bits) - 1)])
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0)))


def score(docs: DataFrame, model: Model, out: str = "score", text_col: str = "text") -> DataFrame:
    """Adds the probability of the label to each row, in place of a column of that name if there is one; no other column goes to Python."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        workers.release()
        m = held.value
        table = np.zeros(1 << m.bits, dtype=np.float32)
        table[m.index] = m.weight
        for column in batches:
            parts = slices(pa.RecordBatch.from_arrays([column], names=["text"]), "text")
            yield pa.array(np.concatenate([np.zeros(0), *(score_batch(p.column("text"), m, table) for p in parts)]))

    return docs.withColumn(out, probability(F.col(text_col)))
