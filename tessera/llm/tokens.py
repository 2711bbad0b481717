"""Operator 1: token ids as flat binary files with 64-bit document offsets.

Format, below one folder: for each part k

* ``tokens-k.bin``   ids, little-endian, 16 bits where the vocabulary allows it, else 32;
* ``offsets-k.bin``  64-bit: where each of the part's documents begins within the part, and the end;
* ``docs-k.bin``     64-bit document ids (the least 64-bit integer stands for null);
* ``manifest``       a Parquet table (part, n_docs, n_tokens, first_doc, first_token): one row a part.
                     first_doc and first_token are prefix sums over the parts before.

Parts and the documents in them ascend by doc_id, then by a hash of the text, null ids first (so that
rows of one id, null ones too, are dealt over parts).  A document's
place in the whole id stream is its part's first_token plus its offset.  All files are
flat, so a reader maps them into memory and needs no parsing.

Cases: a null text counts as an empty one and has the end id only; rows that share a
doc_id are kept as documents of their own; an empty table makes no parts; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, scratch
from .bpe import encoder

NULL_ID = np.iinfo(np.int64).min
_ROWS = 256
#: Characters that the encoder's arrays cover at a time.
_CHARS = 1 << 17
#: Rows of text that a scan holds at a time; Spark's 4096 make arrays of many MB, which the heap grows for.
_SCAN, _SCAN_ROWS = "spark.sql.parquet.columnarReaderBatchSize", "64"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, appends ``end_id`` and writes the files; returns the manifest.

    One shuffle brings the texts in order; ids go straight from the encoder to the files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, out = TaskContext.get().partitionId(), encoder(tokenizer), None
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = files.Writer(f"{folder}/tokens-{part:06d}.bin")
            end = np.array([end_id], dtype=enc.dtype)
            texts = enc.encode_many(batch.column("text").to_pylist(), _CHARS)
            out.write(np.concatenate([x for t in texts for x in (t, end)]).tobytes())
            lengths.append(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
            ids.append(batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        for name, data in (("offsets", offsets), ("docs", np.concatenate(ids).astype("<i8"))):
            w = files.Writer(f"{folder}/{name}-{part:06d}.bin")
            w.write(data.tobytes())
            w.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n_docs": pa.array([len(offsets) - 1], pa.int64()), "n_tokens": pa.array([offsets[-1]], pa.int64())})

    parts = rows.mapInArrow(write, "part long, n_docs long, n_tokens long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part, not for each document
    bases = parts.select("*", *(F.coalesce(F.sum(n).over(before), F.lit(0).cast("long")).alias(first) for n, first in (("n_docs", "first_doc"), ("n_tokens", "first_token"))))
    with scratch.small_batches(spark, _ROWS), scratch.setting(spark, _SCAN, _SCAN_ROWS):
        bases.write.parquet(f"{folder}/manifest")  # in one file: for each file that Spark writes, Hadoop without its native library starts processes
    return spark.read.schema(bases.schema).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, folder: str, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    spark = manifest.sparkSession
    n = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        small = Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16
        dtype = np.dtype("<u2" if small else "<u4")
        for batch in batches:
            for part, first in zip(batch.column("part").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                tokens, offsets, ids = (files.read_array(f"{folder}/{name}-{part:06d}.bin", d) for name, d in (("tokens", dtype), ("offsets", np.dtype("<i8")), ("docs", np.dtype("<i8"))))
                for a in range(0, len(ids), 4096):
                    at, own = np.asarray(offsets[a : a + 4097]), np.asarray(ids[a : a + 4096])
                    some = [tokens[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    cols = [
                        pa.array(own, mask=own == NULL_ID),
                        pa.array(first + at[:-1]),
                        pa.array(np.diff(at)),
                        pa.array([zlib.crc32(x.astype("<u4")) for x in some], pa.int64()),
                    ]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int32) for x in some], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return manifest.select("part", "first_token").repartitionByRange(n, "part").mapInArrow(read, schema)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the files below the shared folder and reads the documents back from them."""
    folder = scratch.folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id), folder, tokenizer)
