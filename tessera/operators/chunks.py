"""Splitting files into chunks: by symbol where the language is known, else by size with overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import chunk_id
from ..settings import get_settings
from .symbols import python_symbols, script_symbols

#: Separators to split at, from coarse to fine, by language. Fixed values.
SEPARATORS = {
    "python": ["\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""],
    "javascript": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", "\n\n", "\n", " ", ""],
    "go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "ruby": ["\ndef ", "\nclass ", "\nif ", "\nunless ", "\nwhile ", "\nfor ", "\ndo ", "\nbegin ", "\nrescue ", "\n\n", "\n", " ", ""],
}
DEFAULT_SEPARATORS = ["\n\n", "\n", " ", ""]
_BY_SUFFIX = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript", ".go": "go", ".rb": "ruby"}
_AST = {".py": lambda content, _: python_symbols(content)} | dict.fromkeys((".js", ".jsx", ".ts", ".tsx"), script_symbols)
CHUNK = "chunk_seq int, content string, start_index int, symbol_name string, symbol_type string, start_line int, end_line int, docstring string, sub_chunk int"


def split_text(text: str, size: int, overlap: int, separators: list[str]) -> list[tuple[int, str]]:
    """(start, piece) of stripped pieces of at most ``size`` characters that overlap by at most ``overlap``.

    A text is parted at the first separator that occurs in it (the separator goes with what follows);
    parts that are still too long are parted by the finer ones; neighbours are then merged greedily.
    """

    def parts(a: int, b: int, seps: list[str]) -> list[tuple[int, int]]:
        if b - a <= size:
            return [(a, b)]
        for k, sep in enumerate(seps):
            if not sep:
                return [(i, min(i + 1, b)) for i in range(a, b)]
            if text.find(sep, a, b) < 0:
                continue
            cuts, at = [a], text.find(sep, a, b)
            while at >= 0:
                if at > cuts[-1]:
                    cuts.append(at)
                at = text.find(sep, at + len(sep), b)
            return [p for x, y in zip(cuts, [*cuts[1:], b], strict=True) for p in parts(x, y, seps[k + 1 :])]
        return [(i, min(i + size, b)) for i in range(a, b, size)]

    out: list[tuple[int, str]] = []

    def emit(a: int, b: int) -> None:
        piece = text[a:b]
        if piece.strip():
            out.append((a + len(piece) - len(piece.lstrip()), piece.strip()))

    window: list[tuple[int, int]] = []
    for a, b in parts(0, len(text), separators):
        if window and b - window[0][0] > size:
            emit(window[0][0], window[-1][1])
            while window and (b - window[0][0] > size or window[-1][1] - window[0][0] > overlap):
                window.pop(0)
        window.append((a, b))
    if window:
        emit(window[0][0], window[-1][1])
    return out


def split_file(content: str, file_type: str, size: int, overlap: int, by_symbol: bool = True) -> list[tuple]:
    """Rows of CHUNK for one file."""
    separators = SEPARATORS.get(_BY_SUFFIX.get(file_type, ""), DEFAULT_SEPARATORS)
    found = _AST[file_type](content, file_type) if by_symbol and file_type in _AST else []
    rows: list[tuple] = []
    for s in found:
        pieces = [(None, s["text"])] if len(s["text"]) <= 2 * size else split_text(s["text"], size, overlap, separators)
        for k, (_, piece) in enumerate(pieces):
            rows.append((piece, None, s["name"], s["kind"], s["start_line"], s["end_line"], s["docstring"], k if len(pieces) > 1 else None))
    if not found:
        rows = [(piece, at, None, None, None, None, None, None) for at, piece in split_text(content, size, overlap, separators)]
    return [(k, *r) for k, r in enumerate(rows)]


def split_documents(files: DataFrame, size: int | None = None, overlap: int | None = None, by_symbol: bool = True) -> DataFrame:
    """Chunks of files (repo_name, file_path, file_type, content, ...): other columns are carried over, with chunk_index and chunk_id.

    The splitter is one Arrow-batched pass; files don't move.
    """
    s = get_settings()
    size, overlap = size or s.chunk_size, s.chunk_overlap if overlap is None else overlap
    shape = f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in CHUNK.split(', '))}>>"

    @F.arrow_udf(shape)
    def split(content, kind):
        import pyarrow as pa

        names = [c.split()[0] for c in CHUNK.split(", ")]
        rows = [[dict(zip(names, r, strict=True)) for r in split_file(c or "", t or "", size, overlap, by_symbol)] for c, t in zip(content.to_pylist(), kind.to_pylist(), strict=True)]
        kinds = {"int": pa.int32(), "string": pa.string()}
        return pa.array(rows, pa.list_(pa.struct([(c.split()[0], kinds[c.split()[1]]) for c in CHUNK.split(", ")])))

    carried = [c for c in files.columns if c not in ("content", "chunk_index", "chunk_id")]
    out = files.select(*carried, F.explode(split(F.col("content"), F.col("file_type"))).alias("_c")).select(*carried, "_c.*")
    out = out.withColumnRenamed("chunk_seq", "chunk_index")
    return out.withColumn("chunk_id", chunk_id("repo_name", "file_path", "chunk_index"))


def chunk_ids_per_file(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_ids) in order of chunk_index."""
    from ..functions.ids import file_id

    pairs = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id")))
    return chunks.groupBy(file_id("repo_name", "file_path").alias("doc_id")).agg(F.transform(pairs, lambda x: x["chunk_id"]).alias("chunk_ids"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks by repository, split by symbol or by size."""
    return chunks.groupBy("repo_name").agg(F.count("*").alias("chunks"), F.count("symbol_name").alias("symbol_chunks"), F.sum(F.expr("if(symbol_name is null, 1, 0)")).alias("size_chunks"))


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, repositories and files of the index."""
    return chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct("repo_name").alias("total_repos"), F.countDistinct("file_path").alias("total_files"))

