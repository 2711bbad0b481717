"""What a Python worker keeps between tasks: one kind of thing at a time, so that a worker's memory is that of one step."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

_KEPT: dict[tuple[str, str], object] = {}


def kept(kind: str, name: str, make: Callable[[], object]):
    """The thing that ``make`` gave for (kind, name) in this process, made at the first call."""
    if (kind, name) not in _KEPT:
        release()
        _KEPT[kind, name] = make()
    return _KEPT[kind, name]


def release() -> None:
    """Drops what earlier tasks left in this process; steps that keep nothing call it when they begin."""
    if _KEPT:
        _KEPT.clear()
    pa.default_memory_pool().release_unused()


def parts(batch: pa.RecordBatch, rows: int = 1 << 16):
    """The batch in parts of at most so many rows: either side of the pipe holds a part whole."""
    for a in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(a, rows)
