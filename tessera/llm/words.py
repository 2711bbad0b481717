"""Words of many texts at once, found and hashed by array.

A word is a maximal run of bytes other than the ASCII blanks \\x20 and \\x09-\\x0D,
the same as ``[^\\x20\\x09-\\x0D]+`` on code points, as no other character's UTF-8
form holds these bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that array operations cover at a time; a longer text is taken alone.
BYTES_AT_A_TIME = 1 << 20
#: Salt of a word's second hash.
SECOND = 77
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of each 64-bit value over all others (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Spans of so many bytes and more are hashed one by one, by the library.
_LONG = 256
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_ONE, _TWO, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Spans:
    """64-bit hashes of spans of a byte array: equal spans have equal hashes wherever they stand.

    Eight bytes at a time go through a chain of mixing steps, each a bijection of what came before, so that
    no arithmetic structure of the bytes cancels out.  Another salt gives another, independent chain.
    """

    def __init__(self, data: np.ndarray):
        self.raw = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        self.eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=self.raw, strides=(1,))  # eight bytes from each byte on

    def hashes(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        size = ends - starts
        h = mix(size.astype(np.uint64) * _TWO + np.uint64((salt * 2 + 1) * int(_ONE) & (1 << 64) - 1))
        h = mix((h ^ (self.eight[starts] & _KEEP[np.minimum(size, 8)])) * _STEP)
        own, done = np.flatnonzero(size > 8), 8
        if not len(own):
            return h
        far = size[own] >= _LONG
        if far.any():
            from xxhash import xxh3_64_intdigest

            for i in own[far].tolist():
                h[i] = xxh3_64_intdigest(self.raw[starts[i] : ends[i]].tobytes(), salt)
            own = own[~far]
        while len(own):
            h[own] = mix((h[own] ^ (self.eight[starts[own] + done] & _KEEP[np.minimum(size[own] - done, 8)])) * _STEP)
            done += 8
            own = own[size[own] > done]
        return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    return Spans(data).hashes(starts, ends, salt)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two neighbours' hashes."""
    return mix(a * _ONE + (b ^ _STEP) * _TWO)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of h[i:i + width] for each i, built from windows of 1, 2, 4, ... values; the last ones, with fewer values, mean nothing."""
    shifted = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), dtype=np.uint64)])
    part, size, out, have = mix(h ^ _STEP), 1, None, 0
    while True:
        if width & size:
            out = part if out is None else _pair(out, shifted(part, have))
            have += size
        if have == width:
            return mix(out + np.uint64(width))
        part, size = _pair(part, shifted(part, size)), size * 2


class Words:
    """The words of a batch of texts: byte spans, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = BLANK):
        """data: UTF-8 bytes of all texts; offsets: where each text begins in it, and the end; between: the bytes that part words."""
        self.data = _LOWER[data] if lower else data
        n = len(data)
        blank = between[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.ones(n + 1, dtype=bool)
        before[1:] = blank
        solid = np.append(~blank, False)
        self.starts = np.flatnonzero(solid & (before | edge))
        last = np.append(blank, True) | edge  # at a word's end, or further
        self.ends = np.flatnonzero(last[1:] & ~blank) + 1
        self.cuts = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.cuts)
        self._spans: Spans | None = None

    def hashes(self, salt: int = 0) -> np.ndarray:
        """A hash of each word; words of different bytes agree under two salts with a chance of 2**-128."""
        if self._spans is None:
            self._spans = Spans(self.data)
        return self._spans.hashes(self.starts, self.ends, salt)

    def wholes(self) -> np.ndarray:
        """Two numbers for each text: a 128-bit hash of all its words."""
        from xxhash import xxh3_128_digest

        both = np.stack([self.hashes(), self.hashes(SECOND)], axis=1)
        digests = b"".join(xxh3_128_digest(both[a:b].tobytes()) for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True))
        return np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)

    def positions(self) -> np.ndarray:
        """Each word's number in its text, from 0."""
        return np.arange(len(self.starts)) - np.repeat(self.cuts[:-1], self.counts)

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each followed by one blank: the bytes, and where each word begins."""
        size = self.ends - self.starts + 1
        at = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=at[1:])
        data = np.append(self.data, np.uint8(32))
        take = np.arange(at[-1]) + np.repeat(self.starts - at[:-1], size)
        out = data[np.minimum(take, len(data) - 1)]
        out[at[1:] - 1] = 32
        return out, at[:-1]

    def room(self) -> np.ndarray:
        """How many words follow in its text from each word on, itself included."""
        return np.repeat(self.cuts[1:], self.counts) - np.arange(len(self.starts))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = BYTES_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """Parts of the batch in order, of at most ``most`` bytes of text each, or one row."""
    _, at = utf8(batch.column(column))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def take(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of a byte array as a binary column."""
    size = ends - starts
    at = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    out = data[np.arange(at[-1]) + np.repeat(starts - at[:-1], size)]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(out)]).cast(pa.binary())
