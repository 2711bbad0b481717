"""Byte-level BPE ids by the ``tokenizers`` library, with pre-tokens found and looked up by array.

The library spends most of a call on its own pre-tokenisation and offsets.  Here the
pre-tokens of a batch of texts are found with array operations on code points; each
distinct pre-token goes to the library's BPE model once and its ids are kept in a
bounded open-addressing table, keyed by a 64-bit hash; a hit counts if a second,
independent 64-bit hash agrees.  Texts with characters whose class may differ between
Unicode versions, with the string of an added token, or with a pre-token whose hashes
disagree go to the library as they are.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from . import workers

from .words import SECOND, Spans

#: Slots of a worker's table of known pre-tokens; it starts anew when half full, which bounds its memory.
SLOTS_LOG2 = 21
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = range(5)


@cache
def _classes() -> np.ndarray:
    """A class for each code point."""
    old, out = unicodedata.ucd_3_2_0.category, np.full(0x110000, _OTHER, dtype=np.uint8)
    for c in range(0x110000):
        if 0xAC00 < c < 0xD7A3 or 0x4E00 < c < 0x9FA5 or 0x20000 < c < 0x2A6D6:
            out[c] = _LETTER  # ranges that never changed
            continue
        if 0xE000 < c < 0xF8FF or c > 0x323AF:
            continue
        kind, was = unicodedata.category(chr(c))[0], old(chr(c))[0]
        if kind != was and (kind in "LN" or was in "LN"):
            out[c] = _UNSURE
        elif kind in "LN":
            out[c] = _LETTER if kind == "L" else _NUMBER
    out[_SPACES] = _SPACE
    return out


@cache
def _byte_alphabet() -> dict[int, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, other bytes move up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, up = {b: b for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = up
            up += 1
    return table


class _Table:
    """64-bit key -> entry number, by linear probing over arrays."""

    def __init__(self, log2: int):
        self.shift, self.mask = np.uint64(64 - log2), (1 << log2) - 1
        self.keys, self.entries, self.held = np.zeros(1 << log2, dtype=np.uint64), np.full(1 << log2, -1, dtype=np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry number of each key, -1 if there is none."""
        slot = (keys >> self.shift).astype(np.int64)
        got = self.entries[slot]
        wrong = np.flatnonzero((got >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            at = slot[wrong] = (slot[wrong] + 1) & self.mask
            got[wrong] = e = self.entries[at]
            wrong = wrong[(e >= 0) & (self.keys[at] != keys[wrong])]
        return got

    def put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Distinct keys that the table doesn't hold yet."""
        slot, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.entries[slot[left]] < 0
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(slot[left], return_index=True)[1]] = True
            now = left[free & first]
            self.keys[slot[now]], self.entries[slot[now]] = keys[now], entries[now]
            left = left[~(free & first)]
            taken = self.keys[slot[left]] != keys[left]
            slot[left[taken]] = (slot[left[taken]] + 1) & self.mask
        self.held += len(keys)


class Encoder:
    """Encodes texts to ids of ``dtype``; one per Python worker (see :func:`encoder`)."""

    def __init__(self, path: str, plain_specials: bool = False):
        """plain_specials: the strings of special tokens are ordinary text; by default they are their ids, as in the library."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        #: Strings that the library finds in a text before anything else.
        self.added = [] if plain_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._alphabet = _byte_alphabet()
        self._bare = Tokenizer(self.tokenizer.model)  # no pre-tokenizer: what it gets is one pre-token
        gap = self._alphabet[0xFF]  # no UTF-8 text has this byte and no merge has it, so nothing merges across it
        self._gap_id = self.tokenizer.token_to_id(chr(gap))
        self._start_anew()

    def _start_anew(self, room: int = 0) -> None:
        self._table = _Table(max(SLOTS_LOG2, (2 * room).bit_length()))
        self._pool, self._begin, self._length = np.zeros(1 << 20, dtype=self.dtype), np.zeros(1 << 18, dtype=np.int64), np.zeros(1 << 18, dtype=np.int32)
        self._check, self._used = np.zeros(1 << 18, dtype=np.uint64), 0

    def whole(self, text: str) -> np.ndarray:
        """The library's own ids of the text."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, pretokens: list[str]) -> None:
        """Keeps the ids of new pre-tokens. Many go to the BPE model in a call, with a byte between them that nothing merges with."""
        joined = [b"\xff".join(p.encode() for p in pretokens[i : i + 64]).decode("latin-1").translate(self._alphabet) for i in range(0, len(pretokens), 64)]
        ids = np.array([x for got in self._bare.encode_batch_fast(joined, add_special_tokens=False) for x in (*got.ids, self._gap_id)], dtype=self.dtype)
        gaps = np.flatnonzero(ids == self._gap_id)
        begin = np.concatenate([[0], gaps[:-1] + 1])
        n, held = len(keys), self._table.held
        for name, need in (("_begin", held + n), ("_length", held + n), ("_check", held + n), ("_pool", self._used + len(ids))):
            if need > len(a := getattr(self, name)):
                setattr(self, name, np.concatenate([a, np.zeros(max(need - len(a), len(a)), dtype=a.dtype)]))
        self._begin[held : held + n], self._length[held : held + n] = self._used + begin, gaps - begin
        self._check[held : held + n] = checks
        self._pool[self._used : self._used + len(ids)] = ids
        self._used += len(ids)
        self._table.put(keys, np.arange(held, held + n, dtype=np.int32))

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None], most: int = 1 << 20) -> list[np.ndarray]:
        """Ids of each text, in order; a null text is an empty one. Arrays cover about ``most`` characters at a time."""
        out: list[np.ndarray] = []
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text or "")
            size += len(part[-1])
            if size >= most:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part) if part else out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        n, ends = len(whole), np.cumsum(lengths)
        if not n:
            return [np.zeros(0, dtype=self.dtype) for _ in texts]
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _classes()[points]
        heads = ends - lengths
        first = np.zeros(n + 1, dtype=bool)  # of a text
        first[heads[lengths > 0]] = True
        first[n] = True
        start = first.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        # the last space character before something else stands alone or, if it is a blank, goes with what follows
        after = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n]) + 1
        start[after - 1] = True
        start[after[points[after - 1] == 32]] = False
        quote = np.flatnonzero((points[:-1] == 39) & start[: n - 1] & (kind[1:] == _LETTER) & ~first[1:n])
        if len(quote):
            self._contractions(points, kind, start, first, quote, n)
        begin = np.flatnonzero(start[:n])
        end = np.append(begin[1:], n)
        wide = points.astype(np.uint16) if points.max() < 1 << 16 else points
        size, spans = wide.itemsize, Spans(wide.view(np.uint8))
        keys, checks = (spans.hashes(begin * size, end * size, salt + size) for salt in (0, SECOND))
        entry = self._table.find(keys)
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            new, at = np.unique(keys[lost], return_index=True)
            if self._table.held + len(new) > 1 << (SLOTS_LOG2 - 1):
                new, at = np.unique(keys, return_index=True)
                self._start_anew(len(new))
                lost = np.arange(len(keys))
            self._learn(new, checks[lost[at]], [whole[b:e] for b, e in zip(begin[lost[at]].tolist(), end[lost[at]].tolist(), strict=True)])
            entry[lost] = self._table.find(keys[lost])
        count = self._length[entry]
        upto = np.zeros(len(begin) + 1, dtype=np.int64)
        np.cumsum(count, out=upto[1:])
        ids = self._pool[np.arange(upto[-1]) + np.repeat(self._begin[entry] - upto[:-1], count)]
        cuts = upto[np.searchsorted(begin, np.append(heads, n))]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        odd = np.append(np.flatnonzero(kind == _UNSURE), begin[self._check[entry] != checks])
        alone = set(np.searchsorted(ends, odd, side="right").tolist())
        if any(s in whole for s in self.added):
            alone.update(k for k, t in enumerate(texts) if any(s in t for s in self.added))
        for k in alone:
            out[k] = self.whole(texts[k])
        return out

    @staticmethod
    def _contractions(points, kind, start, first, quote, n) -> None:
        """'s 't 'm 'd 're 've 'll are pre-tokens of their own where an apostrophe starts one."""
        at = np.minimum(quote + 2, n - 1)
        one, two = points[quote + 1], np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], points[at], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True


def encoder(path: str) -> Encoder:
    """This process's encoder of the vocabulary file."""
    return workers.kept("encoder", path, lambda: Encoder(path))
