"""Texts that structured hashes take for equal: a Thue-Morse string and its complement agree under any polynomial modulo 2**64."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import DOCS, sentence
from tests.llm.test_dedup import brute_repeats, removed
from tests.llm.test_models import brute_base
from tests.llm.test_tokens_packing import crc
from tokenizers import Tokenizer

from tessera.llm import bpe, lattice, packing, shingles, tokens
from tessera.llm.queries import id_remainder, tokenizer_path
from tessera.llm.words import Spans, Words, utf8, window_hashes

MORSE = {n: "".join("ab"[i.bit_count() % 2] for i in range(n)) for n in (16, 200, 1024, 4096)}
PAIRS = [(x, x.translate(str.maketrans("ab", "ba"))) for x in MORSE.values()]


@pytest.fixture(scope="module")
def pair_rows():
    import random

    rnd, rows = random.Random(2), []
    for k, (x, y) in enumerate(PAIRS):
        same = sentence(rnd, 49)
        rows += [(10 * k + i, f"{same} {w}", "en", "a", 1, 0.5, "x", 1) for i, w in enumerate((x, y))]
    return rows


@pytest.fixture
def pair_docs(spark, pair_rows):
    return spark.createDataFrame(pair_rows, DOCS)


def test_word_hashes_differ():
    for x, y in PAIRS:
        w = Words(*utf8(pa.array([x, y, x, "z" + x, x + "z"])))
        for h in (w.hashes(), w.hashes(77)):
            assert h[0] == h[2] and len(set(h.tolist())) == 4
        assert (w.hashes() != w.hashes(77)).all()
        assert len({tuple(d) for d in w.wholes().tolist()}) == 4


def test_spans_hash_alike_wherever_they_stand():
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 40, dtype=np.uint8)
    s = Spans(data)
    for size in (0, 1, 7, 8, 9, 16, 17, 300):
        at = np.array([0, 26, 52, 3])
        h = s.hashes(at, at + size)
        assert h[0] == h[1] == h[2] and (size == 0 or h[3] != h[0])


def test_windows_of_morse_sequences_differ():
    h = np.array([5, 9], dtype=np.uint64)
    order = [i.bit_count() % 2 for i in range(2048)]
    a, b = window_hashes(h[order], 2048)[0], window_hashes(h[[1 - i for i in order]], 2048)[0]
    assert a != b
    for width in (1, 2, 3, 5, 8, 25, 50):
        x = window_hashes(np.tile(np.arange(60, dtype=np.uint64), 3), width)
        assert x[0] == x[60] and len(set(x[:60].tolist())) == 60


def test_op1_and_op8_ids(spark, pair_docs, pair_rows):
    library = Tokenizer.from_file(tokenizer_path())
    want = {r[0]: [*library.encode(r[1], add_special_tokens=False).ids, 0] for r in pair_rows}
    got = {r["doc_id"]: r["ids_crc32"] for r in tokens.encode_documents(pair_docs, tokenizer_path()).collect()}
    assert got == {i: crc(x) for i, x in want.items()}
    pieces = packing.pack_documents(pair_docs, tokenizer_path(), 1 << 13).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in pieces} == got


def test_a_hit_counts_only_if_both_hashes_agree(monkeypatch):
    class Poor(Spans):
        def hashes(self, starts, ends, salt=0):
            return (ends - starts).astype(np.uint64) if salt < bpe.SECOND else super().hashes(starts, ends, salt)

    monkeypatch.setattr(bpe, "Spans", Poor)
    library, enc = Tokenizer.from_file(tokenizer_path()), bpe.Encoder(tokenizer_path())
    texts = ["one two three", "six ten seven", "four", "", "one two"]
    assert [x.tolist() for x in enc.encode_many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_op4_removes_nothing(pair_docs, pair_rows):
    assert removed(pair_docs) == brute_repeats(pair_rows, 50)
    assert all(n == 0 for _, _, n, _ in removed(pair_docs))


def test_op7_counts_words_apart(pair_docs, pair_rows):
    got = lattice.score_documents(pair_docs, tokenizer_path("piece_bpe_32k.model"), id_remainder(10) == 0).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base(pair_rows)


def test_shingle_sets_differ():
    for x, y in PAIRS:
        h, cuts = shingles.shingle_sets(pa.array([f"u v {x} w z", f"u v {y} w z"]))
        assert not set(h[: cuts[1]].tolist()) & set(h[cuts[1] :].tolist())
