import random
from collections import Counter
from hashlib import sha256

import pytest

from tessera.llm import alignment
from tessera.llm.bpe import _byte_alphabet
from tessera.llm.queries import tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """The contract by the libraries alone, one document and one token at a time."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {chr(v): k for k, v in _byte_alphabet().items()}

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        return (list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None

    def run(rows):
        found, counts = [], Counter()
        for doc_id, text in rows:
            got = tokens(text) if text else None
            if got is None:
                found.append((doc_id, None))
                continue
            spans = []
            for side in got:
                at, own = 0, []
                for i, data in side:
                    own.append((i, at, at + len(data)))
                    at += len(data)
                spans.append(own)
            links, k = [], 0
            for x, s, e in spans[0]:
                while spans[1][k][2] <= s:
                    k += 1
                j = k
                while j < len(spans[1]) and spans[1][j][1] < e:
                    links.append((x, spans[1][j][0]))
                    j += 1
            counts.update(links)
            both = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
            groups = [([str(i) for i, s, e in spans[0] if lo <= s < hi], [str(i) for i, s, e in spans[1] if lo <= s < hi]) for lo, hi in zip([0, *both], both)] if len(both) < 3000 else None
            if groups is None:
                groups, ka, kb = [], 0, 0
                for hi in both:
                    own = ([], [])
                    while ka < len(spans[0]) and spans[0][ka][2] <= hi:
                        own[0].append(str(spans[0][ka][0]))
                        ka += 1
                    while kb < len(spans[1]) and spans[1][kb][2] <= hi:
                        own[1].append(str(spans[1][kb][0]))
                        kb += 1
                    groups.append(own)
            text = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
            found.append((doc_id, (len(spans[0]), len(spans[1]), len(both), links, sha256(text.encode()).hexdigest())))
        best = Counter()
        for (_, y), n in counts.items():
            best[y] = max(best[y], n)
        out = []
        for doc_id, got in found:
            if got is None:
                out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            else:
                n_a, n_b, n_groups, links, digest = got
                out.append((doc_id, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
        return sorted(out, key=repr)

    return run


def aligned(docs):
    return sorted(map(tuple, alignment.align_tokens(docs, A, B).collect()), key=repr)


def test_edge_rows(spark, edge_docs, edge_rows, plain):
    assert aligned(edge_docs) == plain([r[:2] for r in edge_rows])


def test_no_rows(spark, no_docs):
    assert aligned(no_docs) == []


@pytest.mark.parametrize("segment, block, a_part, rows", [(1 << 19, 1 << 22, 512, 64), (40, 3000, 1, 7), (200, 1, 3, 1000)])
def test_any_sizes(spark, plain, monkeypatch, segment, block, a_part, rows):
    """Segments, blocks, parts and stripes of any size give the same; texts of all kinds."""
    for name, v in (("SEGMENT", segment), ("BLOCK", block), ("BLOCKS_A_PART", a_part), ("ROWS", rows)):
        monkeypatch.setattr(alignment, name, v)
    rnd = random.Random(segment)
    some = ["the", "quick", "tokenization", "don't", "  ", "\n", "\t\t", "ﬁ", "Å", "日本語", "\U0001f600", "é", "12345", "<s>", "</s>", "<|endoftext|>", "<0x41>", "x\0y", "zu", "à la", "_", "...", "   indented", " a", "ſ", "٣", " ", " "]
    texts = ["".join(rnd.choice([" ", " ", ""]) + rnd.choice(some) for _ in range(rnd.randrange(1, 120))) for _ in range(60)]
    texts += [" ", "  ", "\n", "a ", " a", "▁", "a▁b", "x" * 500, "<unk>", "﻿", "a" + "word " * 300, " " * 70, "", None, "é", "ά", "ﬁ"]
    rows = [(k % 70, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[4])]
    assert aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == plain(rows)


def test_given_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert aligned(docs) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_pieces_as_the_library_gives_them(monkeypatch):
    """Long runs of blanks, new tables, and texts that pieces don't spell."""
    monkeypatch.setattr(alignment, "_SPELL", 64)
    e = alignment.PieceEncoder(B)
    rnd = random.Random(5)
    texts = [" " + "".join(rnd.choice(" ab\n▁é.,1Ω") for _ in range(rnd.randrange(0, 60))) for _ in range(400)]
    for k in range(0, 400, 50):
        for text, got in zip(texts[k : k + 50], e.encode_many(texts[k : k + 50]), strict=True):
            own = e.model.encode(text[1:]) if len(text) > 1 else [e.blank]
            spelled = b"".join(e.bytes[i] for i in own) == text.encode()
            assert (got is None) == (not spelled) and (got is None or got.tolist() == own)


def test_segments_meet_nowhere_else():
    text = "some words here, and  more\nlines don't stop " * 50
    parts = list(alignment.segments(" " + text, 60))
    assert "".join(parts) == " " + text and len(parts) > 10 and all(p[0] == " " and p[1].isalpha() for p in parts)
    assert list(alignment.segments("x" * 100, 10)) == ["x" * 100]
