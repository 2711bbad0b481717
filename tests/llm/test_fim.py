import hashlib

import numpy as np
import pytest

from tessera.llm import fim


def plainly(doc_id, text, marks=fim.MARKS):
    """The contract, one character at a time."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not n or any(x in text for x in marks) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def compare(spark, docs, rows, **options):
    made = fim.fill_in_middle(docs, **options)
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    assert got == sorted((plainly(r[0], r[1]) for r in rows), key=repr)
    back = made.select("doc_id", fim.restored(made["output"], made["form"]).alias("text")).collect()
    assert sorted((tuple(r) for r in back), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)


def test_edge_rows(spark, edge_docs, edge_rows):
    compare(spark, edge_docs, edge_rows)


def test_no_rows(spark, no_docs):
    assert fim.fill_in_middle(no_docs).collect() == []


@pytest.mark.parametrize("chunk_bytes", [3, 7, 256, 1000, 1 << 16])
def test_chunks_of_any_size(spark, chunk_bytes):
    """Code points and marks that chunks and lanes cut, texts of one and of many chunks, marks that almost are."""
    rnd = np.random.default_rng(chunk_bytes)
    letters = list("ab <PSM>é€\U0001f600") + ["<P", "<M", "<<S", ">"]
    rows = [(k, "".join(rnd.choice(letters, size=int(rnd.integers(0, 40 if chunk_bytes < 100 else 3000))))) for k in range(60)]
    rows += [(100 + k, "x" * k + w + "y" * 300) for k, w in ((2, "<P>"), (255, "<S>"), (254, "<M>"), (700, "<M"), (0, "<S>"))]
    rows += [(200, "\U0001f600" * 900), (201, None), (202, ""), (None, "z€" * 500), (200, "\U0001f600" * 900)]
    compare(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, chunk_bytes=chunk_bytes)


def test_spread_of_forms(spark):
    rows = [(k, f"document {k}") for k in range(2000)]
    forms = [r["form"] for r in fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    share = {f: forms.count(f) / 2000 for f in set(forms)}
    assert abs(share["plain"] - 0.1) < 0.03 and abs(share["spm"] - 0.18) < 0.03


@pytest.mark.parametrize("states", [1, 2, 5, 40])
def test_any_automaton(states):
    """Functions and places against one step at a time, for random automata whose counts depend on the state of entry."""
    rnd = np.random.default_rng(states)
    machine = fim.Automaton(rnd.integers(0, states, (states, 256)).astype(np.uint8), rnd.random((states, 256)) < 0.3, rnd.random((states, 256)) < 0.001)
    sizes = [0, 1, 255, 256, 257, 0, 5000, 3]
    data, offsets = rnd.integers(0, 256, sum(sizes)).astype(np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    scan = fim.Scan(machine, data, offsets)
    f = scan.pieces()
    for p, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for entered in range(states):
            state, units, marked, ends = entered, 0, False, [0]
            for k, byte in enumerate(data[a:b].tolist()):
                if machine.emits[state, byte]:
                    units += 1
                    ends.append(k + 1)
                marked |= bool(machine.marks[state, byte])
                state = machine.next[state, byte]
            assert (f.next[p, entered], f.units[p, entered], bool(f.marks[p, entered])) == (state, units, marked)
            wanted = np.unique(np.array([0, units // 3, units // 2, units]))
            got = scan.locate(np.full(len(wanted), p), np.full(len(wanted), entered), wanted)
            assert got.tolist() == [ends[w] for w in wanted]


def test_composition_is_associative():
    rnd = np.random.default_rng(0)
    f, g, h = (fim.Functions(rnd.integers(0, 6, (50, 6)).astype(np.uint8), rnd.integers(0, 9, (50, 6)), rnd.random((50, 6)) < 0.1) for _ in range(3))
    left, right = f.then(g).then(h), f.then(g.then(h))
    assert (left.next == right.next).all() and (left.units == right.units).all() and (left.marks == right.marks).all()


def test_a_mark_inside_a_long_text_is_found_where_chunks_meet(spark):
    rows = [(k, "é" * k + "<M>" + "é" * 50) for k in range(30, 45)]
    compare(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows, chunk_bytes=16)
