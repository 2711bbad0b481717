import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import files, packing, scratch, tokens
from tessera.llm.bpe import Encoder
from tessera.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    enc, rnd = Encoder(tokenizer_path()), random.Random(5)
    alphabet = " \n\t'ab1.,é日²stlrevmd　\x1c!"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(3000)] + ["", " ", "it's 'tis ''s x'll", "a" * 3000, None]
    for text, got in zip(texts, enc.encode_many(texts), strict=True):
        assert got.tolist() == library(text)


SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|>a", "a<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext|", "x\n<|endoftext|>\n y", "it's<|endoftext|>'s", "<|endof", "text|>"]


def test_added_tokens_are_the_librarys(library):
    enc = Encoder(tokenizer_path())
    assert [x.tolist() for x in enc.encode_many(SPECIAL)] == [library(t) for t in SPECIAL]
    assert enc.encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_added_tokens_as_plain_text():
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    enc = Encoder(tokenizer_path(), plain_specials=True)
    assert [x.tolist() for x in enc.encode_many(SPECIAL)] == [t.encode(x, add_special_tokens=False).ids for x in SPECIAL]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_files_round_trip(spark, edge_docs, edge_rows, library):
    folder = scratch.folder(spark, "test")
    manifest = tokens.write_tokens(edge_docs, folder, tokenizer_path())
    got = tokens.read_tokens(manifest, folder, tokenizer_path(), with_ids=True).collect()
    want = sorted(((r[0], library(r[1]) + [0]) for r in edge_rows), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, tuple(x)) for i, x in want)
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), crc(r["ids"]))
        at += r["n_tokens"]


def test_parts_share_one_table_file(spark):
    """Spark writes the manifest, in one file, and no table with a file of each task; settings are put back."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    before, folder = spark.conf.get(tokens._SCAN), scratch.folder(spark, "test")
    with scratch.setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        manifest = tokens.write_tokens(docs, folder, tokenizer_path()).orderBy("part").collect()
    at = Path(files.local(folder))
    assert [p.parent.name for p in at.rglob("part-*.parquet")] == ["manifest"]
    assert len(manifest) > 1 and len(manifest) == len(list(at.glob("tokens-*.bin"))) and sum(r["n_docs"] for r in manifest) == 200
    assert [r["first_doc"] for r in manifest] == [sum(r["n_docs"] for r in manifest[:k]) for k in range(len(manifest))]
    assert spark.conf.get(tokens._SCAN) == before


def test_no_documents(spark, no_docs):
    assert tokens.encode_documents(no_docs, tokenizer_path()).count() == 0
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


def check_packing(rows, max_tokens, max_docs=None, max_cost=None):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= max_tokens and len(own) <= (max_docs or len(own)) and sum(n * n for _, n in own) <= (max_cost or 1 << 60)
    return len(bins)


def test_pack_documents(spark, edge_docs, edge_rows, library):
    rows = packing.pack_documents(edge_docs, tokenizer_path()).collect()
    check_packing(rows, 2048)
    want = Counter()
    for r in edge_rows:
        ids = library(r[1]) + [0]
        head = len(ids) % 2048 or 2048
        bounds = [0, *range(head, len(ids) + 1, 2048)]
        want.update((r[0], k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want


def best_fit(lengths, caps, weights):
    """One piece at a time, longest first: the sequence with the least weighted norm of what is left."""
    bins = []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        best = min((x for x in bins if (x >= need).all()), key=lambda x: (np.array(weights) * ((x - need) / caps) ** 2).sum(), default=None)
        if best is None:
            bins.append(best := np.array(caps))
        best -= need
    return len(bins)


@pytest.mark.parametrize("options", [{}, {"rule": "dot_product"}, {"max_docs": 3}, {"max_cost": 3000}])
def test_plan_keeps_capacities_and_is_tight(options):
    rnd = random.Random(1)
    for _ in range(20):
        lengths = [min(64, max(1, int(rnd.lognormvariate(2.5, 1)))) for _ in range(rnd.randrange(1, 300))]
        limits = {k: v for k, v in options.items() if k != "rule"}
        if "max_cost" in limits:
            lengths = [n for n in lengths if n * n <= limits["max_cost"]]
        plan = packing.plan_packing(Counter(lengths), 64, **options)
        rows = [dict(sequence_id=f + i // each, offset=at + i % each * n, length=n) for n, lo, hi, f, each, at in plan.tolist() for i in range(hi - lo)]
        assert Counter(r["length"] for r in rows) == Counter(lengths)
        used = check_packing(rows, 64, **limits)
        caps = [64, limits.get("max_docs", 64), limits.get("max_cost", 64 * 64)]
        assert used <= best_fit(lengths, np.array(caps), (1.0, 0.02, 0.05)) * 1.05 + 1


@pytest.mark.parametrize("options", [{}, {"max_docs": 3}, {"max_cost": 1000}, {"max_docs": 4, "max_cost": 1500, "rule": "dot_product"}])
def test_whole_query_under_each_capacity(spark, library, options):
    """Every piece is placed, no capacity is passed, and no more sequences are used than by best fit played one piece at a time."""
    rnd = random.Random(9)
    docs = [(i, " ".join(f"w{rnd.randrange(50)}" for _ in range(min(15, int(rnd.lognormvariate(1.2, 0.9)))))) for i in range(150)]
    most = 64
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), tokenizer_path(), most, **options).collect()
    limits = {k: v for k, v in options.items() if k != "rule"}
    used = check_packing(rows, most, **limits)
    assert Counter((r["doc_id"]) for r in rows if r["piece"] == 0) == Counter(i for i, _ in docs)
    assert sum(r["length"] for r in rows) == sum(len(library(t)) + 1 for _, t in docs)
    caps = np.array([most, limits.get("max_docs", most), limits.get("max_cost", most * most)])
    plain = best_fit([r["length"] for r in rows], caps, (1.0, 0.02, 0.05))
    assert used <= plain if "rule" not in options else used <= 1.05 * plain + 1
    if limits:
        assert used > len({r["sequence_id"] for r in packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), tokenizer_path(), most).collect()})


def test_impossible_piece():
    with pytest.raises(ValueError):
        packing.plan_packing({70: 1}, 64)
