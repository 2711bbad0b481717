"""The thirteen operators as queries over the driver's tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import alignment, chat, fim, lattice, mixing, neighbours, packing, quality, scratch, simhash, substrings, tokens, topk, toxicity


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file is on this machine (the same on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo the divisor."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % divisor


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels, allowed=id_remainder(3) != 1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(id_remainder(3) == 1, F.lit(False)).alias("held_out")
    scored = scored.select("doc_id", held_out, "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
    return scratch.keep(scored, "scores")  # here, so that the texts go to Python in small batches


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def conversation_events(rows: DataFrame) -> DataFrame:
    """The event log of finished conversations: each row is a message that starts, and whose text comes as one delta.

    Rows go by turn (null ones last), role and text; a row's place is its sequence number and its message, so equal rows are messages of their own.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").cast("long").asc_nulls_last(), "role", "text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).select("conv_id", place.cast("long").alias("seq"), "role", "text")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in (("start", F.lit("")), ("delta", F.col("text")))]))
    return rows.select("conv_id", "seq", F.col("seq").cast("string").alias("message_id"), "role", kinds.alias("e")).select("conv_id", "seq", "message_id", "e.kind", "role", "e.text")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    out = chat.format_chats(conversation_events(rows)).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op7_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), id_remainder(10) == 0)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def cleanliness() -> Column:
    """A document's quality weight: 1, less five times its share of symbols, 0.1 at least."""
    text = F.coalesce("text", F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, quality.SYMBOLS, ""))
    return F.greatest(F.lit(0.1), 1.0 - 5.0 * symbols / F.greatest(F.length(text), F.lit(1)))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.word_count(F.col("text")), cleanliness())
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    made = made.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
    return scratch.keep(made, "filled")  # here, so that the texts go to Python in small batches


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_output,
        op2_toxicity,
        op3_quality_rules,
        op4_substring_dedup,
        op5_chat_format,
        op6_simhash_dedup,
        op7_lattice_scores,
        op8_best_fit_packing,
        op9_exact_top_k,
        op10_source_mixing,
        op11_embedding_dedup,
        op12_fill_in_middle,
        op13_token_alignment,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP3 = rf"""
with w as (select doc_id, lang, source, coalesce(text, '') as text, {_WORDS} as words from documents),
l as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
  [array_to_string(words[i:i+7], ' ') for i in range(1, greatest(len(words) - 6, 1))] as windows from w),
r as (select doc_id, p, row_number() over (partition by rid order by p) as k, lag(p) over (partition by rid order by p) as last_p, rid from (
  select rid, doc_id, p, count(*) over (partition by rid, win) as n from (
    select rid, doc_id, unnest(windows) as win, unnest(range(1, len(windows) + 1)) as p from (select row_number() over () as rid, * from l))) where n > 1),
c as (select rid, sum(least(8, p - coalesce(last_p, -8)))::bigint as n_repeat_words from r group by rid),
m as (select x.*, coalesce(c.n_repeat_words, 0) as n_repeat_words from (
  select row_number() over () as rid, doc_id, lang, source, len(words)::bigint as n_words,
    length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines from l) x left join c using (rid)),
v as (select lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) as measure,
  unnest([n_symbols * 10000 // greatest(word_chars, 1), n_dup_lines * 10000 // greatest(n_words, 1), n_repeat_words * 10000 // greatest(n_words, 1), word_chars * 1000 // greatest(n_words, 1)]) as value from m),
b as (select lang, source, measure, (value >> greatest(length(bin(value)) - 7, 0)) << greatest(length(bin(value)) - 7, 0) as bin from v),
f0 as (select lang, source, measure, bin, count(*)::bigint as n from b group by 1, 2, 3, 4),
f1 as (select lang, measure, bin, sum(n)::bigint as n from f0 group by 1, 2, 3),
f2 as (select measure, bin, sum(n)::bigint as n from f0 group by 1, 2),
a2 as (select measure, bin, n * 50000 // sum(n) over (partition by measure) as n from f2),
s1 as (select lang, measure, bin, sum(n)::bigint as n from (select lang, measure, bin, n * 1000 as n from f1 union all select l.lang, a2.* from (select distinct lang from f1) l, a2) group by 1, 2, 3),
a1 as (select lang, measure, bin, n * 50000 // sum(n) over (partition by lang, measure) as n from s1),
s0 as (select lang, source, measure, bin, sum(n)::bigint as n from (select lang, source, measure, bin, n * 1000 as n from f0
  union all select g.lang, g.source, a1.measure, a1.bin, a1.n from (select distinct lang, source from f0) g join a1 on g.lang is not distinct from a1.lang) group by 1, 2, 3, 4),
r0 as (select *, sum(n) over (partition by lang, source, measure order by bin) as upto, sum(n) over (partition by lang, source, measure) as total from s0),
q as (select lang, source, measure, min(bin) filter (upto * 100 >= total * 25) as p25, min(bin) filter (upto * 100 >= total * 50) as p50, min(bin) filter (upto * 100 >= total * 75) as p75,
  min(bin) filter (upto * 100 >= total * 90) as p90, min(bin) filter (upto * 100 >= total * 95) as p95 from r0 group by 1, 2, 3),
t as (select lang, source, max(p90 + 2 * (p90 - p50) + 100) filter (measure = 'symbols') as symbols, max(p95 + 2 * (p95 - p50) + 100) filter (measure = 'dup_lines') as dup_lines,
  max(p95 + 2 * (p95 - p50) + 500) filter (measure = 'repeats') as repeats, max(p75 + 5 * (p75 - p25)) filter (measure = 'word_length') as longest,
  max(p25 - 5 * (p75 - p25)) filter (measure = 'word_length') as shortest from q group by 1, 2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_symbols * 10000 // greatest(word_chars, 1) <= symbols and n_dup_lines * 10000 // greatest(n_words, 1) <= dup_lines
  and n_repeat_words * 10000 // greatest(n_words, 1) <= repeats and word_chars * 1000 // greatest(n_words, 1) between shortest and longest as kept
from m join t on m.lang is not distinct from t.lang and m.source is not distinct from t.source
"""

_OP4 = rf"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as words from documents),
w as (select rid, doc_id, unnest(range(1, greatest(len(words) - 48, 1))) as p, unnest([md5(array_to_string(words[i:i+49], ' ')) for i in range(1, greatest(len(words) - 48, 1))]) as h from d),
m as (select h, min(doc_id) as least from w group by h having count(*) > 1),
late as (select distinct rid, unnest(range(p, p + 50)) as p from w join m using (h) where doc_id > least),
gone as (select rid, list(p) as places, count(*) as n from late group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(array_to_string(list_filter(words, lambda w, i: places is null or not list_contains(places, i)), ' ')) as kept_sha256
from d left join gone using (rid)
"""

_OP5 = """
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(text) + length(role)
  + length(text) - length(replace(text, chr(92), '')) + length(role) - length(replace(role, chr(92), ''))
  + list_sum([(length(text || chr(10) || role) - length(replace(text || chr(10) || role, m, ''))) // length(m) for m in ['<|start|>', '<|message|>', '<|end|>', '<|im_start|>', '<|im_end|>', '<|endoftext|>', '<|system|>', '<|user|>', '<|assistant|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<bos>', '<eos>']]) + 27 as size from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(size)::bigint as formatted_chars
from e group by conv_id
"""


def _xxh64() -> str:
    """SQL steps from d (s, a text) to x (s, h): the XXH64 of each distinct text's UTF-8 form under seed 42, in 128-bit arithmetic modulo 2**64."""
    m = f"{2**64 - 1}::uhugeint"
    # the hash's five primes: fixed values
    p1, p2, p3, p4, p5 = (f"{p}::uhugeint" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    turn = lambda x, r: f"(((({x}) * {2**r}::uhugeint) & {m}) + (({x}) >> {64 - r}))"
    step = lambda acc, x: f"(({turn(f'((({acc}) + ({x}) * {p2}) & {m})', 31)} * {p1}) & {m})"
    number = lambda first, n: "(" + " + ".join(f"b[{first} + {k}]::uhugeint * {256**k}::uhugeint" for k in range(n)) + ")"
    starts = [(42 + 11400714785074694791 + 14029467366897019727) % 2**64, 42 + 14029467366897019727, 42, (42 - 11400714785074694791) % 2**64]
    sums = ", ".join(f"list_reduce(list_prepend({v % 2**64}::uhugeint, [w[4 * k + {i + 1}] for k in range(0, n // 32)]), lambda a, x: {step('a', 'x')}) as v{i + 1}" for i, v in enumerate(starts))
    begun = f"(({turn('v1', 1)} + {turn('v2', 7)} + {turn('v3', 12)} + {turn('v4', 18)}) & {m})"
    return f"""
x0 as (select s, hex(encode(s)) as t, octet_length(encode(s)) as n from (select distinct s from d)),
x1 as (select s, n, [('0x' || t[2 * i + 1:2 * i + 2])::int for i in range(0, n)] as b from x0),
x2 as (select *, [{number('8 * k + 1', 8)} for k in range(0, n // 8)] as w from x1),
x3 as (select *, {sums} from x2),
x4 as (select *, case when n < 32 then {(42 + 2870177450012600261) % 2**64}::uhugeint else list_reduce(list_prepend({begun}, [v1, v2, v3, v4]), lambda a, x: ((xor(a, {step('0::uhugeint', 'x')}) * {p1} + {p4}) & {m})) end as h from x3),
x5 as (select s, n, b, list_reduce(list_prepend(((h + n::uhugeint) & {m}), w[n // 32 * 4 + 1:]), lambda a, x: (({turn(f"xor(a, {step('0::uhugeint', 'x')})", 27)} * {p1} + {p4}) & {m})) as h from x4),
x6 as (select s, n, b, case when n % 8 >= 4 then (({turn(f"xor(h, ({number('n // 8 * 8 + 1', 4)} * {p1}) & {m})", 23)} * {p2} + {p3}) & {m}) else h end as h from x5),
x7 as (select s, list_reduce(list_prepend(h, [c::uhugeint for c in b[n // 4 * 4 + 1:]]), lambda a, x: (({turn(f"xor(a, (x * {p5}) & {m})", 11)} * {p1}) & {m})) as h from x6),
x8 as (select s, (xor(h, h >> 33) * {p2}) & {m} as h from x7),
x9 as (select s, (xor(h, h >> 29) * {p3}) & {m} as h from x8),
x as (select s, xor(h, h >> 32)::ubigint as h from x9)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP6 = rf"""
with recursive w as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as words from documents),
d as (select rid, unnest(case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')] else [array_to_string(words[i:i+2], ' ') for i in range(1, len(words) - 1)] end) as s from w),{{hash}},
f as (select rid, ({{bits}})::uhugeint as fp from d join x using (s) group by rid),
p as (select w.rid, doc_id, coalesce(fp, 0::uhugeint) as fp from w left join f using (rid)),
u as (select distinct fp from p),
l as (select a.fp as a, b.fp as b from u a join u b on bit_count(xor(a.fp, b.fp)::hugeint) <= 3),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a as fp, min(doc_id) as component_id from r join p on p.fp = r.b group by a)
select doc_id, lower(lpad(hex(fp::ubigint), 16, '0')) as fingerprint, component_id from p join c using (fp)
""".format(hash=_xxh64(), bits=" + ".join(f"case when 2 * sum((h >> {k}) & 1) > count(*) then {2**k}::uhugeint else 0::uhugeint end" for k in range(64)))

_OP9 = """
with v as (select row_number() over () as rid, vec_id, [floor(64 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.rid, q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

_OP10 = rf"""
with d as (select doc_id, source, len({_WORDS})::bigint as size,
  -ln((('0x' || sha256('0:' || coalesce(doc_id::varchar, 'null') || ':' || coalesce(length(text)::varchar, 'null'))[1:13])::bigint::double + 0.5) / 4503599627370496.0)
  / greatest(0.1, 1.0 - 5.0 * length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) / greatest(length(coalesce(text, '')), 1)) as key from documents),
s as (select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last)) - 1) % 3 + 1]::double as weight from d group by source),
f as (select *, source_size * 2.0 as cap, sum(source_size) over () * 1.5 as budget, sum(weight) over () as weights,
  coalesce(sum(source_size * 2.0) over w, 0.0) as full_before, coalesce(sum(weight) over w, 0) as gone,
  row_number() over (order by source_size * 2.0 / weight, source nulls last) as place
  from s window w as (order by source_size * 2.0 / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, (select arg_min((budget - full_before) / (weights - gone), place) from f where (budget - full_before) / (weights - gone) * weight <= cap) as level from f),
t as (select source, source_size, case when level is null then cap else least(cap, level * weight) end as target from l),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from t),
k as (select d.*, source_size, target, epochs, target - epochs * source_size as rest, sum(size) over (partition by d.source order by key, doc_id) as upto from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, ((epochs + case when rest > 0 and upto - size / 2.0 <= rest then 1 else 0 end) * size)::bigint as taken from k
"""

_OP11 = """
with recursive v as (select row_number() over () as rid, vec_id, label, case when label is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0 then embedding::double[] end as x from embeddings),
s as (select rid, label, x, len(x) as d, sqrt(list_dot_product(x, x)) as norm from v where x is not null and len([y for y in x if y <> 0]) > 0),
l as (select a.rid as a, b.rid as b from s a join s b on a.label = b.label and a.rid <> b.rid and case when a.d = b.d then list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93 else false end),
r(a, b) as (select rid, rid from v union select r.a, l.b from r join l on r.b = l.a),
n as (select a, count(*) as n_links from l group by a),
c as (select r.a, min(v.vec_id) as component_id from r join v on v.rid = r.b group by r.a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id is not distinct from component_id as kept from v join c on c.a = v.rid left join n on n.a = v.rid
"""

_OP12 = """
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
e as (select *, ('0x' || h[1:8])::bigint % (n + 1) as x, ('0x' || h[9:16])::bigint % (n + 1) as y,
  case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 90 then 'plain'
    when ('0x' || h[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form from d),
f as (select *, left(text, least(x, y)) as prefix, substring(text, least(x, y) + 1, greatest(x, y) - least(x, y)) as middle, substring(text, greatest(x, y) + 1) as suffix from e)
select doc_id, n::bigint as n, form, case when form <> 'plain' then least(x, y) end::bigint as prefix_chars, case when form <> 'plain' then greatest(x, y) - least(x, y) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from f
"""

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": _OP3,
    "op4_substring_dedup": _OP4,
    "op5_chat_format": _OP5,
    "op6_simhash_dedup": _OP6,
    "op9_exact_top_k": _OP9,
    "op10_source_mixing": _OP10,
    "op11_embedding_dedup": _OP11,
    "op12_fill_in_middle": _OP12,
}
