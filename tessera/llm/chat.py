"""Operator 5: chat formatting from event logs. DataFrame functions only.

Input is a log of events (conversation, sequence number, message, kind, role, text):

* ``start``       begins a message and gives its role (and first text);
* ``delta``       appends text to a message (streamed output);
* ``edit``        replaces a message's text;
* ``regenerate``  drops what a message has said so far; deltas that follow rebuild it;
* ``delete``      takes a message out.

Events are folded in order of sequence into final messages (events of one sequence
number by kind, in the order start, regenerate, edit, delta, then by text: arrival isn't
known; a deleted message stays deleted, whatever comes later):
first by message, then the messages of a conversation by where they began.  Nothing
is grouped but the events of a message and the messages of a conversation, which the
result holds in one row anyway.

Rendering marks turns with control strings and escapes control strings inside roles
and texts: after its first character a control string gets a backslash, and a
backslash doubles.  No control string is left inside, and :func:`parse` gives back
exactly what was rendered.  ``loss`` lists the character spans of assistant texts.

Cases: null texts are empty, null roles too; unknown kinds raise; a message without
``start`` has an empty role; conversations without messages left give no row; a null
conversation id is a conversation; null sequence numbers sort first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, END = "<|start|>", "<|message|>", "<|end|>"
#: Strings that common chat templates read as marks; escaped inside texts, whichever template is used.
CONTROL = (START, BODY, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>")
_KINDS = {"start": 0, "regenerate": 1, "edit": 2, "delta": 3, "delete": 4}


def escape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """Reversible: see the module's text."""
    found = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in control)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({found})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, first_seq, role, text) of each message that is left, from (conv_id, seq, message_id, kind, role, text)."""
    known = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    order = F.coalesce(known[F.col("kind")], F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null")))).cast("int"))
    event = F.struct("seq", order.alias("order"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    logs = events.select("conv_id", "message_id", event.alias("e")).groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list("e")).alias("log"))
    last = lambda cond: f"coalesce(array_max(filter(transform(log, (e, i) -> if({cond}, i, -1)), i -> i >= 0)), -1)"
    logs = logs.select(
        "conv_id",
        "message_id",
        F.expr("log[0].seq").alias("first_seq"),
        F.expr("coalesce(get(filter(log, e -> e.order = 0), 0).role, '')").alias("role"),
        F.expr(last("e.order in (0, 1, 2)")).alias("from"),
        F.expr("exists(log, e -> e.order = 4)").alias("gone"),
        "log",
    )
    text = F.expr("array_join(transform(slice(log, greatest(`from`, 0) + 1, size(log)), e -> if(e.order = 1, '', e.text)), '')")
    return logs.where("not gone").select("conv_id", "message_id", "first_seq", "role", text.alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), control: tuple[str, ...] = CONTROL) -> DataFrame:
    """(conv_id, formatted, loss) of (conv_id, first_seq, message_id, role, text): loss lists character spans, end exclusive."""
    piece = messages.select(
        "conv_id",
        F.struct("first_seq", "message_id", escape(F.col("role"), control).alias("role"), escape(F.col("text"), control).alias("text"), F.col("role").isin(*loss_roles).alias("learn")).alias("m"),
    )
    turns = piece.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda m: F.concat(F.lit(START), m["role"], F.lit(BODY), m["text"], F.lit(END))), "")
    marks = len(START) + len(BODY)
    step = (
        "aggregate(turns, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>)), (a, m) -> named_struct("
        f"'at', a.at + {marks + len(END)} + length(m.role) + length(m.text), "
        f"'spans', if(m.learn, concat(a.spans, array(named_struct('start', a.at + {marks} + length(m.role), 'end', a.at + {marks} + length(m.role) + length(m.text)))), a.spans)), a -> a.spans)"
    )
    return turns.select("conv_id", whole.alias("formatted"), F.expr(step).alias("loss"))


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), control: tuple[str, ...] = CONTROL) -> DataFrame:
    """Folds the log and renders each conversation."""
    return render(fold(events), loss_roles, control)


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text), unescaped."""
    turns = F.filter(F.split(formatted, re.escape(END)), lambda t: t != "")
    bare = lambda t: F.substring(t, len(START) + 1, 2**31 - 1)
    part = lambda t, k: unescape(F.element_at(F.split(bare(t), re.escape(BODY), 2), k))
    return F.transform(turns, lambda t: F.struct(part(t, 1).alias("role"), part(t, 2).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    cut = lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return F.array_join(F.transform(loss, lambda s: unescape(cut(s))), "")
