"""Calls that link files, read off parsed code: HTTP requests, and topics of messages.

Python goes through ``ast``; other languages, and Python that doesn't parse, through the
lexer of :mod:`.script`.  Both give calls in one shape: the names of what is called, its
arguments and its named ones, as far as they are literals.  One rule reads these.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import Script

#: HTTP clients, their methods that take a URL, and functions that do. Fixed values.
CLIENTS = {
    "requests": ("get", "post", "put", "patch", "delete", "request"),
    "httpx": ("get", "post", "put", "patch", "delete", "request"),
    "axios": ("get", "post", "put", "patch", "delete"),
}
FUNCTIONS = ("fetch",)
#: Methods that send to a topic, and that read topics. Fixed values.
SENDERS, READERS = ("produce",), ("subscribe",)
#: Where the URL stands among the arguments, if not first.
_PLACE = {"request": 1}
_TOPIC = re.compile(r"[A-Za-z][\w.-]+")
_SHORTEST_URL = 4


class Call(NamedTuple):
    """Literals are texts, or lists of them; whatever else an argument is, is None."""

    names: list[str]
    args: list[str | list | None]
    named: dict[str, str | list | None]


def _python_literal(node: ast.expr) -> str | list | None:
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.JoinedStr):
        return "".join(p.value if isinstance(p, ast.Constant) else "{" + ast.unparse(p.value) + "}" for p in node.values)
    if isinstance(node, (ast.List, ast.Tuple)):
        return [_python_literal(e) for e in node.elts]
    return None


def _python_calls(text: str) -> list[Call]:
    found = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Call):
            names, f = [], node.func
            while isinstance(f, ast.Attribute):
                names, f = [f.attr, *names], f.value
            names = [f.id if isinstance(f, ast.Name) else "", *names]
            call = Call(names, [_python_literal(a) for a in node.args], {k.arg: _python_literal(k.value) for k in node.keywords if k.arg})
            found.append((node.lineno, node.col_offset, len(found), call))
    return [call for *_, call in sorted(found)]


def _script_literal(s: Script, a: int, b: int) -> str | list | dict | None:
    """What the tokens from a to before b are: a text (a prefix of letters may stand before), a list, or an object's named texts."""
    if s.kind(a) == "id" and a + 2 == b and len(s.at(a)) <= 2 and s.tokens[a].end == s.tokens[a + 1].start:
        a += 1
    if a + 1 == b and s.kind(a) in ("str", "tpl"):
        return s.tokens[a].text[1:-1]
    if s.at(a) in ("[", "{") and s.past(a) == b:
        parts = [_script_literal(s, x, y) if s.at(a) == "[" else (s.tokens[x].text.strip("'\""), _script_literal(s, x + 2, y)) for x, y in _parts(s, a) if s.at(a) == "[" or s.at(x + 1) == ":"]
        return parts if s.at(a) == "[" else dict(parts)
    return None


def _parts(s: Script, opening: int) -> Iterator[tuple[int, int]]:
    """Where the parts between commas inside a bracket begin and end."""
    k, stop = opening + 1, min(s.past(opening) - 1, len(s.tokens))
    while k < stop:
        end = k
        while end < stop and s.at(end) != ",":
            end = min(s.past(end), stop)
        yield k, end
        k = end + 1


def _script_calls(text: str) -> list[Call]:
    s, found = Script(text, ".ts"), []
    for k in range(1, len(s.tokens)):
        if s.at(k) != "(" or s.kind(k - 1) != "id":
            continue
        names, j = [s.at(k - 1)], k - 1
        while s.at(j - 1) in (".", "?.") and j >= 2:
            names, j = [s.at(j - 2) if s.kind(j - 2) == "id" else "", *names], j - 2
            if not names[0]:
                break
        args, named = [], {}
        for a, b in _parts(s, k):
            if s.kind(a) == "id" and s.at(a + 1) == "=":
                named[s.at(a)] = _script_literal(s, a + 2, b)
            else:
                args.append(_script_literal(s, a, b))
        for given in args:
            named |= given if isinstance(given, dict) else {}
        found.append(Call(names, [None if isinstance(x, dict) else x for x in args], named))
    return found


def calls(text: str, file_type: str | None) -> list[Call]:
    if file_type == ".py":
        try:
            return _python_calls(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    try:
        return _script_calls(text)
    except RecursionError:
        return []


def _linked(call: Call) -> tuple[str, str] | None:
    """The one rule: (http, made or used; URL or topic) of a call that links, else None."""
    *owners, name = (n.lower() for n in call.names)
    owner = owners[-1] if owners else None
    argument = lambda place, key: next((x for x in (*call.args[place : place + 1], call.named.get(key)) if x is not None), None)
    if name in CLIENTS.get(owner or "", ()) or name in FUNCTIONS:
        url = argument(_PLACE.get(name, 0), "url")
        url = argument(0, "url") if url is None else url  # a method that isn't given
        return ("http", url) if isinstance(url, str) and len(url) >= _SHORTEST_URL else None
    if owner is None or call.names[-1] not in SENDERS + READERS:
        return None
    kind, topic = ("made", argument(0, "topic")) if name in SENDERS else ("used", argument(0, "topics"))
    if kind == "used":
        topic = topic[0] if isinstance(topic, list) and topic else None
    return (kind, topic) if isinstance(topic, str) and _TOPIC.fullmatch(topic) else None


def links_in(text: str | None, file_type: str | None = None) -> list[tuple[str, str]]:
    """Distinct links of a source in order."""
    return list(dict.fromkeys(x for call in calls(text or "", file_type) if (x := _linked(call))))


def may_link(content: str) -> Column:
    """Texts without any of the names hold no link; a test that the JVM makes before anything is parsed."""
    words = [*CLIENTS, *FUNCTIONS, *SENDERS, *READERS]
    return F.col(content).rlike("(?i)" + "|".join(words))


def call_links(content: str, file_type: str) -> Column:
    """array<struct<kind, value>> of each source's links."""

    @F.arrow_udf("array<struct<kind:string,value:string>>")
    def found(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "value": v} for k, v in links_in(t, s)] for t, s in zip(texts.to_pylist(), kinds.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))

    return found(F.col(content), F.col(file_type))
