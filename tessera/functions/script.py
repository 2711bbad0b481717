"""Tokens and declarations of JavaScript and TypeScript sources.

The lexer keeps a stack: a template literal or a JSX element holds code in braces, which
holds templates and elements again; each is one token outside.  Whether a slash begins a
regular expression follows from the token before it, and for a closing bracket from what
was before the bracket that it closes.  :class:`Script` reads declarations off the tokens
by recursive descent: type parameters, types and parameter lists are passed as wholes, and
statements end as the language says, at a semicolon or where a new line can't go on.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

#: Words after which a value begins: a slash is a regular expression there, an angle an element.
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof yield await default extends".split())
#: Statements whose head is in brackets; a value may follow them.
_HEADED = frozenset("if while for with".split())
_VALUES = ("id", "num", "str", "tpl", "re", "jsx")
_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_NAME = re.compile(r"#?(?:[\w$]|\\u\{?[0-9A-Fa-f]+\}?)*")
_NUMBER = re.compile(r"0[xXoObB][\w]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?n?\.?")
_STRING = re.compile(r"'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_OPERATOR = re.compile(r"=>|\.\.\.|\?\.(?!\d)|\+\+|--|&&=?|\|\|=?|\?\?=?|[=!]==?|<=|>=|\*\*=?|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_TAG = re.compile(r"<(?:([A-Za-z_$][\w$.:-]*)|(?=>))")
#: What a line can't begin with if the statement before it is over.
_GO_ON = frozenset("=> . ?. ( [ , ; ? : = == === != !== <= >= < > + - * / % & | ^ && || ?? **".split()) | {"instanceof", "in", "of", "as", "satisfies"}


class Token(NamedTuple):
    kind: str  # id, num, str, tpl, re, jsx, or op
    text: str
    start: int
    end: int
    fresh: bool  # the first of its line


class _Lexer:
    def __init__(self, text: str, jsx: bool):
        self.text, self.jsx = text, jsx

    def code(self, at: int, nested: bool = False) -> tuple[list[Token], int]:
        """Tokens from a place on, and where they end: before the brace that closes what the code is nested in."""
        text, n, out = self.text, len(self.text), []
        brackets: list[tuple[str, bool]] = []  # what opened, and whether a value may follow what closes it
        value = True  # may a value begin here
        fresh = True
        while True:
            if m := _SPACE.match(text, at):
                fresh |= "\n" in m[0]
                at = m.end()
            if at >= n:
                return out, at
            c, kind, end = text[at], "op", -1
            before = out[-1] if out else None
            if c in "'\"":
                kind, end = "str", _STRING.match(text, at).end()
            elif c == "`":
                kind, end = "tpl", self._template(at)
            elif c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit():
                kind, end = "num", _NUMBER.match(text, at).end()
            elif c == "_" or c == "$" or c == "#" or c.isalpha():
                kind, end = "id", max(at + 1, _NAME.match(text, at).end())
            elif c == "/" and value and (m := _REGEX.match(text, at)):
                kind, end = "re", m.end()
            elif c == "<" and value and self.jsx and (stop := self._element(at)) > 0:
                kind, end = "jsx", stop
            if end < 0:
                m = _OPERATOR.match(text, at)
                end = m.end() if m else at + 1
            token = Token(kind, text[at:end], at, end, fresh)
            if kind != "op":
                dotted = before is not None and before.text in (".", "?.")
                value = kind == "id" and token.text in _BEFORE_VALUE and not dotted
            elif token.text in "([{":
                head = before is not None and before.kind == "id" and before.text in _HEADED
                # an object is a value; a block isn't, and what follows it begins anew
                block = token.text == "{" and (before is None or before.kind in _VALUES and before.text not in _BEFORE_VALUE - {"else", "do"} or before.text in (")", "=>", ";", "{", "}", ">"))
                brackets.append((token.text, head or block))
                value = True
            elif token.text in (")", "]", "}"):
                if not brackets:
                    if nested and token.text == "}":
                        return out, at
                    value = False
                else:
                    value = brackets.pop()[1]
            else:
                value = token.text not in ("++", "--")
            out.append(token)
            at, fresh = end, False

    def _template(self, at: int) -> int:
        text, at = self.text, at + 1
        while at < len(text):
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                return at + 1
            elif text.startswith("${", at):
                at = self.code(at + 2, True)[1] + 1
            else:
                at += 1
        return len(text)

    def _element(self, at: int) -> int:
        """Just past the element that begins at the angle; -1 if none does, as where it begins type parameters."""
        text = self.text
        tag = _TAG.match(text, at)
        if not tag:
            return -1
        at = tag.end()
        if tag[1] and re.match(r"\s*(?:,|extends\b|=[^{\"'\s])", text[at:]):
            return -1
        while True:  # attributes
            if at >= len(text):
                return -1
            if text.startswith("/>", at):
                return at + 2
            if text[at] == ">":
                break
            if text[at] == "{":
                at = self.code(at + 1, True)[1] + 1
            elif text[at] in "'\"":
                at = text.find(text[at], at + 1) + 1
                if not at:
                    return -1
            elif text[at] in ";()<":
                return -1
            else:
                at += 1
        at += 1
        while at < len(text):  # children
            if text.startswith("</", at):
                return text.find(">", at) + 1 or -1
            if text[at] == "{":
                at = self.code(at + 1, True)[1] + 1
            elif text[at] == "<" and (stop := self._element(at)) > 0:
                at = stop
            else:
                at += 1
        return -1


class Script:
    """Top-level declarations, routes and imports of a source; suffix: its language."""

    def __init__(self, text: str, suffix: str):
        self.text, self.typed = text, suffix in (".ts", ".tsx")
        self.tokens = _Lexer(text, suffix != ".ts").code(0)[0]
        self.pair = self._pairs()
        self.lines = [m.end() for m in re.finditer("\n", text)]

    def _pairs(self) -> dict[int, int]:
        """Each opening bracket's closing one; the end for those that none closes."""
        out, open_ = {}, []
        for k, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in "([{":
                open_.append(k)
            elif t.kind == "op" and t.text in (")", "]", "}") and open_:
                out[open_.pop()] = k
        return out | dict.fromkeys(open_, len(self.tokens))

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at) + 1

    def span(self, a: int, b: int) -> dict:
        """Places and lines of the tokens from a to before b."""
        start, end = self.tokens[a].start, self.tokens[min(b, len(self.tokens)) - 1].end
        return {"pos": start, "end": end, "start_line": self.line(start), "end_line": self.line(end - 1)}

    def at(self, k: int) -> str:
        """The text of a token that isn't a string, template or the like; empty past the end."""
        return self.tokens[k].text if k < len(self.tokens) and self.tokens[k].kind in ("op", "id") else ""

    def kind(self, k: int) -> str:
        return self.tokens[k].kind if k < len(self.tokens) else ""

    def past(self, k: int) -> int:
        """Just past the bracket that closes the one at k, or past a token."""
        return self.pair.get(k, k) + 1

    def angles(self, k: int) -> int:
        """Just past type parameters or arguments that begin at k; k if none do."""
        depth, j = 0, k
        while j < len(self.tokens) and self.at(j) != ";":
            depth += (self.at(j) == "<") - (self.at(j) == ">")
            j = self.past(j)
            if depth <= 0:
                return j if j > k and self.at(k) == "<" else k
        return k

    def type_end(self, k: int) -> int:
        """Just past a type."""
        conditions = 0
        while k < len(self.tokens):
            if self.at(k) in ("|", "&", "-", "+", "keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract") and k + 1 < len(self.tokens):
                k += 1
                continue
            if self.at(k) == "<":
                k = max(k + 1, self.angles(k))
                continue
            if self.at(k) == "(":
                k = self.past(k)
                if self.at(k) == "=>":
                    k += 1
                    continue
            elif self.at(k) in ("{", "["):
                k = self.past(k)
            elif self.kind(k) in ("id", "str", "num", "tpl"):
                k += 1
            else:
                return k
            while k < len(self.tokens):
                if self.at(k) == ".":
                    k += 2
                elif self.at(k) == "<" and self.angles(k) > k:
                    k = self.angles(k)
                elif self.at(k) == "[" and not self.tokens[k].fresh:
                    k = self.past(k)
                else:
                    break
            if self.at(k) in ("|", "&", "is", "extends"):
                conditions += self.at(k) == "extends"
                k += 1
            elif conditions and self.at(k) in ("?", ":"):
                conditions -= self.at(k) == ":"
                k += 1
            else:
                return k
        return k

    def expression_end(self, k: int, stop: tuple[str, ...] = (";",)) -> int:
        """The place of what ends an expression: a token in ``stop``, a bracket that closes what is around it, or the first token of a line that begins anew."""
        first = k
        while k < len(self.tokens) and self.at(k) not in (*stop, ")", "]", "}"):
            if k > first and self.tokens[k].fresh and self._over(k):
                return k
            k = self.past(k)
        return k

    def _over(self, k: int) -> bool:
        """Does a new statement or member begin at the token, the first of its line."""
        last, now = self.tokens[k - 1], self.tokens[k]
        ended = last.kind in ("num", "str", "tpl", "re", "jsx") or last.kind == "id" and last.text not in _BEFORE_VALUE or last.text in (")", "]", "}", "++", "--", ">")
        return ended and not (now.kind == "tpl" or now.kind in ("op", "id") and now.text in _GO_ON)

    def statement_end(self, k: int) -> int:
        """Just past a statement that is no declaration known here."""
        word = self.at(k)
        if word == "{":
            return self.past(k)
        if word in _HEADED or word in ("switch", "catch"):
            k += 1 + (self.at(k + 1) == "await")
            k = self.statement_end(self.past(k)) if self.at(k) == "(" else k + 1
            return self.statement_end(k + 1) if word == "if" and self.at(k) == "else" else k
        if word in ("do", "else", "try", "finally"):
            k = self.statement_end(k + 1)
            while self.at(k) in ("catch", "finally"):
                k = self.statement_end(k + 1 if self.at(k + 1) == "{" else k)
            if word == "do" and self.at(k) == "while":
                k = self.past(k + 1)
                k += self.at(k) == ";"
            return k
        if word in ("interface", "enum", "namespace", "module") and self.kind(k + 1) in ("id", "str"):
            while k < len(self.tokens) and self.at(k) not in ("{", ";"):
                k += 1
            return self.past(k)
        if word == "type" and self.kind(k + 1) == "id" and self.at(k + 2) in ("=", "<"):
            k = self.angles(k + 2)
            k = self.type_end(k + 1) if self.at(k) == "=" else k
            return k + (self.at(k) == ";")
        k = self.expression_end(max(k + 1, self.past(k)) if word in (")", "]", "}") else k)
        return k + 1 if self.at(k) in (";", ")", "]", "}") else k

    # --- declarations: each gives what it found and the place after it -------------------

    def declarations(self) -> Iterator[dict]:
        """class, function, route and import records in the order of the source; a class has its bases and members."""
        k = 0
        while k < len(self.tokens):
            first = k
            found, k = self._declaration(k)
            k = max(k, first + 1)
            yield from found

    def _declaration(self, first: int) -> tuple[list[dict], int]:
        k = first
        while self.at(k) == "@":  # decorators
            k += 2
            while self.at(k) == "." or self.at(k) == "(":
                k = self.past(k) if self.at(k) == "(" else k + 2
        if exported := self.at(k) == "export":
            k += 1 + (self.at(k + 1) == "default")
        if self.at(k) == "abstract" and self.at(k + 1) == "class":
            k += 1
        if self.at(k) == "class":
            return self._class(first, k)
        is_async = self.at(k) == "async" and self.at(k + 1) == "function" and not self.tokens[k + 1].fresh
        if self.at(k + is_async) == "function":
            return self._function(first, k + is_async, is_async)
        if self.at(k) in ("const", "let") and (self.kind(k + 1) == "id" or self.at(k + 1) in ("{", "[")) and self.at(k + 1) != "enum":
            return self._constants(k)
        if self.at(k) == "import" and self.at(k + 1) not in ("(", "."):
            return self._import(k)
        if self.kind(k) == "id" and not exported and k == first:
            return self._route(k)
        return [], self.statement_end(k)

    def _body(self, k: int) -> int:
        """Of a function whose parameters (or type parameters) begin at k: the place of its body's brace, -1 if it has none."""
        k = self.angles(k)
        if self.at(k) != "(":
            return -1
        k = self.past(k)
        if self.at(k) == ":":
            k = self.type_end(k + 1)
        return k if self.at(k) == "{" else -1

    def _function(self, first: int, k: int, is_async: bool) -> tuple[list[dict], int]:
        k += 1 + (self.at(k + 1) == "*")
        named = self.kind(k) == "id"
        body = self._body(k + named)
        if body < 0:  # a signature
            return [], self.statement_end(k)
        end = self.past(body)
        found = {"kind": "function", "name": self.at(k), "is_async": is_async, "is_method": False, "declared": True} | self.span(first, end)
        return [found] if named else [], end

    def _arrow(self, k: int) -> tuple[bool, int] | None:
        """Of a function that begins at k: is it async, and the place after its parameters; None if none begins."""
        is_async = self.at(k) == "async" and not (k + 1 < len(self.tokens) and self.tokens[k + 1].fresh) and self.at(k + 1) != "=>"
        k += is_async
        if self.at(k) == "function" or self.kind(k) == "id" and self.at(k + 1) == "=>":
            return is_async, k + 1
        k = self.angles(k)
        if self.at(k) != "(":
            return None
        k = self.past(k)
        if self.at(k) == ":":
            k = self.type_end(k + 1)
        return (is_async, k) if self.at(k) == "=>" else None

    def _constants(self, first: int) -> tuple[list[dict], int]:
        found, k = [], first
        while True:
            k += 1
            name = self.at(k) if self.kind(k) == "id" else ""
            k = self.past(k)
            k += self.at(k) == "!"
            if self.at(k) == ":":
                k = self.type_end(k + 1)
            if self.at(k) == "=":
                k += 1
                if name and (arrow := self._arrow(k)):
                    found.append({"kind": "function", "name": name, "is_async": arrow[0], "is_method": False, "declared": False})
                    k = arrow[1]
                k = self.expression_end(k, (";", ","))
            if self.at(k) != ",":
                break
        end = k + (self.at(k) == ";")
        return [f | self.span(first, end) for f in found], end

    def _import(self, first: int) -> tuple[list[dict], int]:
        k, symbols = first + 1, []
        k += self.at(k) == "type" and self.at(k + 1) not in ("from", ",", "=")
        while k < len(self.tokens) and self.kind(k) != "str" and self.at(k) not in (";", "="):
            if self.at(k) == "{":
                stop = self.past(k) - 1
                while k < stop:
                    k += 1 + (self.at(k + 1) == "type" and self.at(k + 2) not in (",", "}", "as"))
                    if self.kind(k) in ("id", "str") and k < stop:
                        symbols.append(self.tokens[k].text.strip("'\""))
                    while k < stop and self.at(k) != ",":
                        k += 1
            elif self.kind(k) == "id" and self.at(k) not in ("as", "from"):
                symbols.append(self.at(k))
            k += 1
        if self.kind(k) != "str":
            return [], self.statement_end(k)
        module, end = self.tokens[k].text[1:-1], self.statement_end(k)
        raw = self.span(first, end)
        return [{"kind": "import", "module": module, "symbols": symbols, "raw": self.text[raw["pos"] : raw["end"]]} | raw], end

    def _route(self, first: int) -> tuple[list[dict], int]:
        """A statement that is one call of a method with a string as its first argument."""
        k, last = first + 1, None
        while k < len(self.tokens):
            if self.at(k) in (".", "?.") and self.kind(k + 1) == "id":
                k, last = k + 2, ("name", k + 1)
            elif self.at(k) == "(" and last and last[0] == "name":
                k, last = self.past(k), ("call", last[1], k)
            elif self.at(k) in ("(", "["):
                k, last = self.past(k), ("other",)
            else:
                break
        end = self.statement_end(first)
        if not last or last[0] != "call" or not (k >= len(self.tokens) or self.at(k) == ";" or k == end):
            return [], end
        _, name, opening = last
        if self.kind(opening + 1) != "str" or self.at(opening + 2) not in (",", ")"):
            return [], end
        handler, j, stop = None, opening + 2, self.past(opening) - 1
        while j < stop:
            a, j = j + 1, self.expression_end(j + 1, (",",))
            if j == a + 1 and self.kind(a) == "id":
                handler = self.at(a)
        found = {"kind": "route", "verb": self.at(name).lower(), "path": self.tokens[opening + 1].text.strip("\"'`"), "handler": handler}
        return [found | self.span(first, end)] if found["path"] else [], end

    def _class(self, first: int, k: int) -> tuple[list[dict], int]:
        named = self.kind(k + 1) == "id" and self.at(k + 1) not in ("extends", "implements")
        name = self.at(k + 1) if named else ""
        k = self.angles(k + 1 + named)
        bases = []
        if self.at(k) == "extends":
            a = k = k + 1
            while self.kind(k) == "id" and self.at(k + 1) == ".":
                k += 2
            simple = self.kind(k) == "id"
            base, k = self.at(k), self.angles(k + 1) if simple else k
            if simple and self.at(k) in ("{", "implements"):
                bases = [base]
            k = k if bases else a
        while k < len(self.tokens) and self.at(k) != "{":
            k = self.angles(k) if self.angles(k) > k else self.past(k)
            if self.at(k - 1) == ")" and self.at(k) == "=>":  # a class in an argument of a mixin
                k += 1
        end = self.past(k)
        found = {"kind": "class", "name": name, "bases": bases, "members": list(self._members(name, k + 1, min(end - 1, len(self.tokens)))) if named else []}
        return [found | self.span(first, end)] if named else [], end

    def _members(self, owner: str, k: int, stop: int) -> Iterator[dict]:
        while k < stop:
            if self.at(k) == ";":
                k += 1
                continue
            while self.at(k) == "@":
                k += 2
                while self.at(k) in (".", "("):
                    k = self.past(k) if self.at(k) == "(" else k + 2
            first, is_async = k, False
            while self.at(k) in ("public", "private", "protected", "static", "readonly", "override", "declare", "abstract", "accessor", "async", "get", "set", "*"):
                if self.at(k + 1) in ("(", "=", ";", ":", "?", "!", "}", "<", ",") or k + 1 >= stop or self.at(k) in ("get", "set", "async") and self.tokens[k + 1].fresh:
                    break  # a member of that name
                is_async |= self.at(k) == "async"
                k += 1
            if self.at(k) == "{":  # static
                k = self.past(k)
                continue
            signature = self.at(k) == "[" and self.at(k + 2) == ":"
            name = self.text[self.tokens[k].start : self.tokens[self.past(k) - 1].end] if self.at(k) == "[" and self.past(k) <= len(self.tokens) else self.tokens[k].text
            known = self.kind(k) in ("id", "str", "num") or self.at(k) == "["
            k = self.past(k)
            k += self.at(k) in ("?", "!")
            method = self.at(k) in ("(", "<")
            body = self._body(k) if method else -1
            if method and body >= 0:
                end = self.past(body)
            elif method:  # no body: a signature
                k = self.past(self.angles(k))
                k = self.type_end(k + 1) if self.at(k) == ":" else k
                end = k + (self.at(k) == ";")
            else:
                k = self.type_end(k + 1) if self.at(k) == ":" else k
                k = self.expression_end(k + 1, (";",)) if self.at(k) == "=" else k
                end = k + (self.at(k) == ";")
            end = max(end, first + 1)
            if known and not signature and (body >= 0 or not method and self.typed):
                yield {"kind": "function", "name": name, "owner": owner, "is_async": is_async, "is_method": True} | self.span(first, min(end, stop))
            k = end
