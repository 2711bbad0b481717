"""Symbols, routes and imports of Python and JavaScript or TypeScript files.

Python goes through the standard ``ast``, the other two through :mod:`..functions.script`.  :func:`extract` yields flat records; the DataFrame
operator turns files into rows of them in one Arrow-batched pass.  A file that can't
be parsed yields nothing.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.script import Script

#: HTTP verbs that decorators and routers use. Fixed values.
PY_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
JS_VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "all", "use")
RECORD = (
    "kind string, name string, qualified_name string, start_line int, end_line int, is_async boolean, is_method boolean, docstring string, "
    "parent string, http_method string, path string, framework string, handler string, module string, symbols array<string>, raw string, pos int"
)
_FIELDS = [c.split()[0] for c in RECORD.split(", ")]


def _record(kind: str, **values) -> dict:
    return dict.fromkeys(_FIELDS) | {"kind": kind} | values


def _doc(node) -> str:
    return (ast.get_docstring(node, clean=False) or "").strip()[:400]


def _first_line(node) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])


def _tree(content: str):
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def python_symbols(content: str) -> list[dict]:
    """Top-level classes and functions with their text, decorators included."""
    tree = _tree(content)
    if tree is None:
        return []
    lines, out = content.splitlines(keepends=True), []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            a, b = _first_line(node), node.end_lineno
            out.append({"name": node.name, "kind": "class" if isinstance(node, ast.ClassDef) else "function", "text": "".join(lines[a - 1 : b]).rstrip("\n"), "start_line": a, "end_line": b, "docstring": _doc(node)})
    return out


def _py_function(node, owner: str = "") -> dict:
    return _record(
        "function", name=node.name, qualified_name=f"{owner}.{node.name}" if owner else node.name, start_line=_first_line(node), end_line=node.end_lineno,
        is_async=isinstance(node, ast.AsyncFunctionDef), is_method=bool(owner), docstring=_doc(node), parent=owner or None,
    )


def _py_routes(node) -> Iterator[dict]:
    for d in node.decorator_list:
        if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute)):
            continue
        verb = d.func.attr.lower()
        path = next((a.value for a in d.args if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)
        if path is None or verb not in (*PY_VERBS, "route"):
            continue
        method, framework = verb.upper(), "fastapi"
        if verb == "route":
            framework = "flask"
            given = next((k.value for k in d.keywords if k.arg == "methods"), None)
            names = [e.value.upper() for e in getattr(given, "elts", ()) if isinstance(e, ast.Constant) and isinstance(e.value, str)]
            method = ",".join(names) or "GET"
        yield _record("endpoint", name=path, http_method=method, path=path, framework=framework, handler=node.name, start_line=d.lineno)


def _base_name(node) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    return node.attr if isinstance(node, ast.Attribute) else None


def extract_python(content: str) -> list[dict]:
    tree = _tree(content)
    if tree is None:
        return []
    lines, out = content.splitlines(), []
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            out.append(_record("class", name=node.name, qualified_name=node.name, start_line=_first_line(node), end_line=node.end_lineno, docstring=_doc(node)))
            out += [_record("inherits", name=node.name, parent=b) for b in map(_base_name, node.bases) if b]
            out += [_py_function(x, node.name) for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(_py_function(node))
            out += _py_routes(node)
        elif isinstance(node, ast.Import):
            out += [_record("import", module=a.name, symbols=[], start_line=node.lineno, raw=lines[node.lineno - 1].strip()) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            out.append(_record("import", module=module, symbols=[a.name for a in node.names if a.name != "*"], start_line=node.lineno, raw=lines[node.lineno - 1].strip()))
    return out


# --- JavaScript and TypeScript -------------------------------------------------------


def script_symbols(content: str, file_type: str = ".js") -> list[dict]:
    """Top-level classes and functions, exported or not, with their text."""
    found = [d for d in Script(content, file_type).declarations() if d["kind"] in ("class", "function")]
    # a constant that holds a function is no symbol of its own
    found = [d for d in found if d["kind"] == "class" or d["declared"]]
    return [{"name": d["name"], "kind": d["kind"], "text": content[d["pos"] : d["end"]], "start_line": d["start_line"], "end_line": d["end_line"], "docstring": ""} for d in found]


def _script_function(d: dict) -> dict:
    owner = d.get("owner")
    keep = {c: d[c] for c in ("name", "start_line", "end_line", "is_async", "is_method", "pos")}
    return _record("function", qualified_name=f"{owner}.{d['name']}" if owner else d["name"], docstring="", parent=owner, **keep)


def extract_script(content: str, file_type: str = ".js") -> list[dict]:
    out, functions = [], {}
    for d in Script(content, file_type).declarations():
        at = {c: d[c] for c in ("start_line", "end_line", "pos")}
        if d["kind"] == "class":
            out.append(_record("class", name=d["name"], qualified_name=d["name"], docstring="", **at))
            out += [_record("inherits", name=d["name"], parent=b) for b in d["bases"]]
            own = [_script_function(m) for m in d["members"]]
        elif d["kind"] == "function":
            own = [_script_function(d)]
        elif d["kind"] == "import":
            out.append(_record("import", module=d["module"], symbols=d["symbols"], start_line=d["start_line"], raw=d["raw"]))
            continue
        elif d["verb"] in JS_VERBS:
            verb = "ALL" if d["verb"] in ("use", "all") else d["verb"].upper()
            out.append(_record("endpoint", name=d["path"], http_method=verb, path=d["path"], framework="express", handler=functions.get(d["handler"]), start_line=d["start_line"]))
            continue
        else:
            continue
        for f in own:
            functions.setdefault(f["name"], f["qualified_name"])
        out += own
    return out


def extract(content: str | None, file_type: str | None) -> list[dict]:
    """Records of one file; nothing for other languages, blank files and files that can't be read."""
    if not content or not content.strip():
        return []
    try:
        if file_type == ".py":
            return extract_python(content)
        if file_type in (".js", ".jsx", ".ts", ".tsx"):
            return extract_script(content, file_type)
    except (RecursionError, ValueError, IndexError):
        return []
    return []


def extract_symbols(files: DataFrame) -> DataFrame:
    """A row for each record of files (repo_name, file_path, file_type, content), with language; files don't move."""
    from ..sources.repos import language

    shape = f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in RECORD.split(', '))}>>"

    @F.arrow_udf(shape)
    def run(content, kind):
        import pyarrow as pa

        kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        rows = [extract(c, t) for c, t in zip(content.to_pylist(), kind.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")])))

    wide = files.select("repo_name", "file_path", language("file_path").alias("language"), F.posexplode(run(F.col("content"), F.col("file_type"))).alias("_seq", "_r"))
    return wide.select("repo_name", "file_path", "language", F.col("_seq").alias("seq"), "_r.*")
