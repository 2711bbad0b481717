import pytest

from tessera.functions.script import Script
from tessera.operators import symbols


def found(text, suffix=".ts"):
    """Names by kind, with bases, members and what else tells records apart."""
    out = []
    for r in symbols.extract_script(text, suffix):
        if r["kind"] in ("class", "inherits"):
            out.append((r["kind"], r["name"], r["parent"] or ""))
        elif r["kind"] == "function":
            out.append(("async " * r["is_async"] + ("method" if r["is_method"] else "function"), r["qualified_name"], f"{r['start_line']}-{r['end_line']}"))
        elif r["kind"] == "endpoint":
            out.append((r["http_method"], r["path"], r["handler"] or ""))
        else:
            out.append(("import", r["module"], ",".join(r["symbols"])))
    return out


AFTER = "\nclass After { m() {} }\nfunction last() {}\n"


def rest(line):
    return [("class", "After", ""), ("method", "After.m", f"{line}-{line}"), ("function", "last", f"{line + 1}-{line + 1}")]


@pytest.mark.parametrize(
    "text",
    [
        "const a = `x ${b ? `{` : ''} y`;",
        "const a = `${`${`${'}'}`}`}`;",
        "if (x) /[`]/.test(y);",
        "while (/[{]/.test(x)) x = x.slice(1)",
        "const r = a / b / c, q = (a + b) / 2, s = [1] / 3; x++ / 2;",
        "const r = /[/\\]`]+\\/{/gi, s = x.split(/[`'\"{]/);",
        "function f() {} /{`/.test(x);",
        "const o = { a: 1 } / 2;",
        "const t = cond ? /`/ : /'/;",
        "return /`/;",
        "let it = 'it\\'s', b = \"{\\\"\";",
        "// it's a ` comment {\n/* ` { ' */",
        "type A<T> = T extends { x: infer U } ? U[] : never;",
        "export type F = (a: string) => void",
        "type U =\n  | { a: 1 }\n  | (() => void)\n",
        "interface Props { a: string; b(): void; c: { d: number } }",
        "enum E { A = '{', B }",
        "declare module 'x' { function no(): void; }",
        "namespace N { export class No {} }",
        "export { a, b as c } from './m';\nexport * from 'n';",
        "export type { T } from './t'",
        "abstract: for (;;) { break abstract; }",
        "label: { function no() {} }",
        "if (a) { class No {} } else if (b) { function no() {} } else x()",
        "try { x() } catch (e) { class No {} } finally { y() }",
        "do { x() } while (a < b)",
        "switch (a) { case 1: { function no() {} } default: x }",
        "(function no() { class No {} })()",
        "!function () { return `}` }()",
        "const s = a < b, t = c > (d)",
        "foo(class No { m() {} })",
        "export default { data() { return {} }, methods: { no() {} } }",
        "module.exports = { a, b: function no() {} }",
        "x = y\n(z)",
        "var notListed = function () {}",
    ],
)
def test_what_follows_is_found(text):
    """Sources with brackets and quotes where they aren't code, and statements that declare nothing here."""
    line = text.count("\n") + 2
    got = [r for r in found(text + AFTER) if r[0] != "function" or r[1] != "f"]
    assert got == rest(line)


@pytest.mark.parametrize(
    "text, records",
    [
        ("export default class extends B {}", []),
        ("export default function () {}", []),
        ("export default class Named extends B {}", [("class", "Named", ""), ("inherits", "Named", "B")]),
        ("class A<T extends {x: number}> extends B<T> { m() {} }", [("class", "A", ""), ("inherits", "A", "B"), ("method", "A.m", "1-1")]),
        ("class A<T = Map<string, {a: 1}>> implements I<T>, J {}", [("class", "A", "")]),
        ("class A extends ns.sub.Base<X[]> implements I {}", [("class", "A", ""), ("inherits", "A", "Base")]),
        ("class A extends mixin(B, class { no() {} }) { m() {} }", [("class", "A", ""), ("method", "A.m", "1-1")]),
        ("class A extends (x ? B : C) { m() {} }", [("class", "A", ""), ("method", "A.m", "1-1")]),
        ("abstract class A { abstract x(): void; protected abstract readonly y: string\n  z() {} }", [("class", "A", ""), ("method", "A.y", "1-1"), ("method", "A.z", "2-2")]),
        ("const f = ({a}, b = (1)) => {}", [("function", "f", "1-1")]),
        ("const f = async <T,>(x: T): Promise<{a: T}> => {\n  return x\n}\nlet g = (a: (b: string) => void): a is string => true, h = 3, i = async x => x", [("async function", "f", "1-3"), ("function", "g", "4-4"), ("async function", "i", "4-4")]),
        ("const f: (a: string) => { b: number } = function* named() {}", [("function", "f", "1-1")]),
        ("const f = (a) * 2, g = (b), h = call(() => 1)", []),
        ("const { a, b } = require('x'), c = () => a", [("function", "c", "1-1")]),
        ("function over(a: string): void;\nfunction over(a: number): void;\nfunction over(a: any): a is { b: string } { return a }", [("function", "over", "3-3")]),
        ("async function* gen<T extends Record<string, () => void>>(a = { b: ')' }): AsyncGenerator<T> {\n}", [("async function", "gen", "1-2")]),
        ("@Component({ selector: '}' })\n@Other\nexport class A {\n  @Input() name: string\n  @Output() async\n  constructor(private readonly x: Foo = {}) { super() }\n}", [("class", "A", ""), ("method", "A.name", "4-4"), ("method", "A.async", "5-5"), ("method", "A.constructor", "6-6")]),
        (
            "class A {\n  #count = 0;\n  static #p\n  get size() { return 1 }\n  set size(v) {}\n  static async *all() {}\n  static { init() }\n  ['comp' + 1]() {}\n  'quoted-name'() {}\n  [key: string]: any;\n  get() {}\n  static() {}\n  handler = async (e) => {\n    this.x = { y: 1 }\n  }\n  opt?: number = 1; sure!: string\n  over(a: string): void\n  over(a) {}\n}",
            [("class", "A", ""), *(("method", f"A.{n}", lines) for n, lines in (("#count", "2-2"), ("#p", "3-3"), ("size", "4-4"), ("size", "5-5"))), ("async method", "A.all", "6-6")]
            + [("method", f"A.{n}", lines) for n, lines in (("['comp' + 1]", "8-8"), ("'quoted-name'", "9-9"), ("get", "11-11"), ("static", "12-12"), ("handler", "13-15"), ("opt", "16-16"), ("sure", "16-16"), ("over", "18-18"))],
        ),
        ("import D, { a as b, type C, default as e } from \"m\"\nimport * as ns from 'n'; import 's';\nimport type { T } from './t'\nimport x = require('y')\nconst z = await import('no')", [("import", "m", "D,a,C,default"), ("import", "n", "ns"), ("import", "s", ""), ("import", "./t", "T")]),
        ("import {\n  a,\n  b, // it's\n} from 'm'", [("import", "m", "a,b")]),
        ("function h() {}\napp.get('/a', mid(), h)\nrouter.route('/b').post('/c', x, async (req, res) => { res.get('/no', h) })\nthis.app.use(`/d`, h)\napp.all(\"/e\", [h], h);\napp.get('/f' + g, h)\nawait app.get('/g', h)\nconst q = app.get('/h', h)\napp.get('/i', h).listen(1)\napp.delete('', h)\napp.listen('/j', h)", [("function", "h", "1-1"), ("GET", "/a", "h"), ("POST", "/c", ""), ("ALL", "/e", "h")]),
    ],
)
def test_records(text, records):
    assert found(text) == records


def test_fields_are_members_of_typed_classes_only():
    text = "class A { x = 1; m() {} static y = () => 2 }"
    assert found(text, ".js") == [("class", "A", ""), ("method", "A.m", "1-1")]
    assert found(text, ".ts") == [("class", "A", ""), ("method", "A.x", "1-1"), ("method", "A.m", "1-1"), ("method", "A.y", "1-1")]


@pytest.mark.parametrize("suffix", [".jsx", ".tsx", ".js"])
def test_elements(suffix):
    text = "export const App = ({ a }) => (\n  <><div className=\"it's\" onClick={() => { x(`}`) }}>it's {a ? <b>don't</b> : `{`} {/* ' */}<br/></div></>\n)\nfunction F() { return <A.B x='{' {...p}>&quot; }</A.B>; }" + AFTER
    assert found(text, suffix) == [("function", "App", "1-3"), ("function", "F", "4-4"), *rest(5)]


def test_generic_arrows_in_tsx():
    assert found("const f = <T,>(x: T) => <p>it's</p>\nconst g = <T extends object>(x: T) => x" + AFTER, ".tsx") == [("function", "f", "1-1"), ("function", "g", "2-2"), *rest(3)]


@pytest.mark.parametrize("text", ["", "class", "class {", "function (", "const", "import", "import {", "export", "@", "class A {", "class A { m(", "`${", "`${`", "<div", "/", "'", "a.b.", "}}}", ")", "class A<", "const f = (", "x(", "\x00", "é", "#", "class A { [", "class A { get", "const f: ", "export default", "if (", "do", "async", "type A ="])
def test_broken_sources_end(text):
    for suffix in (".js", ".tsx"):
        for k in range(len(text) + 1):
            Script(text[:k], suffix)
            list(Script(text[:k] + AFTER, suffix).declarations())


def test_every_prefix_of_a_source_ends():
    text = "@D() export class A<T extends {x: 1}> extends B<T> { #p = `a${{b: `c`}}`; async *m(a = /[/]/) { return <T>x } }\nconst f = async ({a}) => <b c={d}>e</b>\napp.get('/x', f)\nimport q, {r as s} from 't'"
    for k in range(len(text) + 1):
        for suffix in (".js", ".ts", ".tsx"):
            list(Script(text[:k], suffix).declarations())
