import ast
import json
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgraph.llm import syntax as S
from loamgraph.llm.derivatives import EMPTY, Grammar

SCHEMA = "file_id long, repo string, file_path string, ext string, text string, valid string, language string"

GOOD = {
    "javascript": ["", "// c\n", "a\nb", "let x = 1\nlet y = 2", "a = b\n++c", "x => { return 1 }", "async (a, {b, c=1}, ...d) => await a", "for (const [a,b] of c) {}", "for await (const x of y) z()", "for (let i=0,n=5;i<n;i++) {}", "for (var k in o) if (o[k]) continue; else break",
        "`a${b+`${c}`}d`", "x = /[/]\\/a/g.test(y) / 2", "a?.b?.[c]?.(d)", "class A extends B { static #p = 1; get x() { return 1 } static { } async *gen() { yield* x } constructor() { super() } a; b = 2\n c\n }", "export default class {}", "export * as ns from \"m\"", "import a, {b as c} from \"m\"\nimport * as e from \"n\"",
        "label: for(;;) { break label }", "var {a, b: {c}, ...r} = d", "new a.b.C(1)(2)", "do { } while (x)\ny", "try { } catch { } finally { }", "({a, b, c(){}, get d(){return 1}, [e]: 1, \"f\": 2, async g(){} , ...h})", "!function(){}()", "1_000n + 0xff", "a ??= b", "import(\"x\").then(y)", "import.meta.url", "a\n/b/g", "if (x) /re/.test(y)", "let of = 1", "[a,,b] = c", "({a} = b)", "e => ({})", "#!/usr/bin/env node\nx"],
    "jsx": ["const a = <div/>", "const a = <div a=\"1\" b={c} {...d}>text {e} <b.c/> {/* x */} <></></div>;", "x = a < b && c > d", "f(<A/>, <B>{[1].map(n => <li key={n}>{n}</li>)}</B>)", "const x = (\n <a href=\"x\">it's</a>\n)"],
    "typescript": ["let x: number = 1", "function f<T extends A = B>(a?: T, ...b: string[]): a is string { return true }", "interface A<T> extends B, C { a: string; b?(x: number): void; readonly [k: string]: any; new (x): A }", "type A = { [K in keyof T]?: T[K] } | (string | null)[] | typeof x | `a${string}`", "enum A { B, C = 1 }", "declare module \"x\" { export function f(a: number): void; }",
        "abstract class A<T> implements B { private readonly x: number = 1; constructor(public a: string, private b?) { super() } abstract f(): void; h!: string; [k: string]: any }", "const a = b as unknown as C<D<E>>", "const a = <T>(x: T): T => x", "let x = <any>y", "new Map<string, Array<number>>()", "type C = A extends infer U ? U : never", "import type { A } from \"x\"", "declare global { interface Window { a: b } }", "let t: [a: string, b?: number, ...c: X[]]", "const x = y satisfies Z", "function f(a: string): void;\nfunction f(a: any) {}", "@dec() class A { @p() x = 1 }"],
    "tsx": ["const a = <T,>(x: T) => <div>{x as any}</div>", "const x = a < b ? <i>1</i> : null"],
    "json": ["{}", " [1, -2.5e3, \"a\\u00e9\", true, null] "],
}
BAD = {
    "javascript": ["const = 1", "let x = ", "function (x) {}", "a b", "if (a {", "\"abc", "`abc", "}", "x = {a:", "const x;", "1 = x", "a = “x”", "import {a from \"b\"", "/* x", "x.", "([)]", "let 1a", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x"],
    "jsx": ["<div>", "<div></span>", "<a b=></a>", "<div>{</div>", "x = <a>}</a>", "<div/>x</div>"],
    "typescript": ["let x: = 1", "interface A { a: }", "type A = ", "enum A { B C }", "const x: number", "x = <div id=\"a\">y</div>", "let a: Array<string"],
    "tsx": ["const a = <div>", "const a = <div></p>"],
    "json": ["", "{a: 1}", "{'a': 1}", "[1,]", "01", "{\"a\": 1", "NaN", "// c\n{}"],
}
PYTHON = ["", "# x", "x = 1", "def f(a, /, b=1, *c, d, **e) -> int: ...", "async def f():\n    async with a as b, c: await d", "match x:\n    case [1, *a] if b: pass\n    case {\"a\": 1, **r} | A(b=2): pass", "type X[T] = int", "f\"{x!r:>{w}} {{ {y=} {d[\"a\"]}\"", "lambda *a, b=1: (yield)", "a, *b = c", "{**a, 'b': 1}", "with (open(a) as b, open(c) as d,): pass", "try:\n  pass\nexcept* A as e:\n  pass", "x = 1;\n", "match = 1", "print(1if x else 2)", "f\"\"\"{\nx}\"\"\"", "while 1:\n\tpass", "x = ", "def f(:", "print 'x'", "if x\n  pass", "  x = 1", "if x:\npass", "\"abc", "'''abc", "(a", "a)", "f\"{a\"", "f\"{}\"", "def f(a=1, b): pass", "try:\n  x\ny", "a = 0777", "1a", "f(a=1, b)", "\tif x:\n        y\n\t z", "x = “a”", "f() = 1", "if x:\n  y\n z", "a = b'é'", "except A, B: pass", "for x in: pass", "x = [1, 2", "x = 1 \\\n + 2", "class A: x: int = 1\n", "del (a, b)", "global a, b", "(" * 200 + ")" * 200, "(" * 201 + ")" * 201, "".join(" " * i + "if x:\n" for i in range(99)) + " " * 99 + "y", "".join(" " * i + "if x:\n" for i in range(100)) + " " * 100 + "y"]


def python_ok(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError):
            return False


@pytest.mark.parametrize("language", GOOD)
def test_good_and_bad(language):
    assert [x for x in GOOD[language] if not S.check(x, language).valid] == []
    assert [x for x in BAD[language] if S.check(x, language).valid] == []


def test_byte_order_mark():
    assert S.check("\ufeffx = 1", "python").valid and S.check("\ufeff{}", "json").valid


def test_python_like_the_interpreter():
    assert [x for x in PYTHON if S.check(x, "python").valid != python_ok(x)] == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["x", "=", "1", "(", ")", "[", "]", ":", ",", "\n", "if ", "else", "def f", "    ", "return ", " in ", "for ", "'a'", "f'{x}'", ".", "*", "lambda ", "not ", "import a", "pass"]), max_size=9))
def test_python_random(parts):
    text = "".join(parts)
    assert S.check(text, "python").valid == python_ok(text), text


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet='{}[],:"1 atrue-.', max_size=10))
def test_json_random(text):
    def strict(t):
        try:
            json.loads(t, parse_constant=lambda c: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    assert S.check(text, "json").valid == strict(text)


@pytest.mark.parametrize("language", ["javascript", "tsx"])
def test_deep_nesting(language):
    assert S.check("x = " + "(" * 190 + "1" + ")" * 190, language).valid
    assert not S.check("x = " + "[" * 5000 + "]" * 5000, language).valid


def test_reasons():
    assert S.check("def f():\n", "python").reason == "truncated"
    v = S.check("x = 1\ny = = 2\n", "python")
    assert v.reason == "token" and v.at == 10
    assert S.check("a = 1\n<<<<<<< HEAD\nb = 2\n", "python").reason == "conflict"


def test_derivatives_are_memoised_and_reset(monkeypatch):
    g = Grammar("s = '(' [ s ] ')' ;", "s")
    state = g.fresh()
    for _ in range(50):
        state = g.derive(state, g.token("("))
    for _ in range(50):
        state = g.derive(state, g.token(")"))
    assert g.nullable(state) and g.derive(state, g.token(")")) == EMPTY
    monkeypatch.setattr("loamgraph.llm.derivatives.MEMO_LIMIT", 1)
    assert g.fresh() == g.start and len(g.memo) == 0


def test_table(spark):
    rows = [(1, "r", "a.py", ".py", "x = ", "v", "l"), (1, "r", "a.py", ".py", "x = ", "v", "l"), (2, "r", "b.JSON", None, "{}", "", ""), (3, None, None, ".py", "", "", ""), (4, "r", "c.txt", ".txt", "x = ", "", ""), (5, "r", "d.py", ".py", None, "", ""), (6, "r", "e.js", ".js", "x = [" + "1," * 60000 + "]", "", ""), (7, "r", "f.py", ".py", "(" * 300 + ")" * 300, "", "")]
    df = S.verdicts(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r.file_id, r.language, r.valid) for r in df.collect())
    assert got == [(1, "python", False), (1, "python", False), (2, "json", True), (3, "python", True), (6, "javascript", True), (7, "python", False)]
    rep = {(r.repo, r.language): (r.files, r.invalid) for r in S.report(df).collect()}
    assert rep["r", "python"] == (3, 3)
    assert S.verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("language", ["javascript", "tsx", "json"])
def test_deep_nesting(language):
    """Scripts and data may nest as deep as they like; after such a text others are judged as before."""
    for n in (201, 2500):
        forms = ["[" * n + "]" * n, '{"a":' * n + "1" + "}" * n] if language == "json" else ["x = " + "(" * n + "a" + ")" * n, "{" * n + "}" * n, "f(" * n + ")" * n, "x = " + "{a: [" * n + "]}" * n]
        assert [f[:20] for f in forms if not S.check(f, language).valid] == []
        assert not S.check("[" * n + "]" * (n - 1), language).valid and not S.check("[" * n + ")" + "]" * (n - 1), language).valid
    assert S.check("[1]", language).valid and not S.check("[1", language).valid
