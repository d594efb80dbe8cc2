import ast
import random

import pytest

from sievework.llm.syntax import check

GOOD = {
    "Python": ["", "# only\n", "x: int = 1\nmatch x:\n    case [a, *b] if a: pass\n    case {'k': v, **r} | K(z=1): ...\n", "f'{a!r:>{w}} {{}} {x=}'\nasync def g[T](a, /, *, b=1) -> int:\n    async with a as b, c: yield (yield)\n", "type X[T] = list[T]\ntry: pass\nexcept* E as e: pass\n", "\ufeffif x:\r\n\ty = 1\r\n"],
    "Java": ["", "// c\n", "package a.b; import static java.util.List.*;\nsealed interface S<T extends Comparable<T>> permits A, B {}\nrecord A(int x, String... y) implements S<A> { A { if (x >>> 2 > 1) throw new E(); } }", "class A { int f(Object o) { return switch (o) { case Integer i when i > 0 -> 1; case P(var a, int b) -> { yield 2; } case null, default -> 0; }; } }", 'enum E { A(1) { void f() {} }, B; String t = """\n  x "y"\n  """; E(int... i) { this(); } @Override public <T> T[] g(T[] a) throws X { for (var z : a) { Runnable r = () -> {}; a = (T[]) z; Foo::<T>new; } } }'.replace("Foo::<T>new;", "g(Foo::new);")],
    "JavaScript": ["", "/* c */", "import a, { b as c } from 'x'; export default class extends B { #p = 1; static { } get x() { return this.#p ?? 1 } async *g() { yield* await f() } }", "const re = /[/}]\\/(?<n>a)/gi, t = `a${`${b}`}c`; for (const [k, { v = 1 }] of x) label: while (1) { break label }\nlet y = a\n++b", "({ a, b: [c] } = d); export const f = async ({ x }, ...r) => ({ ...x, get: 1, [k]() {} }); x?.[0]?.(1); a ||= 2 ** -1"],
    "TypeScript": ["interface A<T = {}> extends B { readonly x?: T; (y: number): void; new <U>(z: U): A; [k: string]: any; m?(): asserts this is A }", "declare module 'x' { export function f(a: string): a is 'b' }\nenum E { A = 1, B }\nabstract class C<in out T> implements D { private constructor(protected readonly x: T) { super() } abstract m(): void; declare y: string; z!: number }", "type M<T> = { -readonly [K in keyof T as `get${K & string}`]?: T[K] extends infer U extends string ? U : never };\nconst x = <T,>(a: T): T => a as unknown as T; let y = f<number>(1)!; export type { A } from './a'; a = b < c, d > (e)"],
    "Go": ["package a\n", "// c\npackage a\n\nimport (\n\t\"fmt\"\n\t. \"os\"\n)\n\ntype S[T any, K ~int | comparable] struct {\n\t*E\n\ta, b T `json:\"x\"`\n}\n\nfunc (s *S[T, K]) f(x int, y ...string) (n int, err error) {\n\tfor i := range 10 {\n\t\tif v, ok := m[i].(P); ok && v == (P{1}) {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch z := x.(type) {\n\tcase nil, []int:\n\tdefault:\n\t\tgo func() { <-c }()\n\t}\nL:\n\tselect {\n\tcase v := <-ch:\n\t\tgoto L\n\tcase ch <- 'a':\n\t}\n\treturn 0, nil\n}\n", "package a\nvar m = map[string][]int{\"a\": {1, 2}, `b`: nil}\ntype F func(int, ...string) <-chan struct{}\n"],
}
BAD = {
    "Python": ["print 'x'", "def f(:\n  pass", "if x:\npass", "x = (1", "f(a=1, b)", "f'{'", "1 = x", "class A\n  pass", "a b", "'abc", "for x in y", "<<<<<<< HEAD\n"],
    "Java": ["class A {", "class A { int x }", "class A { void f() { x + 1; } }", "function f() {}", "class A { f() {} }", "def x():\n  pass", "class A { String s = \"a; }", "=======\nclass A {}", "class A { void f() { if x { } } }"],
    "JavaScript": ["const x;", "let a: number = 1", "function f( {", "a => {", "return 1", "`a${b`", "x = /a(/;", "<div/>", "class A { x y }", "import { a } from", "interface A {}", "a ?? b || c", "({ a = 1 })", "<<<<<<< ours\n"],
    "TypeScript": ["let a: = 1", "interface A { x: }", "enum { A }", "type X =", "class A { constructor( { }", "def f(x): pass", "const a = <div/>;", "function f<T>(a: T { }"],
    "Go": ["", "func f() {}", "package a\nfunc f() {", "package a\nx := 1", "package a\nfunc f() { if x { }\nelse { } }", "package a\nvar x = \"a", "package a\nfunc f(a int, string) {}", "package a\nfunc f() { for i := 0; i < 3 { } }", "package a\n\n}\n"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(language, text):
    assert check(text, language, "a.x") == []


@pytest.mark.parametrize("language,text", [(k, t) for k, v in BAD.items() for t in v])
def test_invalid(language, text):
    assert check(text, language, "a.x")


def test_elements():
    text = "const a = <A.B x='1' {...p} y={<i/>}>t {/* c */} <></> {f(z)}</A.B>;"
    assert check(text, "JavaScript", "a.jsx") == [] and check(text, "TypeScript", "a.tsx") == [] and check(text, "JavaScript", "a.js")
    assert check("const a = <b><c></b>;", "JavaScript", "a.jsx")


def test_all_errors_are_kept_and_the_first_is_the_cause():
    found = check("class A {\n int x = ;\n void f() { y +; }\n int ok;\n}\n", "Java")
    assert [p.line for p in found] == [2, 3]
    found = check("x = = 1\ny = 2\nz = )\n", "Python")
    assert [p.line for p in found] == [1, 3]


def test_python_against_the_interpreter():
    random.seed(8)
    with open(ast.__file__, encoding="utf-8") as f:
        base = f.read()[:6000]
    for _ in range(150):
        i = random.randrange(len(base))
        text = base[:i] + random.choice(["", "(", ")", ":", "\n", "'", " ", "=", ","]) + base[i + random.randrange(3) :]
        try:
            ast.parse(text)
            valid = True
        except SyntaxError:
            valid = False
        assert valid == (check(text, "Python") == []), text[max(0, i - 40) : i + 40]


def test_deep_and_long():
    assert check("x = " + "(" * 3000 + ")" * 3000, "JavaScript")
    assert check("x = " + "(" * 3000 + "1" + ")" * 3000, "JavaScript") == []
    assert check("x = 1\n" * 30_000, "Python") == []


def test_operator(spark):
    from sievework.llm.parsing import parse_files, parse_rates

    rows = [(1, "s", "Go", "a.go", "package a\n"), (2, "s", "Go", "a.go", "pack"), (2, "s", "Go", "a.go", "pack"), (3, "s", "Perl", "a.pl", "x"), (4, "s", "Go", "a.go", None), (5, None, None, None, "x"), (6, "s", "Python", "a.py", "")]
    df = spark.createDataFrame(rows, "file_id long, s string, lang string, path string, text string").selectExpr("*", "1 as valid")
    out = parse_files(df, ["file_id", "s", "lang"], text="text", language="lang", path="path")
    assert {(r.file_id, r.valid) for r in out.collect()} == {(1, True), (2, False), (3, None), (4, None), (5, None), (6, True)}
    assert {(r.lang, r.files, r.invalid, r.rate) for r in parse_rates(out, ["lang"]).collect()} == {("Go", 2, 1, 0.5), ("Python", 1, 0, 0.0)}
    assert parse_files(df.where("false"), ["file_id"], text="text", language="lang", path="path").count() == 0
