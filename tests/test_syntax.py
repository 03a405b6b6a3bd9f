"""Facts from tokens: texts that look like code, statements over several lines, long files."""

import time

import pyarrow as pa
from quillgraph.functions.lexer import tokens
from quillgraph.functions.syntax import facts
from quillgraph.operators import extract

ALL = frozenset(["symbol", "import", "binding", "export", "call", "reference", "status"])


def found(code, language, *fields, fact):
    return [tuple(f.get(x) for x in fields) for f in facts(code, language, frozenset([fact]))]


def test_nothing_in_strings_templates_and_comments_is_code():
    code = "const a = `x ${ {b: `in ${ f(1) }`} } function no() {`\n/* function nor() {\n class Never { */ // import 'x'\nconst s = \"} import 'y'\", r = /[/{]\\/}/g\nclass K { m() { return `${this.a}}` } }\nafter()"
    assert found(code, "typescript", "kind", "qualified_name", "line", "line_end", fact="symbol") == [("constant", "a", 1, 1), ("constant", "s", 4, 4), ("constant", "r", 4, 4), ("class", "K", 5, 5), ("method", "K.m", 5, 5)]
    assert found(code, "typescript", "seq", "name", fact="status") == [(0, "")] and found(code, "typescript", "name", fact="call") == [("f",), ("after",)]
    assert found(code, "typescript", "name", fact="import") == []
    rust = "fn a() { let s = r#\"} fn no() {\"#; /* /* { */ { */ let c = '{'; let l: &'a str = \"\\\"}\"; }\nfn b() {}"
    assert found(rust, "rust", "name", "line_end", fact="symbol") == [("a", 1), ("b", 2)] and found(rust, "rust", "seq", fact="status") == [(0,)]
    go = 'package p\nvar s = `func no() {`\nfunc Yes() interface{} { return "}" } // {'
    assert found(go, "go", "name", "flag", fact="symbol") == [("Yes", True)] and found(go, "go", "seq", fact="status") == [(0,)]
    python = 'class A:\n    """def no():\n    class Nor: {"""\n    def yes(self, x=(1,\n2)):  # def never(): (\n        return f"{x}("\n'
    assert found(python, "python", "kind", "qualified_name", "line", "line_end", fact="symbol") == [("class", "A", 1, 6), ("method", "A.yes", 4, 6)]
    assert found(python, "python", "seq", fact="status") == [(0,)]


def test_statements_over_lines_and_several_on_one():
    code = "import {\n  a,\n  type B as C,\n} from './m'; import d from 'd'\nimport type { T } from 't'\nexport {\n a as z } from 'q'; export * as n from 'n'\nexport default class extends K {}\nexport default async function named() {}\nexport default 1 + 2\nexport const x = 1, y = () => {\n import('lazy') }\nimport fs = require('fs')"
    assert found(code, "typescript", "kind", "specifier", "line", fact="import") == [("esm", "./m", 1), ("esm", "d", 4), ("esm", "t", 5), ("reexport", "q", 6), ("reexport", "n", 7), ("dynamic", "lazy", 12), ("require", "fs", 13)]
    assert found(code, "typescript", "local_name", "imported_name", "type_only", fact="binding") == [("a", "a", False), ("C", "B", True), ("d", "default", False), ("T", "T", True), ("z", "a", False), ("n", "*", False)]
    assert found(code, "typescript", "kind", "name", "local_name", fact="export") == [("list", "z", "a"), ("all", "n", "n"), ("default", "default", None), ("default", "default", "named"), ("default", "default", None), ("named", "x", "x"), ("named", "y", "y")]
    assert found("use a::{b, c::{self, d as e}, f::*};\npub use g;", "rust", "specifier", "local_name", "flag", fact="import") == [("a::b", None, False), ("a::c", None, False), ("a::c::d", "e", False), ("a::f::*", None, False), ("g", None, True)]
    assert found("from .a import (b as c,\n  d)\nimport e.f as g, h", "python", "specifier", "local_name", "imported_name", fact="binding") == [(".a", "c", "b"), (".a", "d", "d"), ("e.f", "g", "*"), ("h", "h", "*")]


def test_scopes_and_calls():
    code = "class A<T extends { x: 1 }> extends B<T> {\n  #p = 1\n  static async make<U>(n: U): Promise<{ a: U }> {\n    if (n) { function deep() { return [1].map((v) => v) } }\n    return new Box<U>(n).open?.(1)\n  }\n  abstract none(): void\n  get size() { return 1 }\n  on = () => { this.go() }\n}\nconst o = { run() { super.x(); a.b(c)(d) } }\nconst kind = class extends Z { inner() {} }"
    assert found(code, "typescript", "kind", "qualified_name", fact="symbol") == [("class", "A"), ("field", "A.p"), ("method", "A.make"), ("function", "A.make.deep"), ("method", "A.size"), ("field", "A.on"), ("constant", "o"), ("method", "run"), ("constant", "kind"), ("method", "inner")]
    assert found(code, "typescript", "kind", "name", "parent", fact="call") == [("method", "map", "A.make.deep"), ("constructor", "Box", "A.make"), ("method", "open", "A.make"), ("method", "go", "A.on"), ("method", "x", "run"), ("method", "b", "run")]
    rust = "mod m { trait T { fn f(&self); } impl<X> T for a::S<X> { fn f(&self) { self.g(1); vec![2]; println!(\"{}\", h(3)) } } }"
    assert found(rust, "rust", "kind", "qualified_name", fact="symbol") == [("module", "m"), ("trait", "m.T"), ("method", "m.T.f"), ("method", "S.f")]
    assert found(rust, "rust", "kind", "name", fact="call") == [("method", "g"), ("macro", "println"), ("direct", "h")]
    go = "type (\n A struct { f func(int) }\n B int\n)\nfunc (a *A) Run() { a.f(1); go(func() { b() })() }"
    assert found(go, "go", "kind", "qualified_name", fact="symbol") == [("struct", "A"), ("type", "B"), ("method", "A.Run")]


def test_references_of_scripts():
    code = "function f(p: Arg, q?: number) { const o = { key: p, short }; o.x = q; n++; return o as Out }\nlet y = f(1)"
    got = found(code, "typescript", "name", "kind", "confidence", fact="reference")
    assert got == [("f", "write", 0.65), ("p", "read", 0.5), ("Arg", "type", 0.7), ("q", "read", 0.5), ("o", "write", 0.65), ("p", "read", 0.5), ("short", "read", 0.5), ("o", "read", 0.5), ("x", "read", 0.5), ("q", "read", 0.5), ("n", "write", 0.65), ("o", "read", 0.5), ("Out", "type", 0.7), ("y", "write", 0.65), ("f", "read", 0.5)]


def test_what_does_not_fit_is_told(spark):
    rows = [("(]", "unexpected ] in line 1; 1 blocks not closed"), ("'a\nb", "string not closed in line 1"), ("\n`a ${b", "1 blocks not closed"), ("\n`a", "template not closed in line 2"), ("x /* a", "comment not closed in line 1"), ("f({)", "{ not closed in line 1"), ("", ""), ("}" * 9, "; ".join(["unexpected } in line 1"] * 5))]
    files = spark.createDataFrame([(k, "typescript", c) for k, (c, _) in enumerate(rows)] + [(90, "python", "x = '''a"), (91, "python", ""), (92, "java", "{"), (93, "go", "a\0b"), (94, "rust", None)], "file_id int, language string, content string")
    got = {r.file_id: (r.status, r.diagnostics) for r in extract.parse_status(files).collect()}
    assert got == {k: ("parsed_with_errors" if d else "parsed", d) for k, (_, d) in enumerate(rows)} | {90: ("parsed_with_errors", "string not closed in line 1"), 91: ("parsed", None), 92: ("skipped", None), 93: ("skipped", None), 94: ("skipped", None)}


def test_long_files_take_linear_time(spark):
    unit = "function f(a) { const c = { k: a }; return g(`${ c.k }`, [1, 2]) }\n"
    took = []
    for n in (5_000, 20_000):
        began = time.time()
        assert len(facts(unit * n, "typescript", frozenset(["symbol"]))) == 2 * n
        took.append(time.time() - began)
    assert took[1] < 10 * took[0]
    nested = "function f() { " * 3000 + "g()" + " }" * 3000
    assert len(found(nested, "typescript", "name", fact="symbol")) == 3000
    one = spark.createDataFrame([(1, "typescript", "class A {\n" + "  m() { return x }\n" * 50_000 + "}")], "file_id int, language string, content string")
    assert extract.scoped_symbols(one).where("qualified_name = 'A.m' and parent = 'A'").count() == 50_000


def test_any_text_is_read(spark):
    """Every prefix of odd code is read to its end."""
    odd = "export default class extends { a = `${ function*(x?: {y}) => { async get #z([)]] } import * as from export { as , } from 'x' new () ?. ( type = < > => ... use {::} impl for { go func ( import ( type ( def class : from . import"
    for language in extract.LANGUAGES:
        for k in range(len(odd)):
            assert facts(odd[:k], language, ALL)[-1]["fact"] == "status"
            assert all(t.text == odd[t.start : t.end] or t.kind == "s" for t in tokens(odd[:k], language).all)


def test_copies_share_a_walk(spark, monkeypatch):
    """Of equal texts in equal languages one is walked a task, and each file has all facts; little is remembered."""
    from quillgraph.functions import syntax
    from quillgraph.operators import extract

    text = "import { a } from './b'\nexport const c = a(1)\n"
    rows = [(k, ("typescript", "python")[k % 2], text if k % 3 else f"import d{k}\n") for k in range(60)]
    files = spark.createDataFrame(rows, "file_id long, language string, content string").coalesce(1)
    want = {(k, f["name"], f["line"]) for k, language, t in rows for f in syntax.facts(t, language, frozenset(["reference"]))}
    for held in (4_000_000, 1):
        monkeypatch.setattr(extract, "SAME_HELD", held)
        assert {(r.file_id, r.name, r.line) for r in extract.references(files).collect()} == want
    calls, walk = [], syntax.facts
    monkeypatch.setattr(extract, "SAME_HELD", 4_000_000)
    monkeypatch.setattr(syntax, "facts", lambda *a: calls.append(1) or walk(*a))
    monkeypatch.setattr(extract, "spread", lambda df: df)
    runs = []
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, f, schema, *a: runs.append(f) or self.limit(0).selectExpr(*[f"cast(null as {c.rsplit(' ', 1)[1]}) as {c.split(' ')[0]}" for c in schema.split(", ")]))
    extract.facts(files, "reference")
    batch = pa.RecordBatch.from_pydict({"file_id": [1, 2, 3], "language": ["typescript"] * 3, "content": [text] * 3})
    out = list(runs[0](iter([batch])))
    assert len(calls) == 1 and {i for b in out for i in b.column(0).to_pylist()} == {1, 2, 3}
