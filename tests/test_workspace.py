"""Content hashes, ignore files and package entries against published values and brute force."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from quillgraph.functions import blake3
from quillgraph.operators import contenthash, ignores, packages

# Published hashes of n bytes that count from 0 to 250 over and over.
PUBLISHED = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a", 2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2", 3073: "7124b49501012f81cc7f11ca069ec9226cecb8a2c850cfe644e327d22d3e1cd3", 31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def test_published_hashes(spark):
    data = {n: bytes(k % 251 for k in range(n)) for n in PUBLISHED}
    assert {n: blake3.digest(x).hex() for n, x in data.items()} == PUBLISHED
    rows = spark.createDataFrame([*data.items(), (-1, None)], "file_id int, content binary")
    for piece in (1024, 4096, 1 << 20):
        got = {r.file_id: (r.hash, r.size_bytes) for r in contenthash.blake3_hashes(rows, piece=piece).collect()}
        assert got == {n: (h, n) for n, h in PUBLISHED.items()} | {-1: (None, None)}
    twice = spark.createDataFrame([(1, "é" * 9000), (1, "é" * 9000)], "file_id int, content string")
    assert [r.hash for r in contenthash.blake3_hashes(twice, piece=1024).collect()] == [blake3.digest(("é" * 9000).encode()).hex()] * 2
    assert contenthash.blake3_hashes(rows.where("false")).count() == 0


def test_blake3_of_many_texts_together(monkeypatch):
    """Many small texts take as many array steps as one large one, not so many each."""
    texts = [bytes([k % 251]) * (37 * k) for k in range(200)]
    alone = [blake3.digest(x) for x in texts]
    calls, compress = [], blake3.compress
    monkeypatch.setattr(blake3, "compress", lambda *a: calls.append(1) or compress(*a))
    assert blake3.digests(texts) == alone
    assert len(calls) <= 16 + 3


def test_hashes_of_documents(spark, sf):
    from quillgraph.queries import workspace

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.hash for r in workspace.blake3_hashes(spark, sf).collect()}
    assert got == {k: blake3.digest(t.encode()).hex() for k, t in texts.items()}


@pytest.mark.parametrize("line,fits,fails", [
    ("*.log", ["a.log", "x/y/b.log"], ["log", "a.logs"]), ("/top", ["top"], ["x/top"]), ("a/b", ["a/b"], ["x/a/b"]), ("**/deep", ["deep", "x/deep"], ["deeper"]), ("a/**", ["a/x", "a/x/y"], ["a"]), ("a/**/z", ["a/z", "a/x/y/z"], ["az"]),
    ("x?z", ["xyz"], ["x/z", "xz"]), ("[ab]c", ["ac", "q/bc"], ["cc"]), ("[!ab]c", ["cc"], ["ac"]), (r"\#a", ["#a"], ["a"]), (r"\!b", ["!b"], ["b"]), ("dot.", ["dot."], ["dotx"]), ("trail \t", ["trail"], ["trail "]), ("a*b*", ["axbx", "ab"], ["a/b"]),
])
def test_patterns(line, fits, fails):
    pattern, keep, folder = ignores.pattern_of(line)
    assert not keep and not folder and all(re.match(pattern, x) for x in fits) and not any(re.match(pattern, x) for x in fails)


def brute_ignored(path, files):
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        node, folder, verdict = "/".join(parts[:n]), n < len(parts), None
        for depth in range(n):
            where = "/".join(parts[:depth])
            for at in sorted(files):
                if at.rpartition("/")[0] == where:
                    for line in files[at].split("\n"):
                        if (rule := ignores.pattern_of(line)) and (folder or not rule[2]) and re.match(rule[0], "/".join(node.split("/")[depth:])):
                            verdict = not rule[1]
        if verdict:
            return True
    return False


def test_nested_ignore_files_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    names = ["a", "b", "c.ts", "d.ts", "build"]
    paths = sorted({"/".join([*rng.choices(["a", "b", "build"], k=rng.randrange(4)), rng.choice(names)]) for _ in range(200)})
    lines = ["*.ts", "!c.ts", "build/", "/a", "a/b/", "!build", "**/b", "!a/**", "# x", "", "b/*.ts", "/*", "!/a"]
    for where in (0, 10**6):
        monkeypatch.setattr(ignores, "BROADCAST_FOLDERS", where)
        files = {d + "/" * bool(d) + name: "\n".join(rng.choices(lines, k=4)) for d in ("", "a", "a/b", "build", "b/a") for name in (".gitignore", ".ignore") if rng.random() < 0.8}
        got = {r.rel_path: r.ignored for r in ignores.ignored_paths(spark.createDataFrame([(p,) for p in paths], "rel_path string"), spark.createDataFrame(list(files.items()), "rel_path string, content string")).collect()}
        assert got == {p: brute_ignored(p, files) for p in paths}
    none = spark.createDataFrame([], "rel_path string, content string")
    assert ignores.ignored_paths(spark.createDataFrame([("a",)], "rel_path string"), none).collect() == [("a", False)]


def test_exports_maps():
    holds = ["import", "default"]
    look = lambda exports, inner: tuple(packages.targets_of(json.dumps({"exports": exports}), inner, holds).values())
    assert look("./m.js", "") == (["./m.js"], "exports") and look("./m.js", "x") == ([], "not_exported") and look({"import": "./i", "default": "./d"}, "") == (["./i"], "exports")
    assert look({"default": "./d", "import": "./i"}, "") == (["./d"], "exports") and look({"require": "./r"}, "") == ([], "not_exported") and look({".": {"node": {"import": "./n"}, "import": {"types": "./t", "default": "./i"}}}, "") == (["./i"], "exports")
    tree = {"./a/*": "./x/*.js", "./a/b/*": "./y/*/*.js", "./a/*.css": "./css/*", "./a/secret": None, "./e": ["./one", {"import": "./two"}], "./f": {"import": None, "default": "./no"}}
    assert look(tree, "a/q") == (["./x/q.js"], "exports") and look(tree, "a/b/q/r") == (["./y/q/r/q/r.js"], "exports") and look(tree, "a/secret") == ([], "blocked") and look(tree, "e") == (["./one", "./two"], "exports")
    assert look(tree, "f") == ([], "blocked") and look(tree, "a/") == ([], "not_exported") and look(tree, "") == ([], "not_exported") and look(tree, "a/m.css") == (["./css/m"], "exports")
    plain = lambda own, inner: tuple(packages.targets_of(json.dumps(own), inner, holds).values())
    assert plain({"main": "lib", "types": "t.d.ts"}, "")[0][:2] == ["t.d.ts", "lib"] and plain({}, "in/ner") == (["in/ner"], "path") and packages.targets_of("{", "", holds)["via"] == "invalid" and packages.targets_of("[]", "", holds)["via"] == "invalid"


def test_targets_stay_inside(spark):
    known = spark.createDataFrame([("p", "pkg/p", json.dumps({"exports": {".": "./../../etc", "./n": "./node_modules/x", "./ok": "./src/../src/a", "./abs": "/etc"}})), ("r", "", json.dumps({"main": "./../x"})), ("two", "a", "{}"), ("two", "b", "{}")], "name string, folder string, manifest string")
    files = spark.createDataFrame([(1, "pkg/p/src/a.ts"), (2, "etc.ts"), (3, "pkg/p/node_modules/x.ts"), (4, "a/i.ts"), (5, "b/i.ts"), (6, "a/k/index.js")], "file_id int, rel_path string")
    asks = spark.createDataFrame([(0, "p"), (1, "p/n"), (2, "p/ok"), (3, "p/abs"), (4, "r"), (5, "two/i"), (6, "two/k"), (7, "other"), (8, "two")], "import_id int, specifier string")
    got = {r.import_id: (r.status, r.target_file_id) for r in packages.resolve_exports(asks, known, files).collect()}
    assert got == {0: ("unsafe", None), 1: ("unsafe", None), 2: ("resolved", 1), 3: ("unsafe", None), 4: ("unsafe", None), 5: ("ambiguous", None), 6: ("resolved", 6), 8: ("missing", None)}
    assert packages.resolve_exports(asks, known.where(F.lit(False)), files).count() == 0
