"""Symbols, imports, table functions, differences, freshness and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinstone.functions import udtf
from veinstone.functions.diffs import diff, line_diff, word_diff
from veinstone.operators import freshness, integrity, versions
from veinstone.sources import symbols

SOURCE = "import os\nfrom pkg.store import save as keep, load\n\nLIMIT = 3\n\n@deco\ndef run(x):\n    return keep(os.path.join(x))\n\nclass A(B):\n    def go(self):\n        self.go()\n\n    def _in(self): ...\n"


def test_symbols_and_imports(spark):
    files = spark.createDataFrame([("pkg/main.py", SOURCE), ("pkg/store.py", "def save(): ...\nfrom . import main\n"), ("bad.py", "def ("), ("notes.md", "x"), ("pkg/__init__.py", "")], "path string, text string")
    out = symbols.parsed(files)
    got = {r["path"]: r for r in out.collect()}
    assert [tuple(s) for s in got["pkg/main.py"]["symbols"]] == [("LIMIT", "constant", 4, 4, True), ("run", "function", 6, 8, True), ("A", "class", 10, 14, True), ("A.go", "method", 11, 12, True), ("A._in", "method", 14, 14, False)]
    assert got["bad.py"]["parse_error"] and got["notes.md"]["language"] == "md" and not got["pkg/__init__.py"]["symbols"]
    assert [c["name"] for c in got["pkg/main.py"]["calls"]] == ["keep", "os.path.join", "self.go"]
    assert {tuple(e) for e in symbols.import_edges(out).collect()} == {("pkg/main.py", "pkg/store.py", 2), ("pkg/store.py", "pkg/main.py", 2)}


def test_bindings_and_calls(spark):
    more = "import pkg.store\nimport pkg.store as st\nfrom pkg import store\n\ndef go():\n    pkg.store.save()\n    st.load.now()\n    store.save()\n    go()\n    len('x')\n\nstore.load()\n"
    files = spark.createDataFrame([("pkg/main.py", SOURCE), ("pkg/store.py", "def save(): ...\ndef load(): ...\n"), ("pkg/__init__.py", ""), ("b.py", more)], "path string, text string")
    out = symbols.parsed(files).persist()
    got = {(r["path"], r["local"], r["imported"], r["target"]) for r in symbols.bindings(out).collect()}
    assert got == {("pkg/main.py", "keep", "save", "pkg/store.py"), ("pkg/main.py", "load", "load", "pkg/store.py"), ("b.py", "pkg.store", None, "pkg/store.py"), ("b.py", "st", None, "pkg/store.py"), ("b.py", "store", None, "pkg/store.py")}
    calls = {tuple(r) for r in symbols.call_edges(out).collect()}
    assert calls == {
        ("pkg/main.py", "run", "pkg/store.py", "save", 8), ("pkg/main.py", "A.go", "pkg/main.py", "A.go", 12),
        ("b.py", "go", "pkg/store.py", "save", 6), ("b.py", "go", "pkg/store.py", "save", 8), ("b.py", "go", "b.py", "go", 9), ("b.py", None, "pkg/store.py", "load", 12),
    }
    out.unpersist()


def test_table_functions(spark):
    udtf.register(spark)
    spark.createDataFrame([("a.py", SOURCE)], "path string, text string").createOrReplaceTempView("files")
    assert spark.sql("select s.name from files, lateral symbols(text) s where kind = 'method'").count() == 2
    assert [r[0] for r in spark.sql("select g.line from files, lateral grep(text, 'keep') g order by 1").collect()] == [2, 8]
    assert spark.sql("select l.text from files, lateral read_lines(text, 4, 4) l").first()[0] == "LIMIT = 3"


def test_differences(spark):
    assert diff(list("abcd"), list("acxd")) == [("=", "a"), ("-", "b"), ("=", "c"), ("+", "x"), ("=", "d")]
    assert diff(["a"], ["b"]) == [("-", "a"), ("+", "b")]
    assert [o for o, _ in diff(["x"] * 1500, ["x"] * 1500)] == ["-"] * 1500 + ["+"] * 1500
    d = spark.createDataFrame([("a\nb", "a\nc"), (None, "z")], "x string, y string")
    got = [[tuple(o) for o in r[0]] for r in d.select(line_diff(F.col("x"), F.col("y"))).collect()]
    assert got == [[("=", "a"), ("-", "b"), ("+", "c")], [("+", "z")]]
    one = d.limit(1).select(word_diff(F.lit("the old way"), F.lit("the new way"))).first()[0]
    assert [tuple(o) for o in one] == [("=", "the "), ("-", "old"), ("+", "new"), ("=", " way")]


def test_claims(spark):
    cites = spark.createDataFrame([(1, "a", 2, 3), (2, "a", 8, 9), (3, "gone", 1, 1), (4, "same", 1, 5)], "claim int, path string, start long, stop long")
    changes = spark.createDataFrame([("a", "b", "renamed", [(3, 1, 3, 2)]), ("gone", None, "deleted", [])], "old_path string, new_path string, status string, hunks array<struct<old_start:long,old_count:long,new_start:long,new_count:long>>")
    s = freshness.citation_status(cites, changes)
    got = {r["claim"]: (r["status"], r["new_path"], r["new_start"]) for r in s.collect()}
    assert got == {1: ("stale", None, None), 2: ("fresh", "b", 9), 3: ("stale", None, None), 4: ("fresh", "same", 1)}
    claims = spark.createDataFrame([(1, None, []), (2, "x", []), (3, None, []), (4, "x", []), (5, None, [1, 4]), (6, None, [4])], "claim int, stale_since string, supports array<int>")
    assert {r["claim"]: r["status"] for r in freshness.claim_status(claims, s).collect()} == {1: "stale", 2: "fresh", 3: "stale", 4: "stale-kept", 5: "stale", 6: "fresh"}


def test_versions(spark):
    old = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("g", 3, "c")], "feature string, seq int, body string")
    assert {r["feature"]: r["body"] for r in versions.current(old).collect()} == {"f": "b", "g": "c"}
    new = spark.createDataFrame([("f", 4, 2), ("f", 5, 2), ("g", 6, 1), ("h", 7, None)], "feature string, seq int, parent int")
    ok, no = versions.checked_append(old, new)
    assert {r["seq"] for r in ok.collect()} == {4, 7} and {r["seq"] for r in no.collect()} == {5, 6}
    m = spark.createDataFrame([(1, "p", "f"), (2, "p", "g"), (1, "q", "f")], "seq int, path string, feature string")
    to = spark.createDataFrame([("f", "h"), ("h", "k")], "id string, target string")
    assert {r["path"]: r["feature"] for r in versions.final_feature(m, to).collect()} == {"p": "g", "q": "k"}


def test_sets(spark):
    a, b = spark.range(5).toDF("k"), spark.range(5).toDF("k").union(spark.range(2).toDF("k"))
    assert integrity.same_members(a, b, ["k"]) and not integrity.same_members(a, b.where("k > 0"), ["k"])
