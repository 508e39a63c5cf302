"""Names, prose, people and impact on small inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinstone.functions import names as N
from veinstone.functions import text as T
from veinstone.operators import impact, people


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_prose(spark):
    r = one(
        spark, N.sentences(F.lit("It works, e.g. here. Is it? Yes! etc. Next one.")), N.unwritten_numbers(F.lit("It has 3, 14 and 1.5 of `99`."), F.lit("13 14; 1.5.2")),
        N.hook_text(F.lit("The parser reads twice!")), N.hook_text(F.lit("One. Two")), N.hook_text(F.lit("...")), N.link_tokens(F.lit("[[ a ]] `[[b]]` [[c| d ]]")), N.wiki_titles(F.lit("[[wp: some_page ]]")),
        N.unlinked(F.lit("the [[a|big]] [[b]]")), T.link_targets(F.lit("[[ 0 a0 ]]")),
    )
    assert r["c0"] == ["It works, e.g. here.", "Is it?", "Yes!", "etc.", "Next one."] and r["c1"] == ["3", "1.5"]
    assert (r["c2"], r["c3"], r["c4"]) == ("... that the parser reads twice?", None, None)
    assert [tuple(x) for x in r["c5"]] == [("a", None), ("c", "d")] and r["c6"] == ["Some page"] and r["c7"] == "the big b" and r["c8"] == ["0 a0"]


def test_paths_and_packages(spark):
    r = one(
        spark, N.is_lockfile(F.lit("a/b/go.sum")), N.manifest_kind(F.lit("x/requirements-dev.txt")), N.shared_depth(F.lit("a/b/x.py"), F.lit("a/b/c/y.py")), N.shared_depth(F.lit("x"), F.lit("y")), N.shared_depth(F.lit("a/x"), F.lit("b/y")),
        N.package_root(F.lit("a.py"), F.lit("os.path")), N.package_root(F.lit("a.ts"), F.lit("@s/p/q?x")), N.package_root(F.lit("a.rs"), F.lit("serde::Serialize")), N.package_root(F.lit("a.ts"), F.lit("../x")),
        N.clean_route(F.lit("/:id/{x}?q")), N.clean_route(F.lit("/users/:id#top")), N.remote_name(F.lit("git@github.com:o/r.git")), N.remote_name(F.lit("https://github.com/o/..")), N.is_calendar_day(F.lit("2023-02-29")), N.is_calendar_day(F.lit("2024-02-29")),
    )
    assert tuple(r) == (True, "requirements", 2, 1, 0, "os", "@s/p", "serde", None, None, "/users/:id", "o/r", None, False, True)


def test_texts_for_show(spark):
    r = one(spark, N.tool_text(F.lit("a\r\nb\x07‮\tc")), N.markdown_text(F.lit("a *b*\n c​"), 50), N.markdown_text(F.lit("abcdef"), 4), N.control_characters(F.lit("x\x07‎\x07")), N.canonical_json(F.lit('{"b": [1, {"d": 2, "c": null}], "a": "x"}')), N.first_and_more(F.array(F.lit("p"), F.lit("q"), F.lit("r")), 2))
    assert tuple(r) == ("a\nb��\tc", "a \\*b\\* c", "abc…", ["U+0007", "U+200E"], '{"a":"x","b":[1,{"c":null,"d":2}]}', ["p", "q", "and 1 more problems"])
    r = one(spark, N.clean_aliases(F.lit("Title"), F.array(*map(F.lit, (" a ", "A", "title", "", "b")))), N.is_run_of(F.array(F.lit("b"), F.lit("c")), F.split(F.lit("a b c"), " ")), N.is_run_of(F.array(F.lit("a"), F.lit("c")), F.split(F.lit("a b c"), " ")), N.plurals(F.lit("city")), N.rotation(F.lit("0000000ff"), F.lit(10)), N.rotation(F.lit("f"), F.lit(0)))
    assert tuple(r) == (["a", "b"], True, False, ["citys", "cityes", "cities"], 5, 0)


def test_sweeps_and_lock_files_add_no_lines(spark):
    commits = spark.createDataFrame([("a", "p", False, "2024-01-01"), ("b", "p", False, "2024-01-01"), ("m", "p", True, "2024-01-02"), ("c", "q", False, None), ("d", None, False, "2024-01-03")], "sha string, person string, merge boolean, day string")
    files = spark.createDataFrame([("a", "x", 3, 1), ("a", "go.sum", 900, 900), ("a", "bin", None, None), *[("b", f"f{i}", 1, 1) for i in range(6)]], "sha string, path string, added int, deleted int")
    sums = people.commit_sums(commits, files, sweep=5)
    assert {r["sha"]: (r["added"], r["deleted"]) for r in sums.collect()} == {"a": (3, 1), "b": (0, 0), "c": (0, 0), "d": (0, 0)}
    out = spark.createDataFrame([("q",)], "person string")
    assert [tuple(r) for r in people.activity(sums, out).collect()] == [("p", "2024-01-01", 2, 3, 1)]
    helped = spark.createDataFrame([("a", "p"), ("a", "q"), ("a", "q"), ("b", "z")], "sha string, person string")
    assert {tuple(r) for r in people.totals(sums, helped).collect()} == {("p", 2, 3, 1, 0), ("q", 1, 0, 0, 1), ("z", 0, 0, 0, 1)}


def test_names_are_picked_by_tier(spark):
    rows = [(1, "al", False, 9, 1), (1, "Al Ba", False, 2, 5), (1, "Al Ca", False, 2, 3), (2, "", True, 9, 1), (2, "bo", True, 1, 2), (2, "Bo Da", False, 8, 1), (3, "cy", False, 1, 1)]
    d = spark.createDataFrame(rows, "person int, name string, proper boolean, commits int, first int")
    assert {tuple(r) for r in people.display_names(d).collect()} == {(1, "Al Ca"), (2, "bo"), (3, "cy")}


def test_membership_follows_a_pull_request(spark):
    m = spark.createDataFrame([("a", "F", 1.0), ("a#s", "F", 0.5), ("b", "G", 1.0), ("c", "G", 1.0)], "member string, feature string, weight double")
    ch = spark.createDataFrame([("renamed", "a", "a2"), ("deleted", "b", None), ("modified", "c", "c")], "status string, old_path string, new_path string")
    new = spark.createDataFrame([("n", "G", 0.05), ("c", "H", 0.1)], "path string, feature string, weight double")
    assert {tuple(r) for r in impact.membership_after(m, ch, new).collect()} == {("a2", "F", 1.0), ("a2#s", "F", 0.5), ("c", "H", 0.1), ("n", "G", 0.05)}


def test_first_parents_and_merge_bases(spark):
    p = spark.createDataFrame([(k, k - 1) for k in range(2, 40)], "sha int, first_parent int")
    assert sorted((r["place"], r["sha"]) for r in impact.first_parent_path(p, 39).collect()) == [(i, 39 - i) for i in range(39)]
    assert sorted(r["sha"] for r in impact.first_parent_path(p, 39, 30).collect()) == list(range(31, 40))
    e = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "b"), ("y", "b"), ("b", "r"), ("a", "r")], "node string, parent string")
    assert {r["node"] for r in impact.merge_bases(e, "x", "y").collect()} == {"a", "b"}
    assert {r["node"] for r in impact.merge_bases(e, "x", "a").collect()} == {"a"}


def test_the_oldest_row_of_a_key_that_all_ask_for(spark):
    # 10^10 pairs share the key
    asked = spark.range(100_000).select(F.col("id").alias("query_id"), F.array(F.lit("k"), F.col("id").cast("string")).alias("keys"))
    rows = spark.range(100_000).select("id", (F.col("id") % 9 + 1).alias("at"), F.array(F.lit("k")).alias("keys"))
    late = spark.createDataFrame([(100_001, 0, ["5"]), (100_000, 0, ["5", "6"])], "id long, at long, keys array<string>")
    got = impact.oldest_match(asked, rows.union(late)).groupBy("id").count().collect()
    assert {tuple(r) for r in got} == {(0, 99_998), (100_000, 2)}


def test_first_parents_never_pass_the_driver(spark):
    p = spark.range(2, 3000).select(F.col("id").alias("sha"), (F.col("id") - 1).alias("first_parent"))
    plans = []
    from veinstone.operators import lineage

    real = lineage.written
    lineage.written = lambda df: plans.append(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")) or real(df)
    try:
        assert impact.first_parent_path(p, 2999).count() == 2999
    finally:
        lineage.written = real
    assert plans and not any("BroadcastHashJoin" in x for x in plans)


def test_ranges_of_very_different_lengths_meet(spark):
    from veinstone.operators import ranges

    x = spark.createDataFrame([(1, 1, 0, 10**9), (1, 2, 5, 5), (1, 3, 10**6, 10**6 + 300)], "k int, i int, start int, stop int")
    y = spark.createDataFrame([(1, 1, 7, 7), (1, 2, 0, 2 * 10**9), (1, 3, 10**6 + 299, 10**6 + 400), (1, 4, 10**9 + 1, 10**9 + 5)], "k int, j int, r_start int, r_stop int")
    got = sorted((r["i"], r["j"]) for r in ranges.overlaps(x, y, ["k"]).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 2), (3, 2), (3, 3)]


def test_manifests_and_technologies(spark):
    from veinstone.sources import manifests

    rows = [
        ("package.json", '{"dependencies": {"react": "1", "@scope/x": "2"}, "devDependencies": {"Vite": "3"}}'), ("sub/package.json", '{"dependencies": {"react": "1"}}'), ("bad/package.json", "{"),
        ("requirements-dev.txt", "# tools\nDjango>=4\n-r other.txt\n  numpy == 1\n"), ("pyproject.toml", '[project]\ndependencies = [\n  "requests>=2",\n  "click"\n]\n[tool.poetry.dependencies]\npython = "3"\nrich = "1"\n[tool.x]\ny = 1\n'),
        ("Cargo.toml", '[package]\nname = "z"\n[dependencies]\nserde = "1"\n[dev-dependencies]\ntokio = "1"\n'), ("go.mod", "module x.org/y\nrequire (\n\tgithub.com/a/b v1.2.3\n)\nrequire golang.org/x/net v0.1.0\n"),
        ("docker-compose.yml", "services:\n  db:\n    image: postgres:16\n  web:\n    image: 'reg.io:5000/app@sha256:aa'\n"), ("notes.txt", "Django"), ("x/go.mod", None),
    ]
    d = manifests.declared(spark.createDataFrame(rows, "path string, text string"))
    got = {(r["path"], r["ecosystem"], r["name"]) for r in d.collect()}
    assert got == {
        ("package.json", "npm", "react"), ("package.json", "npm", "@scope/x"), ("package.json", "npm", "vite"), ("sub/package.json", "npm", "react"), ("requirements-dev.txt", "pypi", "django"), ("requirements-dev.txt", "pypi", "numpy"),
        ("pyproject.toml", "pypi", "requests"), ("pyproject.toml", "pypi", "click"), ("pyproject.toml", "pypi", "rich"), ("Cargo.toml", "cargo", "serde"), ("Cargo.toml", "cargo", "tokio"), ("go.mod", "go", "github.com/a/b"),
        ("go.mod", "go", "golang.org/x/net"), ("docker-compose.yml", "image", "postgres"), ("docker-compose.yml", "image", "reg.io:5000/app"),
    }
    t = spark.createDataFrame([("React", "npm", "react", True), ("Scope", "npm", "@scope", True), ("Django", "pypi", "django", False), ("Flask", "pypi", "flask", False), ("Nothing", "npm", "reac", True)], "technology string, ecosystem string, name string, prefix boolean")
    imports = spark.createDataFrame([("a.ts", "react-dom/client"), ("b.ts", "react"), ("c.py", "flask.views"), ("d.ts", "./x")], "path string, specifier string")
    assert {tuple(r) for r in manifests.detected(d, imports, t).collect()} == {("React", "package.json", 2), ("Scope", "package.json", 0), ("Django", "requirements-dev.txt", 0), ("Flask", None, 1)}


def test_sentences_and_names_with_odd_characters(spark):
    d = spark.createDataFrame([("one\x02two. e.g.  this\x01 stays! Next? 3 more.",)], "t string")
    assert d.select(N.sentences(F.col("t"))).first()[0] == ["one\x02two.", "e.g. this\x01 stays!", "Next?", "3 more."]
    rows = [("a \\E b", "\\E", True), ("x.y z", "x.y", True), ("xzy", "x.y", False), ("f(a)[0]^$ q", "f(a)[0]^$", True), ("call ab_c now", "ab", False), ("é ü", "é", True)]
    got = spark.createDataFrame([r[:2] for r in rows], "g string, t string").select(N.writes_name(F.col("g"), F.col("t"))).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]
