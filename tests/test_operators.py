"""Operators on small inputs against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from veinstone.functions import text as T
from veinstone.functions.cost import cap, micros, usd
from veinstone.functions.numbers import rounded
from veinstone.operators import caching, cochange, deltas, graph, identity, integrity, membership, ranges, search, spreading, stateful, topk


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, None), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ancestors_with_diamonds_and_a_cycle(spark):
    e = spark.createDataFrame([(4, 2), (4, 3), (2, 1), (3, 1), (9, 8), (8, 9)], "node long, parent long")
    got = {tuple(r) for r in graph.ancestors(e).collect()}
    assert got == {(4, 2), (4, 3), (4, 1), (2, 1), (3, 1), (9, 8), (8, 9), (9, 9), (8, 8)}


def test_redirects(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "id string, target string")
    got = {r["id"]: (r["target"], r["state"]) for r in graph.final_targets(p).collect()}
    assert got["a"] == ("c", "done") and got["b"] == ("c", "done") and got["x"][1] == "cycle"


def test_file_graph_by_folders_is_the_whole_graph(spark):
    """Files in one and in several folders, in one feature and in two, against all pairs of them."""
    rng = random.Random(3)
    names = [f"f{i:02}" for i in range(40)]
    files = spark.createDataFrame([(f, d) for f in names for d in rng.sample("ABCD", rng.choice([1, 1, 1, 2]))] + [("x", None)], "path string, dir string")
    imports = spark.createDataFrame([(rng.choice(names), rng.choice([*names, "x", "gone"])) for _ in range(60)], "src string, dst string")
    changes = spark.createDataFrame([(g, rng.choice(names)) for g in range(50) for _ in range(4)], "grp int, item string")
    member = spark.createDataFrame([(f, rng.choice("PQR"), rng.choice(["core", "other"])) for f in names if f != "f07"], "path string, feature string, role string")
    told = {}
    for dirs in files.where("dir is not null").toPandas().groupby("dir")["path"].apply(list):
        for a in dirs:
            for b in dirs:
                if a < b:
                    told[a, b] = told.get((a, b), 0.0) + 0.3 / (len(dirs) - 1)
    for r in graph.signals(files, imports, changes).collect():
        told[r.a, r.b] = told.get((r.a, r.b), 0.0) + r.w
    got = graph.file_graph(files, imports, changes).collect()
    assert len(got) == len(told) and all(abs(r.weight - told[r.a, r.b]) < 1e-9 for r in got)
    whole = graph.file_graph(files, imports, changes).withColumn("weight", rounded(F.col("weight"), 6))
    small = graph.compact_file_graph(files, imports, changes)
    assert {tuple(r) for r in graph.top_files(small, 5).collect()} == {tuple(r) for r in graph.top_neighbours(whole, 5).select("node", "neighbour", "weight", "rank").collect()}
    assert {tuple(r) for r in membership.centrality_of_files(small, member).collect()} == {tuple(r) for r in membership.centrality(whole, member).collect()}
    both = member.union(spark.createDataFrame([("f01", "P", "core"), ("f02", "Q", "core")], member.schema)).distinct()
    one = {(r.src, r.dst): r.weight for r in graph.rolled_up_files(graph.signals(files, imports, changes), graph.folders_of(files), both).collect()}
    two = {(r.src, r.dst): r.weight for r in graph.rolled_up(graph.file_graph(files, imports, changes), both).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in two)


def test_a_large_folder_needs_no_pairs(spark):
    # 5 * 10^9 pairs of one folder
    files = spark.range(100_000).select(F.format_string("p%06d", "id").alias("path"), F.lit("d").alias("dir"))
    none = spark.createDataFrame([], "src string, dst string")
    small = graph.compact_file_graph(files, none, none.toDF("grp", "item"))
    top = graph.top_files(small, 2)
    assert top.count() == 200_000 and {r.neighbour for r in top.select("neighbour").distinct().collect()} == {"p000000", "p000001", "p000002"}


def test_pairs_of_a_folder_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 50, raising=False)
    monkeypatch.setattr(spreading, "TASK_ROWS", 50)
    files = spark.createDataFrame([(f"p{i:02d}", "d") for i in range(60)] + [("q1", "e"), ("q2", "e"), ("r", None)], "path string, dir string")
    imports = spark.createDataFrame([("p03", "p01"), ("r", "p02")], "src string, dst string")
    out = graph.file_graph(files, imports, spark.createDataFrame([], "grp string, item string"))
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert len({(r.a, r.b) for r in got}) == len(got) == 60 * 59 // 2 + 2 and all(r.a < r.b for r in got)
    assert {(r.a, r.b) for r in got if r.weight >= 1} == {("p01", "p03"), ("p02", "r")}
    assert max(Counter(r.task for r in got).values()) < 400  # before, all 1,770 in one


def test_closure_by_shortest_paths(spark, monkeypatch):
    """Loops, forks and a long chain; pairs already known are not joined with one another again."""
    rng = random.Random(2)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)} | {(100 + i, 101 + i) for i in range(70)}
    rows = []
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda df: (lambda out: rows.append(out.count()) or out)(real(df)))
    got = {tuple(r) for r in graph.ancestors(spark.createDataFrame(list(edges), "node int, parent int")).collect()}
    want, more = set(edges), set(edges)
    while more:
        more = {(a, d) for a, b in more for c, d in edges if b == c} - want
        want |= more
    assert got == want
    # a chain's pairs are found once each: n ahead, then all that is known from there
    rows.clear()
    assert graph.ancestors(spark.createDataFrame([(i, i + 1) for i in range(64)], "node int, parent int")).count() == 64 * 65 // 2
    assert max(rows) <= 64 * 65 // 2


def test_louvain_two_triangles(spark):
    e = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 0.1)]
    frame = spark.createDataFrame(e, "a string, b string, weight double")
    out = graph.louvain(frame)
    got = {r["node"]: r["community"] for r in out.collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}
    assert graph.modularity(frame, out).first()[0] > 0.4


def test_louvain_ring_of_cliques(spark):
    e = [(f"{i:02d}{a}", f"{i:02d}{b}", 1.0) for i in range(6) for a in "abcde" for b in "abcde" if a < b] + [(f"{i:02d}a", f"{(i + 1) % 6:02d}b", 1.0) for i in range(6)]
    got = graph.louvain(spark.createDataFrame(e, "a string, b string, weight double")).groupBy("community").count().collect()
    assert sorted(r["count"] for r in got) == [5] * 6


def test_louvain_of_hubs_is_that_of_blocks(spark, monkeypatch):
    """Planted groups, a loop and a repeated edge; nodes of many links are summed as rows, with the same result."""
    rng = random.Random(5)
    e = [(i, j, float(rng.randint(1, 3))) for i in range(80) for j in range(i) if rng.random() < (0.5 if i % 4 == j % 4 else 0.03)]
    frame = spark.createDataFrame(e + [(3, 3, 2.0), (e[0][1], e[0][0], 1.0)], "a long, b long, weight double")
    got = {tuple(r) for r in graph.louvain(frame).collect()}
    assert got == {(i, i % 4) for i in range(80)}
    monkeypatch.setattr(graph.moving, "HUB", 14)
    assert {tuple(r) for r in graph.louvain(frame).collect()} == got


def test_small_clusters_are_absorbed(spark):
    big = [(f"a/b/f{i}", "A") for i in range(6)] + [(f"c/f{i}", "C") for i in range(7)]
    small = [("a/b/x", "x"), ("c/y", "y"), ("c/z", "z"), ("q", "q")]
    edges = [("c/y", "a/b/f0", 1.0), ("c/y", "c/z", 5.0)]
    c = spark.createDataFrame(big + small, "node string, community string")
    out = graph.absorbed(c, spark.createDataFrame(edges, "a string, b string, weight double"))
    got = {r["node"]: r["community"] for r in out.collect()}
    # y joins z first, both then the heaviest neighbour of the two; x goes by folder, q to the largest
    assert got["a/b/x"] == got["a/b/f0"] == "a/b/f0" and got["c/y"] == got["c/z"] == "a/b/f0" and got["q"] == got["c/f0"]
    assert {(r["id"], r["size"]) for r in graph.numbered(out).collect()} == {("c01", 9), ("c02", 8)}


def test_range_join_is_complete_and_without_repeats(spark):
    rng = random.Random(2)
    left = [(i % 3, i, s, s + rng.randrange(400)) for i in range(200) for s in [rng.randrange(3000)]]
    right = [(i % 3, -i, s, s + rng.randrange(900)) for i in range(80) for s in [rng.randrange(3000)]]
    x = spark.createDataFrame(left, "k int, i int, start int, stop int")
    y = spark.createDataFrame(right, "k int, j int, r_start int, r_stop int")
    got = sorted((r["i"], r["j"]) for r in ranges.overlaps(x, y, ["k"]).collect())
    assert got == sorted((i, j) for k, i, a, b in left for q, j, c, d in right if k == q and a <= d and c <= b)
    inside = sorted((r["i"], r["j"]) for r in ranges.overlaps(x, y, ["k"], contains=True).collect())
    assert inside == sorted((i, j) for k, i, a, b in left for q, j, c, d in right if k == q and c <= a and b <= d)


def test_remap_follows_an_edited_file(spark):
    rng = random.Random(3)
    cases = []
    for n in range(150):
        old = [f"l{i}" for i in range(30)]
        new, hunks, at, shift = [], [], 0, 0
        for _ in range(rng.randrange(4)):
            a = rng.randrange(at, min(at + 9, 30))
            cut, add = rng.randrange(3), rng.randrange(3)
            if cut + add == 0 or a + cut > 29:
                continue
            new += old[at:a] + [f"new{n}{a}{i}" for i in range(add)]
            hunks.append((a + 1 if cut else a, cut, 0, add))
            at, shift = a + cut + 1, shift + add - cut
            new += old[a + cut : at]
        new += old[at:]
        s = rng.randrange(1, 28)
        e = rng.randrange(s, 29)
        want = None
        for i in range(len(new) - (e - s)):
            if new[i : i + e - s + 1] == old[s - 1 : e]:
                want = (i + 1, i + 1 + e - s)
        cases.append((n, s, e, hunks, want))
    frame = spark.createDataFrame([c[:4] for c in cases], "n int, s long, e long, h array<struct<old_start:long,old_count:long,new_start:long,new_count:long>>")
    got = {r["n"]: tuple(r["r"]) if r["r"] else None for r in frame.select("n", ranges.remapped(F.col("s"), F.col("e"), F.col("h")).alias("r")).collect()}
    assert got == {c[0]: c[4] for c in cases}


def test_churn(spark):
    before = spark.createDataFrame([("p", "A", 1.0), ("q", "A", 0.5), ("r", "B", 1.0)], "path string, feature string, weight double")
    after = spark.createDataFrame([("p", "A", 0.75), ("q", "B", 0.5), ("s", "C", 0.25)], "path string, feature string, weight double")
    got = {r["feature"]: (r["moved"], r["churn"]) for r in membership.churn(before, after).collect()}
    assert got == {"A": (0.75, 0.5), "B": (1.5, 1.5), "C": (0.25, float("inf"))}


def test_identities_join(spark):
    p = spark.createDataFrame(
        [("Ann Lee", "a@x.org"), ("Ann  Lee", "b@x.org"), ("annl", "c@x.org"), ("N", "12+annl@users.noreply.github.com"), ("N", "b@x.org"), ("Bo", "noreply@github.com"), ("Cy", "noreply@github.com"), ("dep[bot]", "d@x.org")],
        "name string, email string",
    )
    out = identity.resolved(p).collect()
    who = {(r["name"], r["email"]): r["person"] for r in out}
    assert who["Ann Lee", "a@x.org"] == who["Ann  Lee", "b@x.org"] == who["N", "b@x.org"]
    assert who["annl", "c@x.org"] == who["N", "12+annl@users.noreply.github.com"]
    assert len(set(who.values())) == 5
    assert [r["name"] for r in out if r["bot"]] == ["dep[bot]"]


def test_text_functions(spark):
    d = spark.createDataFrame([("a#b%c", "S", "Merge pull request #12 from x", "see [[one]] `[[no]]` [[two|2]]", "HTTPServer bodies glass cats a", "x\r\ny\n")], "p string, s string, c string, l string, t string, h string")
    r = d.select(T.member_id(F.col("p"), F.col("s")), T.member_path(T.member_id(F.col("p"), F.col("s"))), T.pr_number(F.col("c")), T.link_targets(F.col("l")), T.terms(F.col("t")), T.content_hash(F.col("h")) == F.sha2(F.lit("x\ny"), 256), T.slug(T.without_accents(F.lit("Été à Paris!")))).first()
    assert tuple(r) == ("a%23b%25c#S", "a#b%c", 12, ["one", "two"], ["httpserver", "body", "glass", "cat"], True, "ete-a-paris")


def test_hunks(spark):
    d = spark.createDataFrame([("@@ -1,2 +1 @@\n-a\n@@ -9 +8,3 @@ f()",)], "d string")
    assert [tuple(h) for h in d.select(T.hunks_of(F.col("d")).alias("h")).first()["h"]] == [(1, 2, 1, 1), (9, 1, 8, 3)]


def test_prices(spark):
    d = spark.createDataFrame([("model-1-20250101", 1_000_000, 0, False), ("model-2", 200_000, 0, True), ("else", 5, 5, False)], "m string, i long, o long, b boolean")
    z = F.lit(0)
    got = [r[0] for r in d.select(micros(usd(F.col("m"), F.col("i"), F.col("o"), z, z, F.col("b")))).collect()]
    assert got == [1_000_000, 50_000, None]
    assert spark.range(1).select(cap(F.lit(11), F.lit(100)), cap(F.lit(80), F.lit(100)), cap(F.lit(1), F.lit(0))).first()[:] == (17, 100, None)
    assert spark.range(1).select(rounded(F.lit(1.005), 2)).first()[0] == 1.0


def test_placement_and_budget(spark):
    v = spark.createDataFrame([("n", "imp", "A", 2), ("n", "imp", "B", 2), ("n", "dir", "A", 1), ("m", "imp", "B", 3), ("m", "dir", "B", 1)], "path string, signal string, feature string, votes int")
    assert {tuple(r) for r in membership.placed(v).collect()} == {("n", "disputed", "A,B"), ("m", "decided", "B")}
    d = spark.createDataFrame([("k", 1, 5), ("k", 2, 9), ("k", 3, 1)], "k string, o int, c int")
    assert [r["o"] for r in topk.within_budget(d, ["k"], [F.col("o")], "c", 10).collect()] == [1]


def test_job_fold(spark):
    steps = ["signup", "view", "error", "view", "error", "view", "error", "view"]
    d = spark.createDataFrame([(1, s, i, i) for i, s in enumerate(steps)], "user_id long, event_type string, ts long, event_id long")
    assert tuple(stateful.job_states(d).first()) == (1, "failed", 3, 7, 1)


def test_graph_problems_join_a_row_a_node(spark):
    edges = spark.range(20_000).select((F.col("id") % 5).alias("a"), F.when(F.col("id") % 4 > 0, F.col("id") % 7).alias("b"), F.when(F.col("id") % 10 > 0, 1.0).alias("weight"))
    out = caching.graph_problems(spark.createDataFrame([(i,) for i in (0, 1, 2, 2)], "node long"), edges)
    got = {(r["problem"], r["item"]): r["n"] for r in out.collect()}
    assert got["unknown end", None] == 5000 and got["unknown end", "3"] == 4000 + sum(i % 4 > 0 and i % 7 == 3 for i in range(20_000)) and got["node twice", "2"] == 2
    assert sum(n for (p, _), n in got.items() if p == "bad weight") == 2000
    # no anti join reads the edges themselves
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "explode" not in plan


def test_updated_pairs_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(spreading, "TASK_ROWS", 40)
    old = spark.createDataFrame([(g, i) for g in range(60) for i in range(g % 5, g % 5 + 6)], "grp long, item long")
    signed = spark.createDataFrame([(g, i, s) for g in range(0, 60, 3) for i, s in ((g % 5, -1), (90 + g, 1), (91 + g, 1))], "grp long, item long, sign int")
    out = deltas.updated_pairs(cochange.cochange_pairs(old, 50), old, signed, 50)
    want = cochange.cochange_pairs(deltas.after(old, signed), 50)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [a" in plan


def test_groups_are_dealt_by_rows_and_large_ones_apart(spark, monkeypatch):
    rows = spark.createDataFrame([(g, i) for g in range(40) for i in range(60 if g == 7 else 20 if g == 8 else 3)] + [(None, 1), (1, None)], "grp int, item int")
    monkeypatch.setattr(spreading, "TASK_ROWS", 20)
    want = {(g, tuple(range(20 if g == 8 else 3))) for g in range(40) if g != 7}
    got = cochange.grouped_items(rows, 50)
    assert got.rdd.getNumPartitions() >= rows.count() // 20 - 1
    assert {(r.grp, tuple(r["items"])) for r in got.collect()} == want
    monkeypatch.setattr(cochange, "LARGE", 10)
    assert {(r.grp, tuple(r["items"])) for r in cochange.grouped_items(rows, 50).collect()} == want


def test_containment_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(spreading, "TASK_ROWS", 20)
    sets = {(w, k): {i for i in range(6) if (k * 7 + w) >> i & 1} for w in range(3) for k in range(25)}
    rows = [(w, k, i) for (w, k), s in sets.items() for i in s] * 2 + [(None, 1, 1), (1, None, 1), (1, 99, None)]
    out = integrity.contained(spark.createDataFrame(rows, "w int, k int, i int"), "w", "k", "i")
    want = {(w, k, j) for (w, k), s in sets.items() for (v, j), t in sets.items() if v == w and j != k and t and t <= s}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "RepartitionByExpression [w" in out._jdf.queryExecution().optimizedPlan().toString()


def test_search_is_dealt_by_terms_and_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"word{c}" for c in "abcdefgh"[: i % 8 + 1])) for i in range(40)], "id int, body string")
    asked = spark.createDataFrame([(q, f"worda word{'abcdefgh'[q]}") for q in range(8)], "query_id int, query string")
    idx = search.index(docs, ["body"])
    found = lambda: search.search(idx, asked, {"body": 1}, limit=5)
    want = sorted(map(tuple, found().collect()))
    monkeypatch.setattr(spreading, "TASK_ROWS", 10)
    out = found()
    assert len(want) == 40 and sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # more tasks than the session's four: there are at most 320 pairs of a document and a query
    assert any(int(x) > 4 for x in re.findall(r"RepartitionByExpression \[id#[^]]*\], (\d+)", plan))
