"""Histories, merges, registries, scripts and paragraphs against plain sequential versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from veinstone.functions.diffs import MAX_CELLS, changed_rows, diff, word_diff
from veinstone.operators import evolution, history, merging, registry, scans


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


def test_diff_keeps_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = (rng.choices("abcd", k=rng.randrange(12)) for _ in range(2))
        d = diff(a, b)
        assert [v for op, v in d if op != "+"] == a and [v for op, v in d if op != "-"] == b
        assert sum(op == "=" for op, _ in d) == longest(a, b)
        assert not any(d[i][0] == "+" and d[i + 1][0] == "-" for i in range(len(d) - 1))
    assert diff(list("abc"), list("axcd")) == [("=", "a"), ("-", "b"), ("+", "x"), ("=", "c"), ("+", "d")]


def test_diff_beyond_the_fixed_size_keeps_nothing():
    many = [str(i) for i in range(999)]
    assert (len(many) + 1) ** 2 == MAX_CELLS and all(op == "=" for op, _ in diff(many, many))
    d = diff([*many, "x"], [*many, "x"])
    assert len(d) == 2000 and [op for op, _ in d] == ["-"] * 1000 + ["+"] * 1000


def test_changed_rows(spark):
    rows = [(["a", "b", "c"], ["a", "x", "c", "d"]), ([], ["q"]), (["a", "b", "c"], ["x"]), (None, None), (["a"], ["a"])]
    df = spark.createDataFrame(rows, "x array<string>, y array<string>")
    got = [[tuple(z) for z in r[0]] for r in df.select(changed_rows("x", "y")).collect()]
    assert got[0] == [("context", "a", "a"), ("changed", "b", "x"), ("context", "c", "c"), ("added", None, "d")]
    assert got[1:] == [[("added", None, "q")], [("changed", "a", "x"), ("removed", "b", None), ("removed", "c", None)], [], [("context", "a", "a")]]
    assert [tuple(x) for x in df.limit(1).select(word_diff(F.lit("a  b c"), F.lit("a  x y c"))).first()[0]] == [("=", "a  "), ("-", "b"), ("+", "x"), ("=", " "), ("+", "y "), ("=", "c")]


def walked(commits, head):
    """The walk itself: first parents before others, each commit claimed once."""
    by, out = {c[0]: c for c in commits}, {}
    todo = [(head, None)]
    while todo:
        at, number = todo.pop()
        if at not in by or at in out:
            continue
        _, parents, own, merges = by[at]
        out[at] = own if own is not None else number
        todo += [(p, own if merges and own is not None else number) for p in parents[1:]]
        if parents:
            todo.append((parents[0], number))
    return out


def test_brought_in_same_as_the_walk(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = rng.randrange(20, 60)
        commits = []
        for i in range(n):
            # two parents at most: of three, the walk's order among the last ones isn't told by the graph
            parents = sorted(rng.sample(range(max(0, i - 6), i), min(i, rng.choice([1, 1, 1, 2]))), reverse=rng.random() < 0.5) if i else []
            commits.append((i, parents, i * 10 if rng.random() < 0.4 else None, rng.random() < 0.7))
        df = spark.createDataFrame(commits + commits[:3], "node long, parents array<long>, own long, merges boolean")
        got = {r.node: r.number for r in history.brought_in(df, spark.createDataFrame([(n - 1,)], "node long")).collect()}
        assert got == walked(commits, n - 1)
    odd = spark.createDataFrame([(1, [9, None], None, None), (None, [1], 5, True), (2, None, 7, True)], "node long, parents array<long>, own long, merges boolean")
    heads = spark.createDataFrame([(1,), (2,), (5,)], "node long")
    assert sorted(tuple(r) for r in history.brought_in(odd, heads).collect()) == [(1, None), (2, 7)]
    loop = spark.createDataFrame([(1, [2], None, False), (2, [1], None, False)], "node long, parents array<long>, own long, merges boolean")
    with pytest.raises(ValueError):
        history.brought_in(loop, heads)


def edited(base, edits):
    out, at = [], 0
    for start, count, lines in sorted(edits, key=lambda e: (e[0], e[1])):
        first = start if count == 0 else start - 1
        out += base[at:first] + lines
        at = first + count
    return out + base[at:]


def random_edits(rng, n):
    out, at = [], 0
    while True:
        first = at + rng.randrange(1, 6)
        count = rng.randrange(0, 3)
        if first + count > n:
            return out
        lines = [f"n{rng.randrange(3)}" for _ in range(rng.randrange(0 if count else 1, 3))]
        out.append((first if count == 0 else first + 1, count, lines))
        at = first + count


def test_merges_of_random_edits(spark):
    rng = random.Random(5)
    ours, theirs, want = [], [], {}
    for f in range(120):
        base = [f"b{f}.{i}" for i in range(rng.randrange(3, 25))]
        a, b = random_edits(rng, len(base)), random_edits(rng, len(base))
        if f % 3 == 0:
            b = [e for e in b if rng.random() < 0.3]
        both = [e for e in a if rng.random() < 0.3]
        span = lambda e: (e[0], e[0]) if e[1] == 0 else (e[0] - 1, e[0] - 1 + e[1])
        touch = lambda e, g: span(e)[0] <= span(g)[1] and span(g)[0] <= span(e)[1]
        b = [e for e in b if not any(touch(e, g) for g in both)] + both
        ours += [(f, *e) for e in a]
        theirs += [(f, *e) for e in b]
        bad = any(touch(e, g) and e != g for e in a for g in b)
        every = a + [e for e in b if e not in a]
        if every:
            want[f] = (bad, base, every)
    schema = "path long, old_start long, old_count long, lines array<string>"
    edits = merging.merged_edits(spark.createDataFrame(ours, schema), spark.createDataFrame(theirs, schema), ["path"])
    states = {r.path: r.state for r in merging.merge_states(edits, ["path"]).collect()}
    assert {f: s == "conflicts" for f, s in states.items()} == {f: w[0] for f, w in want.items()} and len(set(states.values())) >= 3
    placed: dict = {}
    for r in merging.placed_edits(edits, ["path"]).collect():
        placed.setdefault(r.path, []).append(r)
    for f, (bad, base, every) in want.items():
        assert (f in placed) != bad
        if not bad:
            merged = edited(base, every)
            for r in placed[f]:
                first = r.new_start - (1 if r.new_count else 0)
                assert r.new_count == len(r.lines) and merged[first : first + r.new_count] == r.lines


def test_effects_of_insertions_and_edits(spark):
    edits = spark.createDataFrame([(1, "f", 5, 0, ["x"], "theirs", False), (1, "g", 2, 2, [], "both", False), (2, "f", 1, 1, [], "theirs", True), (1, "f", 9, 1, [], "ours", False)], "pull int, path string, old_start long, old_count long, lines array<string>, side string, conflict boolean")
    pulls = spark.createDataFrame([(1, "clean"), (2, "conflicts")], "pull int, merge string")
    cites = spark.createDataFrame([("between", "f", 5, 6), ("behind", "f", 6, 9), ("before", "f", 1, 5), ("on", "g", 3, 3), ("off", "g", 4, 5)], "claim string, path string, r_start long, r_stop long")
    got = {tuple(r) for r in merging.merge_effects(pulls, edits, cites).collect()}
    assert got == {(1, "between", True), (1, "on", True), (2, "between", False), (2, "behind", False), (2, "before", False)}


def test_people_go_where_most_keys_are_shared(spark):
    """People and groups of few and of many keys against all pairs."""
    rng = random.Random(4)
    kind = {"e": "email", "l": "login", "n": "name"}
    some = lambda n: [rng.choice("eln") + str(rng.randrange(5)) for _ in range(n)]
    people = [(i, rng.randrange(9), some(rng.choice([0, 1, 3, 4, 12]))) for i in range(40)]
    keys = [(g, kind[k[0]], k, rng.random() < 0.2) for g in range(60) for k in some(rng.choice([1, 3, 4, 14]))]
    pairs = [(g, rng.choice("pq"), k, rng.randrange(4)) for g, _, k, _ in keys if rng.random() < 0.8]
    stored, group_keys = spark.createDataFrame(people, "id int, rank int, keys array<string>"), spark.createDataFrame(keys, "group int, kind string, key string, placeholder boolean")
    held = spark.createDataFrame(pairs, "group int, pair string, key string, commits int")
    got = {r.id: r.group for r in registry.assigned(stored, group_keys, held).collect()}
    want = {}
    for i, _, own in people:
        offers = []
        for g in range(60):
            shared = {(k, what) for x, what, k, fake in keys if x == g and not fake and k in own}
            if shared:
                names = {k for k, _ in shared}
                n = [sum(what == w for _, what in shared) for w in ("email", "login", "name")]
                offers.append(([-x for x in n], -sum(c for _, c in {(p, c) for x, p, k, c in pairs if x == g and k in names}), g))
        if offers:
            want[i] = min(offers)[2]
    assert got == want and len(want) > 20


def test_people_of_common_keys_are_not_compared_with_every_group(spark):
    # 6 * 10^9 pairs share the key
    stored = spark.range(60_000).select("id", F.lit(1).alias("rank"), F.array(F.lit("n")).alias("keys"))
    groups = spark.range(100_000).select(F.col("id").alias("group"), F.lit("name").alias("kind"), F.lit("n").alias("key"), F.lit(False).alias("placeholder"))
    pairs = groups.select("group", F.lit("p").alias("pair"), "key", (F.col("group") % 7).alias("commits"))
    assert [tuple(r) for r in registry.assigned(stored, groups, pairs).groupBy("group", "target").count().orderBy("count").collect()] == [(6, None, 1), (6, 0, 59_999)]


def test_assigned_people(spark):
    stored = spark.createDataFrame([("ann", 1, ["e:a", "n:x"]), ("bob", 2, ["e:b", "n:x"]), ("old", 3, ["e:a2"]), ("far", 4, ["e:none", None]), ("ph", 5, ["e:shared"])], "id string, rank int, keys array<string>")
    keys = spark.createDataFrame([(1, "email", "e:a", False), (1, "email", "e:a2", None), (1, "email", "e:shared", True), (2, "name", "n:x", False), (2, "email", "e:b", False), (3, "name", "n:new", False)], "group int, kind string, key string, placeholder boolean")
    pairs = spark.createDataFrame([(1, "p", "e:a", 2), (1, "q", "e:a2", 9), (2, "r", "n:x", 50), (2, "r", "e:b", 50)], "group int, pair string, key string, commits int")
    ids = registry.assigned(stored, keys, pairs)
    assert sorted(tuple(r) for r in ids.collect()) == [("ann", 1, False, "old"), ("bob", 2, True, None), ("old", 1, True, None)]
    assert [r.group for r in registry.unmatched(keys, ids).collect()] == [3]
    given = spark.createDataFrame([(1, "anna"), (2, "bob"), (3, None)], "group int, given_id string")
    assert [tuple(r) for r in registry.renamed(ids, given).collect()] == [("old", "anna")]


def replayed(membership, ops, uses, clusters):
    now = dict(membership)
    for seq, kind, feature, into in sorted(ops):
        if kind == "merge":
            now = {p: into if f == feature else f for p, f in now.items()}
        for s, c, target in uses:
            if s == seq:
                for cluster, p in clusters:
                    if cluster == c and (kind != "split" or now.get(p) == feature):
                        now[p] = target
    return now


def test_script_same_as_replay(spark):
    rng = random.Random(7)
    for _ in range(2):
        paths = range(60)
        membership = [(p, f"f{rng.randrange(8)}") for p in paths if p < 55]
        clusters = [(p % 12, p) for p in paths]
        alive, ops, uses, free = [f"f{i}" for i in range(8)], [], [], list(range(12))
        for seq in range(1, 16):
            kind = rng.choice(["merge", "move", "create", "split", "rename"])
            of = rng.choice(alive)
            into = None
            if kind == "merge" and len(alive) > 2:
                into = rng.choice([f for f in alive if f != of])
                alive.remove(of)
            elif kind == "split" and free and len(alive) > 2:
                alive.remove(of)
                for t in range(min(2, len(free))):
                    uses.append((seq, free.pop(), f"s{seq}.{t}"))
                    alive.append(f"s{seq}.{t}")
            elif kind in ("move", "create") and free:
                target = of if kind == "move" else f"c{seq}"
                uses.append((seq, free.pop(), target))
                if kind == "create":
                    of = target
                    alive.append(target)
            else:
                kind = "rename"
            ops.append((seq, kind, of, into))
        make = spark.createDataFrame
        script = evolution.Script(
            make(ops, "seq long, kind string, feature string, into string"), make(uses, "seq long, cluster long, target string"), make(clusters, "cluster long, path long"), make([(f"f{i}",) for i in range(8)], "feature string")
        )
        before = make(membership, "path long, feature string")
        after = {r.path: r.feature for r in evolution.evolved(before, script).collect()}
        assert after == replayed(membership, ops, uses, clusters)
        kept, found = evolution.applied(before, script)
        broken = {(r.feature, r.problem) for r in found.collect()}
        assert {p for _, p in broken} <= {"left", "empty"}
        assert {r.path: r.feature for r in kept.collect()} == (dict(membership) if broken else after)


def told(rows, chars, orphan):
    """rows: (length, files) in order; the group of each."""
    out, held, size, files, g = [], 0, 0, set(), 1
    for n, own in rows:
        if held >= 2 and (size >= chars or (own and files and not files & set(own))):
            g, held, size, files = g + 1, 0, 0, set()
        out.append(g)
        held, size, files = held + 1, size + n, files | set(own)
    if g > 1 and held == 1 and rows[-1][0] < orphan:
        out[-1] -= 1
    return out


@pytest.mark.parametrize("block", [4, 4096])
def test_paragraphs_same_as_one_pass(spark, block):
    rng = random.Random(block)
    rows, want = [], {}
    for s in range(25):
        claims = [(rng.choice([0, 10, 90, 300, 700]), rng.choice([[], ["a"], ["a", "b"], ["c"], None])) for _ in range(rng.choice([1, 2, 3, 8, 40]))]
        rows += [(s, i, n, f) for i, (n, f) in enumerate(claims)]
        want[s] = told([(n, f or []) for n, f in claims], 550, 200)
    df = spark.createDataFrame(rows, "s int, i int, n int, f array<string>")
    got: dict = {}
    for r in scans.paragraphs(df, ["s"], ["i"], F.col("n"), F.col("f"), block=block).orderBy("s", "i").collect():
        got.setdefault(r.s, []).append(r.group)
    assert got == want


def test_followed_over_many_blocks(spark):
    rng = random.Random(2)
    rows = [(k, i, i + rng.randrange(1, 5)) for k, n in ((1, 700), (2, 3), (3, 1)) for i in range(n)]
    jump = {(k, i): j for k, i, j in rows}
    want = set()
    for k in (1, 2, 3):
        at = 0
        while (k, at) in jump:
            want.add((k, at))
            at = jump[k, at]
    got = scans.followed(spark.createDataFrame(rows, "k int, pos long, next long"), ["k"], block=16)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert scans.followed(spark.createDataFrame([], "k int, pos long, next long"), ["k"]).count() == 0


def test_followed_within_one_block_takes_few_rounds(spark, monkeypatch):
    n, real = [], scans.written
    monkeypatch.setattr(scans, "written", lambda df: n.append(1) or real(df))
    rows = [(k, p, p + 1 + (p + k) % 3) for k in range(4) for p in range(20)]
    got = {(r["k"], r["pos"]) for r in scans.followed(spark.createDataFrame(rows, "k int, pos long, next long"), ["k"]).collect()}
    want = set()
    for k in range(4):
        p = 0
        while p < 20:
            want.add((k, p))
            p += 1 + (p + k) % 3
    assert got == want
    assert len(n) <= 9  # before: 15


def test_followed_with_long_and_short_keys(spark):
    rows = [(k, p, p + 1 + (p * 7 + k) % 5) for k, size in ((0, 200), (1, 9), (2, 1), (3, 64)) for p in range(size)]
    got = {(r["k"], r["pos"]) for r in scans.followed(spark.createDataFrame(rows, "k int, pos long, next long"), ["k"], block=16).collect()}
    want = set()
    for k, size in ((0, 200), (1, 9), (2, 1), (3, 64)):
        p = 0
        while p < size:
            want.add((k, p))
            p += 1 + (p * 7 + k) % 5
    assert got == want


def test_changed_rows_returns_places_alone():
    """Texts stay in Spark: Python returns one number a row, whatever the elements' length."""
    from veinstone.functions.diffs import _places

    pairs = lambda a, b: [(x >> 32, x >> 1 & (1 << 31) - 1, x & 1) for x in _places(a, b).tolist()]
    assert pairs(list("abcd"), list("axyzd")) == [(1, 1, 1), (2, 2, 0), (3, 3, 0), (0, 4, 0), (4, 5, 1)]
    assert pairs(list("ab"), []) == [(1, 0, 0), (2, 0, 0)] and pairs([], list("ab")) == [(0, 1, 0), (0, 2, 0)] and pairs([], []) == []
    assert pairs(list("abcx"), list("x")) == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 1)]
    assert _places(["x" * 100_000], ["y" * 100_000]).nbytes == 8


def test_claim_changes_compare_once(spark):
    from veinstone.plans.evolution import claim_changes

    out = claim_changes(spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
