"""Work that grows with the input, and no more than that; nothing left out by size."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veinstone.functions import diffs
from veinstone.operators import graph, moving
from veinstone.plans import graphs
from veinstone.plans.evolution import claim_changes


def test_a_block_meets_few_nodes_of_near_numbers(spark):
    """Each node links with the 20 on either side of it: blocks of scattered nodes would meet nearly all 2,000 each."""
    n = 2000
    links = spark.createDataFrame([(i, (i + k) % n, 1.0) for i in range(n) for k in range(-20, 21) if k], "node long, other long, w double").repartition(4)
    per = spark.createDataFrame([(i, 40.0, 40) for i in range(n)], "node long, degree double, n long")
    level = moving.pack(links, per)
    told = sum(len(r["ids"]) // 8 for r in level.needs.collect())
    blocks = level.blocks.collect()
    assert told < 7 * n  # before: 15 * n
    assert len(blocks) >= moving.LEAST_BLOCKS and sum(len(r["nodes"]) // 8 for r in blocks) == n


def test_groups_are_packed_as_their_pairs_are():
    places = moving.Places(0, 1, [0] * 20 + [1] * 20, [0] * 20 + [4] * 20, [4] * 40)
    rng = random.Random(3)
    for size in (40, 4):  # few and many repeated pairs
        groups = [sorted(rng.sample(range(size), 3)) for _ in range(30)]
        of = [(i, g) for g in groups for i in g]
        pairs = [(i, j, 1.0) for i, g in of for j in g if j != i]
        key = (pa.scalar(0),)
        one = moving._pack(key, pa.table({"node": pa.array([i for i, _ in of], pa.int64()), "items": pa.array([g for _, g in of], pa.list_(pa.int64()))}), places)
        two = moving._pack(key, pa.table(dict(zip(("node", "other", "w"), zip(*pairs)))), places)
        assert one.equals(two)
        w, counts = (np.frombuffer(one.column(c)[0].as_py(), t) for c, t in (("w", float), ("counts", np.int32)))
        assert (len(w) == 1) == (size == 40) and (counts.sum() if len(w) == 1 else w.sum()) == len(pairs)


def test_louvain_of_groups(spark):
    """Planted groups of near numbers, with groups across, of one item and repeated."""
    rng = random.Random(7)
    groups = [rng.sample(range(k * 10, k * 10 + 10), 4) for k in range(4) for _ in range(30)] + [rng.sample(range(40), 2) for _ in range(10)] + [[5], [39]]
    got = graph.louvain_of_groups(spark.createDataFrame([(g,) for g in groups + groups[:20]], "items array<long>"), max_turns=6, max_levels=3)
    assert {tuple(r) for r in got.collect()} == {(i, i // 10 * 10) for i in range(40)}


def by_table(old, new):
    """The rule of kept_pairs(), on a table of lengths."""
    length = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i in range(len(old) - 1, -1, -1):
        for j in range(len(new) - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if old[i] == new[j] else max(length[i + 1][j], length[i][j + 1])
    out, j = [], 0
    for i, x in enumerate(old):
        if j < len(new) and (new[j] == x or length[i][j] > length[i + 1][j]):
            j = new.index(x, j)
            out.append((i, j))
            j += 1
    return out


def test_comparisons_hold_few_rows_and_keep_the_same(monkeypatch):
    rng = random.Random(4)
    for held in (diffs.HELD, 40, 1):
        monkeypatch.setattr(diffs, "HELD", held)
        for _ in range(1500):
            old, new, end = (rng.choices("abcdefg"[: rng.randrange(1, 8)], k=rng.randrange(14)) for _ in range(3))
            assert diffs.kept_pairs(old + end, new + end) == by_table(old + end, new + end)
        old, new = ([rng.randrange(5) for _ in range(90)] for _ in range(2))
        assert diffs.kept_pairs(old, new) == by_table(old, new)


def test_claim_changes_compare_long_turns(spark, tmp_path):
    said = [f"Sentence {i}." for i in range(1200)]  # 1.4 million cells
    other = [*said[:600], "Another one.", *said[601:]]
    rows = [(1, k, "user", " ".join(x)) for k, x in enumerate((said, said, other))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = claim_changes(spark, str(tmp_path)).orderBy("turn", "place").collect()
    assert len(got) == 1200 and {r["turn"] for r in got} == {1}  # before: 1,200 changed rows for either turn
    assert [(r["place"], r["before"], r["after"]) for r in got if r["kind"] != "context"] == [(600, "Sentence 600.", "Another one.")]


def test_all_parts_of_a_brand_are_of_one_folder(spark):
    """Before, a folder was a brand, type and size: one pair of 200 parts shared one."""
    brand = {f"p{r['p_partkey']}": r["p_brand"] for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    got = {(r["a"], r["b"]) for r in graphs.file_graph_edges(spark, "/root/testdata/sf0.001").collect()}
    want = {(a, b) for a in brand for b in brand if a < b and brand[a] == brand[b]}
    assert len(want) == 752 and want <= got


def test_parts_of_a_large_folder_meet_once(spark, monkeypatch):
    """30 files in parts of some 3, pairs that other signals speak for left out of the folder's."""
    monkeypatch.setattr(graph, "TASK_ROWS", 9)
    files = spark.createDataFrame([(f"f{i:02d}", "d") for i in range(30)] + [("x", "e"), ("y", "e")], "path string, dir string")
    imports = spark.createDataFrame([("f01", "f09"), ("f20", "f05"), ("f20", "x")], "src string, dst string")
    g = graph.compact_file_graph(files, imports, spark.createDataFrame([], "grp long, item string"))
    got = sorted((r["a"], r["b"]) for r in graph._folder_pairs(g).collect())
    want = sorted((f"f{i:02d}", f"f{j:02d}") for i in range(30) for j in range(i + 1, 30) if (i, j) not in ((1, 9), (5, 20)))
    assert got == [*want, ("x", "y")]


def test_a_part_without_a_brand_is_in_no_folder(spark, tmp_path):
    for name in ("supplier", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(20).write.parquet(f"{tmp_path}/{name}.parquet")
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.withColumn("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))).write.parquet(f"{tmp_path}/part.parquet")
    got = graphs.file_graph_edges(spark, str(tmp_path)).where("a like 'p%' and b like 'p%'").collect()
    assert got and all(int(x[1:]) % 2 == 0 for r in got for x in (r["a"], r["b"]))
