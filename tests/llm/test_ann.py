"""Nearest neighbours by learned partitions against brute force."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone.llm import ann
from veinstone.llm import queries as Q

DATA = "/root/testdata/sf0.001"


def brute(rows, k, step):
    """rows: (vec_id, vector) of those that take part."""
    seen = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for q, v in seen:
        if q % step == 0 and q not in out:
            best: dict = {}
            for i, w in seen:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float((np.array(v) * np.array(w)).sum()))
            out[q] = sorted((-s, i) for i, s in best.items())[:k]
    return out


def found(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def vectors(n, dims, seed, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims)) * 2
    return (middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * 0.4).astype(np.float32)


def table(spark, rows):
    # extra columns by names that are used inside
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"h1": F.lit("x"), "part": F.lit(2), "ids": F.lit(None).cast("int")})


@pytest.mark.parametrize("small", [False, True])
def test_exact_when_all_parts_are_visited(spark, monkeypatch, small):
    if small:  # two levels of parts, each dealt to several tasks
        monkeypatch.setattr(ann, "PART_ROWS", 20)
        monkeypatch.setattr(ann, "MOST_PARTS", 5)
        monkeypatch.setattr(ann, "LEAST_PARTS", 2)
        monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
        monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
        monkeypatch.setattr(ann, "SAMPLE", 150)
    x = vectors(300, 8, 1)
    rows = [(i, x[i].tolist()) for i in range(300)]
    rows += [(1000 + i, x[7].tolist()) for i in range(60)]  # copies of one vector, queries among them
    rows += rows[:40]  # repeated rows
    good = list(rows)
    rows += [(2000, None), (2010, []), (2020, [0.0] * 8), (2030, [None] + [1.0] * 7), (2040, [float("nan")] * 8), (2050, [float("inf")] + [1.0] * 7), (2060, [1.0] * 7), (None, [1.0] * 8)]
    idx = ann.build(table(spark, rows), F.col("vec_id") % 10 == 0, k=5)
    if small:
        assert idx.tree.below and idx.tree.parts > idx.tree.root.parts
    idx.visits = idx.tree.parts
    got, want = found(ann.search(idx)), brute(good, 5, 10)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, _, s in got[q]], [-s for s, _ in best], rtol=0, atol=1e-12)
        assert [i for _, i, _ in got[q]] == [i for _, i in best]


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [1.0, 1.0]), (2, [0.5, 0.0])]
    got = found(ann.search(ann.build(table(spark, rows), F.col("vec_id") % 10 == 0, k=5)))
    assert got == {0: [(1, 1, 1.0), (2, 2, 0.5)]}


def test_few_and_no_rows(spark):
    for rows, want in (([], {}), ([(0, None)], {}), ([(0, [1.0, 2.0])], {}), ([(1, [1.0, 2.0])], {}), ([(0, [1.0, 2.0]), (7, [1.0, 0.0])], {0: [(1, 7, 1.0)]})):
        assert found(ann.search(ann.build(table(spark, rows), F.col("vec_id") % 10 == 0, k=5))) == want


def test_clustered_vectors_need_few_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 200)
    x = vectors(3000, 16, 4, centres=12)
    idx = ann.build(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0, k=20)
    assert idx.visits <= idx.tree.parts // 2
    got = found(ann.search(idx))
    s = x[::20].astype(np.float64) @ x.T.astype(np.float64)
    s[np.arange(len(s)), np.arange(0, 3000, 20)] = -np.inf
    top = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len({i for _, i, _ in got[q * 20]} & set(top[q].tolist())) / 20 for q in range(len(s))]) >= 0.9


def test_parts_are_balanced_and_follow_the_graph():
    x = vectors(640, 8, 2, centres=8)
    of, to = ann.neighbour_graph(x, 8)
    part = ann.balanced_parts(len(x), of, to, 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() - sizes.min() <= 3
    chance = 1 / 8
    assert (part[of] == part[to]).mean() > 5 * chance


def test_query_finds_nine_in_ten(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want, got = brute(rows, 20, 20), found(Q.op13_nearest(spark, DATA))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = [len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    x = dict(rows)
    for q, best in got.items():
        assert [(-s, i) for _, i, s in best] == sorted((-s, i) for _, i, s in best) and q not in {i for _, i, _ in best}
        assert all(abs(s - float(np.dot(np.array(x[q], float), np.array(x[i], float)))) < 1e-12 for _, i, s in best)


def test_nothing_is_trained_in_the_driver(spark, monkeypatch):
    here, real = os.getpid(), ann.trained_router

    def traced(*args, **more):
        assert os.getpid() != here
        return real(*args, **more)

    monkeypatch.setattr(ann, "trained_router", traced)
    cells = spark.createDataFrame([(i, i, [float(i % 7), float(i % 5) + 1.0, 1.0]) for i in range(60)], "h1 long, h2 long, vec array<double>")
    assert ann.fit(cells).parts == ann.LEAST_PARTS
