"""Nearest neighbours by learned partitions: a neighbour graph is cut into parts of one size, a small classifier routes to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone.llm.samples import sampled
from veinstone.operators.lineage import written

#: The graph and the classifier are fitted on at most so many distinct vectors; every vector is indexed.
SAMPLE = 8_000
#: So many queries are answered exactly over all vectors, to choose how many parts a query visits.
TRIALS = 200
#: Parts have about so many distinct vectors, as far as MOST_PARTS allows; there are LEAST_PARTS at least.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 4_000, 8, 64
#: A task compares at most about so many vectors with so many queries; larger parts are dealt to several.
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 32_768
#: Rows of products held at a time.
STEP = 256


def neighbour_graph(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the edges from each row to its m rows of largest inner product, each edge both ways."""
    m = min(m, len(x) - 1)
    ends = []
    for i in range(0, len(x), STEP):
        near = x[i : i + STEP] @ x.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
        ends.append(np.argpartition(-near, m - 1, axis=1)[:, :m] if m else np.zeros((len(near), 0), np.int64))
    to = np.concatenate(ends).ravel()
    of = np.repeat(np.arange(len(x)), m)
    return np.concatenate([of, to]), np.concatenate([to, of])


def _halves(n: int, of: np.ndarray, to: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """A side for each of n nodes, a share of them on the first: by a smoothed random vector (the graph's slowest way to vary), then by
    exchanging the pairs that save most edges."""
    degree = np.maximum(np.bincount(of, minlength=n), 1)
    v = rng.normal(size=n)
    for _ in range(60):
        v = 0.5 * v + 0.5 * np.bincount(of, v[to], n) / degree
        v -= v.mean()
        v /= np.linalg.norm(v) or 1.0
    side = np.ones(n, bool)
    side[np.argsort(v, kind="stable")[: int(round(n * share))]] = False
    best, least = side.copy(), None
    for _ in range(30):
        across = side[of] != side[to]
        cut = int(across.sum())
        if least is None or cut < least:
            best, least = side.copy(), cut
        gain = np.bincount(of, np.where(across, 1.0, -1.0), n)
        one, two = np.flatnonzero(~side), np.flatnonzero(side)
        one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
        k = min(len(one), len(two))
        good = int((gain[one[:k]] + gain[two[:k]] > 0).sum())
        if not good:
            break
        # neighbours that both move gain nothing: only a part of the pairs moves in a round
        moved = np.flatnonzero(rng.random(good) < 0.5) if good > 1 else np.zeros(1, np.int64)
        side[one[moved]], side[two[moved]] = True, False
    return best


def balanced_parts(n: int, of: np.ndarray, to: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """A part, from 0, for each of n nodes of a graph, all of one size within one node a halving: halved again and again."""
    rng = np.random.default_rng(seed)
    out = np.zeros(n, np.int64)
    todo = [(np.arange(n), of, to, 0, parts)]
    while todo:
        nodes, a, b, first, k = todo.pop()
        if k == 1 or len(nodes) < 2:
            out[nodes] = first
            continue
        side = _halves(len(nodes), a, b, (k // 2) / k, rng)
        place = np.cumsum(np.where(side, 0, 1)) - 1
        place[side] = np.arange(int(side.sum()))
        for which, start, many in ((False, first, k // 2), (True, first + k // 2, k - k // 2)):
            inside = (side[a] == which) & (side[b] == which)
            todo.append((nodes[side == which], place[a[inside]], place[b[inside]], start, many))
    return out


class Router:
    """One hidden layer: the probability of each part for a vector."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray):
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    @property
    def parts(self) -> int:
        return len(self.b2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The logarithm of each part's probability."""
        z = np.tanh(_unit(x) @ self.w1 + self.b1) @ self.w2 + self.b2
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x).argmax(1)

    @classmethod
    def trained(cls, x: np.ndarray, wanted: np.ndarray, hidden: int = 128, rounds: int = 30, batch: int = 256, rate: float = 3e-3, seed: int = 5) -> Router:
        """By cross-entropy against wanted, a distribution over the parts for each row of x."""
        rng = np.random.default_rng(seed)
        x = _unit(x).astype(np.float32)
        wanted = wanted.astype(np.float32)
        dims, parts = x.shape[1], wanted.shape[1]
        p = [rng.normal(size=(dims, hidden)).astype(np.float32) * np.float32(1.5), np.zeros(hidden, np.float32), np.zeros((hidden, parts), np.float32), np.zeros(parts, np.float32)]
        mean, square = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        t = 0
        for step in range(rounds):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                h = np.tanh(x[at] @ p[0] + p[1])
                z = h @ p[2] + p[3]
                e = np.exp(z - z.max(1, keepdims=True))
                d = (e / e.sum(1, keepdims=True) - wanted[at]) / len(at)
                dh = (d @ p[2].T) * (1 - h * h)
                grads = (x[at].T @ dh, dh.sum(0), h.T @ d, d.sum(0))
                t += 1
                for k, g in enumerate(grads):
                    mean[k] += (g - mean[k]) * np.float32(0.1)
                    square[k] += (g * g - square[k]) * np.float32(0.01)
                    now = rate * (1 - step / rounds) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
                    p[k] -= np.float32(now) * mean[k] / (np.sqrt(square[k]) + np.float32(1e-8))
        return cls(*[a.astype(np.float64) for a in p])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def trained_router(x: np.ndarray, parts: int, m: int = 10, seed: int = 5) -> Router:
    """Cuts x's neighbour graph into parts and learns which of them a vector's neighbours, and itself, are in."""
    of, to = neighbour_graph(x.astype(np.float32), m)
    part = balanced_parts(len(x), of, to, parts, seed)
    wanted = np.zeros((len(x), parts))
    np.add.at(wanted, (of, part[to]), 1.0)
    wanted[np.arange(len(x)), part] += 1.0
    return Router.trained(x, wanted / wanted.sum(1, keepdims=True), seed=seed)


class Tree:
    """A router to parts and, for large parts, a router to parts of theirs; leaves are numbered part by part."""

    def __init__(self, root: Router, below: dict[int, Router]):
        self.root, self.below = root, below
        sizes = [below[k].parts if k in below else 1 for k in range(root.parts)]
        self.first = np.concatenate([[0], np.cumsum(sizes)])

    @property
    def parts(self) -> int:
        return int(self.first[-1])

    def scores(self, x: np.ndarray) -> np.ndarray:
        top = self.root.scores(x)
        return np.concatenate([top[:, [k]] + self.below[k].scores(x) if k in self.below else top[:, [k]] for k in range(self.root.parts)], axis=1)

    def home(self, x: np.ndarray) -> np.ndarray:
        part = self.root.home(x)
        leaf = self.first[part]
        for k in set(part.tolist()) & set(self.below):
            leaf[part == k] += self.below[k].home(x[part == k])
        return leaf


class Index:
    """cells(h1, h2, ids, asked, vec, part): each distinct vector with its smallest ids; tree routes to parts; visits: how many a query needs."""

    def __init__(self, cells: DataFrame, asked: DataFrame, tree: Tree | None, visits: int, k: int):
        self.cells, self.asked, self.tree, self.visits, self.k = cells, asked, tree, visits, k


def usable(vectors: DataFrame, of: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, vec, h1, h2) of the rows that take part; h1 and h2, 128 bits of hash, tell vectors apart."""
    v = F.col("vec")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are one value
    rows = vectors.select(F.col(of).cast("long").alias("vec_id"), F.transform(F.col(column), lambda x: F.when(x == 0, F.abs(x)).otherwise(x)).alias("vec")).where(F.col("vec_id").isNotNull() & fine)
    sizes = rows.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dims").limit(1).collect()
    rows = rows.where(F.size("vec") == (sizes[0]["dims"] if sizes else 0))
    return rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _with_parts(cells: DataFrame, tree: Router | Tree, name: str) -> DataFrame:
    """cells with the part that each vector is most likely in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(**{name: tree.home(_matrix(pdf["vec"])).astype(np.int32)})

    return cells.mapInPandas(run, T.StructType([*cells.schema.fields, T.StructField(name, T.IntegerType())]))


def _parts(rows: int) -> int:
    return int(min(MOST_PARTS, max(LEAST_PARTS, -(-rows // PART_ROWS))))


def fit(cells: DataFrame, seed: int = 5) -> Tree | None:
    """The tree of routers of distinct vectors cells(h1, h2, vec). Where the parts of one router would be larger than meant, each part's own
    graph, of a sample of its own, is cut again, all of them in parallel. None if there are no vectors."""
    n = cells.count()
    if not n:
        return None

    def routers(some: DataFrame, parts: dict[int, int]) -> dict[int, Router]:
        """A router for each part of some(part, vec), a bounded sample, each trained in a task: only weights reach the driver."""

        def train(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = _matrix(pdf["vec"])
            x = x[np.lexsort(x.T)]  # in whatever order they came
            r = trained_router(x, min(parts[key[0]], len(x)), seed=seed)
            return pd.DataFrame({"part": [key[0]], "weights": [[w.ravel() for w in (r.w1, r.b1, r.w2, r.b2)]]})

        out = {}
        for r in some.groupBy("part").applyInPandas(train, "part int, weights array<array<double>>").collect():
            w1, b1, w2, b2 = (np.array(w) for w in r["weights"])
            out[r["part"]] = Router(w1.reshape(-1, len(b1)), b1, w2.reshape(len(b1), len(b2)), b2)
        return out

    few = sampled(cells.select("h1", "h2", "vec"), SAMPLE, ["h1", "h2"], seed=seed)
    root = routers(few.select(F.lit(0).alias("part"), "vec"), {0: _parts(n)})[0]
    below: dict[int, Router] = {}
    if n > root.parts * PART_ROWS:
        told = _with_parts(cells.select("h1", "h2", "vec"), root, "part")
        sizes = {r["part"]: r["n"] for r in told.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        large = {k: min(MOST_PARTS, -(-v // PART_ROWS)) for k, v in sizes.items() if v > PART_ROWS}
        some = sampled(told.where(F.col("part").isin(*large)), SAMPLE, ["h1", "h2"], group=F.col("part"), seed=seed).select("part", "vec")
        below = routers(some, large)
    return Tree(root, below)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row and of all within rounding of the least of them."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        return np.nonzero(scores >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
    return np.nonzero(np.ones_like(scores, bool))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, always added up in the same order: equal vectors get equal scores."""
    return (a * b).sum(axis=1)


def needed_visits(cells: DataFrame, tree: Tree, k: int, recall: float, seed: int = 11) -> int:
    """How many parts, most likely first, hold on average that share of the k nearest distinct vectors of TRIALS of the asked vectors.
    The nearest are found exactly, over all cells(h1, h2, vec, part, asked)."""
    trials = sampled(cells.where("asked").select("h1", "h2", "vec"), TRIALS, ["h1", "h2"], seed=seed).orderBy("h1", "h2").toPandas()
    if not len(trials):
        return 1
    x, one, two = _matrix(trials["vec"]), trials["h1"].to_numpy(), trials["h2"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            for i in range(0, len(pdf), 2048):
                piece = pdf.iloc[i : i + 2048]
                scores = x @ _matrix(piece["vec"]).T
                scores[(one[:, None] == piece["h1"].to_numpy()) & (two[:, None] == piece["h2"].to_numpy())] = -np.inf
                row, col = _best(scores, k)
                new = pd.DataFrame({"trial": row, "part": piece["part"].to_numpy()[col], "score": scores[row, col]})
                held = new if held is None else pd.concat([held, new])
                held = held.sort_values(["trial", "score"], ascending=[True, False]).groupby("trial").head(k)
        if held is not None:
            yield held[np.isfinite(held["score"])]

    found = cells.select("h1", "h2", "vec", "part").mapInPandas(run, "trial int, part int, score double")
    first = F.row_number().over(W.partitionBy("trial").orderBy(F.col("score").desc(), "part"))
    truth = found.withColumn("r", first).where(F.col("r") <= k).select("trial", "part").toPandas()
    place = np.argsort(np.argsort(-tree.scores(x), axis=1, kind="stable"), axis=1)
    rank = place[truth["trial"].to_numpy(), truth["part"].to_numpy()] if len(truth) else np.zeros(1, int)
    # a share of the neighbours is in the parts up to this place
    return int(np.sort(rank)[max(0, int(np.ceil(recall * len(rank))) - 1)]) + 1


def build(vectors: DataFrame, asked, k: int = 20, recall: float = 0.95, of: str = "vec_id", column: str = "embedding", seed: int = 5) -> Index:
    """The index of vectors(vec_id, embedding). asked: a condition on vec_id that says which rows are queries.

    Equal vectors are one entry with its k + 1 smallest ids: no other of them can be among anybody's k nearest, where ties go to the smaller id."""
    rows = usable(vectors, of, column)
    seen = written(rows.select("h1", "h2", "vec_id").distinct())
    first = F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))
    ids = seen.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # of rows with one id and several vectors, one asks
    queries = written(seen.where(asked).groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select(F.col("vec_id").alias("query_id"), "h.h1", "h.h2"))
    ids = ids.join(queries.select("h1", "h2").distinct().withColumn("asked", F.lit(True)), ["h1", "h2"], "left")
    one = rows.groupBy("h1", "h2", "vec_id").agg(F.first("vec").alias("vec"))
    entries = one.join(ids.withColumn("vec_id", F.col("ids")[0]), ["h1", "h2", "vec_id"]).select("h1", "h2", "ids", F.coalesce("asked", F.lit(False)).alias("asked"), "vec")
    entries = written(entries)
    tree = fit(entries, seed)
    if tree is None:
        return Index(entries.withColumn("part", F.lit(0)), queries, None, 1, k)
    cells = written(_with_parts(entries, tree, "part"))
    return Index(cells, queries, tree, needed_visits(cells, tree, k, recall), k)


def search(index: Index) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, nearest first, ties to the smaller vec_id.

    Each asked vector visits its most likely parts. A part with many vectors or queries is dealt to a grid of tasks, each of which compares a block of
    the one with a block of the other and returns its best k + 1 by query, in one row."""
    schema = "h1 long, h2 long, best array<struct<score:double,vec_id:long>>"
    k, tree, visits = index.k, index.tree, index.visits
    spark = index.cells.sparkSession
    if tree is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                parts = np.argsort(-tree.scores(_matrix(pdf["vec"])), axis=1, kind="stable")[:, :visits]
                yield pdf.assign(parts=list(parts.astype(np.int32)))

    kind = index.cells.schema["vec"].dataType
    routed = index.cells.where("asked").select("h1", "h2", "vec").mapInPandas(route, T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("vec", kind), T.StructField("parts", T.ArrayType(T.IntegerType()))]))
    routed = routed.select("h1", "h2", "vec", F.explode("parts").alias("part"))
    count = lambda d, name: d.groupBy("part").agg(F.count(F.lit(1)).alias(name))
    # as many rows as there are parts, some thousands at most
    sizes = count(index.cells, "rows").join(count(routed, "queries"), "part").toPandas()
    rows, asked = -(-sizes["rows"] // BLOCK_ROWS), -(-sizes["queries"] // BLOCK_QUERIES)
    grid = F.broadcast(spark.createDataFrame(list(zip(sizes["part"].tolist(), rows.tolist(), asked.tolist())), "part int, n_rows long, n_queries long"))
    cell = ["part", "row_block", "query_block"]
    n = int(min(20_000, max(16, 2 * int((rows * asked).sum()))))
    deal = lambda n: F.pmod("h1", F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    left = index.cells.join(grid, "part").select("part", deal("n_rows").alias("row_block"), spread("n_queries").alias("query_block"), "ids", "vec").repartition(n, *cell)
    right = routed.join(grid, "part").select("part", spread("n_rows").alias("row_block"), deal("n_queries").alias("query_block"), "h1", "h2", "vec").repartition(n, *cell)

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = {"h1": [], "h2": [], "best": []}
        if len(one) and len(two):
            x, q = _matrix(one["vec"]), _matrix(two["vec"])
            ids = one["ids"].to_list()
            lengths, flat = np.array([len(i) for i in ids]), np.concatenate(ids)
            start = np.cumsum(lengths) - lengths
            for i in range(0, len(q), STEP):
                row, col = _best(q[i : i + STEP] @ x.T, k + 1)
                score = _exact(q[i + row], x[col])
                many = lengths[col]
                at = np.repeat(start[col], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                row, score, named = np.repeat(row, many), np.repeat(score, many), flat[at]
                order = np.lexsort((named, -score, row))
                row, score, named = row[order], score[order], named[order]
                begin = np.searchsorted(row, np.arange(row[-1] + 2))
                for r in range(len(begin) - 1):
                    a, b = begin[r], min(begin[r] + k + 1, begin[r + 1])
                    out["best"].append([{"score": s, "vec_id": v} for s, v in zip(score[a:b].tolist(), named[a:b].tolist())])
                out["h1"] += two["h1"].iloc[i : i + STEP].to_list()
                out["h2"] += two["h2"].iloc[i : i + STEP].to_list()
        return pd.DataFrame({name: pd.Series(x, dtype=object) for name, x in out.items()})

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(compare, schema)
    each = found.select("h1", "h2", F.explode("best").alias("b")).select("h1", "h2", "b.vec_id", "b.score")
    # rows with one id and several vectors: the nearest counts
    each = each.groupBy("h1", "h2", "vec_id").agg(F.max("score").alias("score"))
    near = W.partitionBy("h1", "h2").orderBy(F.col("score").desc(), "vec_id")
    lists = each.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    lists = lists.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    mine = index.asked.join(lists, ["h1", "h2"])
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    ranked = mine.select("query_id", F.posexplode(others).alias("p", "b"))
    return ranked.select("query_id", (F.col("p") + 1).alias("rank"), "b.vec_id", "b.score")
