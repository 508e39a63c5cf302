"""Results kept from run to run, rows kept for a time, and lists with limits of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.operators.lineage import written
from veinstone.operators.spreading import spread


def misses(current: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of current whose keys the cache lacks."""
    return current.join(cache.select(*keys).distinct(), keys, "left_anti")


def cached(current: DataFrame, cache: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The new cache: what it has for the keys of current, and compute of the rows it lacks; what current no longer has is gone.

    compute gives the columns of the cache. Only what is new, say a file whose content changed (keys path and oid), is computed."""
    hits = cache.join(current.select(*keys).distinct(), keys, "left_semi")
    return hits.unionByName(written(compute(misses(current, cache, keys))).select(cache.columns))


def kept_for(rows: DataFrame, changes: DataFrame, keys: list[str], at: str, now: Column, days: int) -> DataFrame:
    """rows with changes put in, the latest by `at` of each key, without those older than so many days at `now`."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.unionByName(changes.select(rows.columns)).groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("r")).select(*keys, "r.*").select(rows.columns)
    return best.where(F.col(at).cast("timestamp") >= now.cast("timestamp") - F.expr(f"interval {days} days"))


def capped_union(parts: list[DataFrame], order: list[str], each: int, total: int) -> DataFrame:
    """The first `each` rows of every part in order, parts one after the other, `total` in all; with part (from 1) and place."""
    out = None
    for i, p in enumerate(parts, 1):
        first = p.orderBy(*order).limit(each).withColumn("part", F.lit(i))
        out = first if out is None else out.unionByName(first)
    return out.withColumn("place", F.row_number().over(W.orderBy("part", *order))).where(F.col("place") <= total)


def shallow_first(paths: DataFrame, limit: int, rules: list[str]) -> DataFrame:
    """(path, place): the first paths by number of folders and name, `limit` of them, among which the first that fits each pattern always is."""
    depth = F.size(F.split("path", "/"))
    p = paths.select("path").distinct().withColumn("depth", depth)
    least = p.agg(*[F.min(F.when(F.col("path").rlike(r), F.struct("depth", "path"))).alias(f"r{i}") for i, r in enumerate(rules)])
    firsts = least.select(F.explode(F.slice(F.array_distinct(F.array_compact(F.array(*[f"r{i}.path" for i in range(len(rules))]))), 1, limit)).alias("path")).withColumn("must", F.lit(0))
    # the candidates besides are no more than the limit, so only so many rows are ever ordered together
    others = p.join(F.broadcast(firsts), "path", "left_anti").orderBy("depth", "path").limit(limit).withColumn("must", F.lit(1))
    both = firsts.withColumn("depth", depth).select("path", "depth", "must").union(others.select("path", "depth", "must"))
    held = both.withColumn("n", F.row_number().over(W.orderBy("must", "depth", "path"))).where(F.col("n") <= limit)
    return held.select("path", F.row_number().over(W.orderBy("depth", "path")).alias("place"))


def graph_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, item, n) of nodes(node) and edges(a, b, weight): nodes named twice, ends that are no node, weights that are no number above 0."""
    twice = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("node twice").alias("problem"), F.col("node").cast("string").alias("item"), "n")
    # ends are counted before they meet the nodes, so the join has a row a node, not one an edge; written, as Spark would move the join ahead again
    ends = written(edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    lost = ends.join(nodes.select("node").distinct(), "node", "left_anti").select(F.lit("unknown end"), F.col("node").cast("string"), "n")
    good = F.coalesce((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.lit(False))
    wrong = edges.where(~good).select(F.concat_ws(" ", "a", "b").alias("item"))
    bad = spread(wrong, wrong.count(), "item").groupBy("item").agg(F.count(F.lit(1)).alias("n")).select(F.lit("bad weight"), "item", "n")
    return twice.union(lost).union(bad)


def merged_into(targets: DataFrame) -> DataFrame:
    """(target, ids): which ids end at each target, from targets(id, target) of resolved redirects; a target's list must fit a row."""
    return targets.where("state = 'done'").groupBy("target").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def year_grid(days: DataFrame) -> DataFrame:
    """(year, week, weekday, n) from days(day, n): columns of weeks that begin on Mondays, the first holding 1 January; weekday from 0."""
    first = F.trunc("day", "year")
    lead = F.weekday(first)
    return days.select(F.year("day").alias("year"), F.floor((F.datediff("day", first) + lead) / 7).cast("int").alias("week"), F.weekday("day").alias("weekday"), "n")
