"""Membership of files in features: weights, churn, drift, placement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.functions.numbers import rounded
from veinstone.operators.spreading import spread


def centrality(edges: DataFrame, membership: DataFrame, floor: float = 0.05) -> DataFrame:
    """(path, feature, weight): the share of a file's edge weight inside its feature, at least floor, times 1 for core and 0.5
    for supporting files, to 3 places. edges(a, b, weight); membership(path, feature, role)."""
    both = edges.select(F.col("a").alias("path"), F.col("b").alias("other"), "weight").union(edges.select(F.col("b").alias("path"), F.col("a").alias("other"), "weight"))
    m = membership.select("path", "feature", "role")
    near = both.join(m, "path").join(m.select(F.col("path").alias("other"), F.col("feature").alias("of")), "other", "left")
    share = near.groupBy("path").agg((F.sum(F.when(F.col("of") == F.col("feature"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("share"))
    role = F.when(F.col("role") == "core", 1.0).otherwise(0.5)
    return m.join(share, "path", "left").select("path", "feature", rounded(role * F.greatest(F.lit(floor), F.coalesce("share", F.lit(0.0))), 3).alias("weight"))


def centrality_of_files(g, membership: DataFrame, floor: float = 0.05, places: int = 6) -> DataFrame:
    """centrality() of a whole graph.FileGraph, weights rounded to so many places: a file's pairs by folder alone are counted by feature, not met one by one."""
    near = g.near.select("a", "b", rounded(F.col("weight"), places).alias("weight"))
    m = membership.select("path", "feature", "role")
    both = near.select(F.col("a").alias("path"), F.col("b").alias("other"), "weight").union(near.select(F.col("b").alias("path"), F.col("a").alias("other"), "weight"))
    n = 2 * near.count()
    met = spread(both, n, "other").join(m.select(F.col("path").alias("other"), F.col("feature").alias("of")), "other", "left")
    met = spread(met.groupBy("path", "of").agg(F.sum("weight").alias("weight")), n, "path")
    folder = g.folders.select("dir", "path", rounded(F.col("w"), places).alias("w"))
    mates = folder.join(m.select("path", F.col("feature").alias("of")), "path", "left").groupBy("dir", "of").agg(F.count(F.lit(1)).alias("n"))
    by_folder = folder.join(mates, "dir").select("path", "of", (F.col("n") * F.col("w")).alias("weight"))
    # a file is no mate of its own, and pairs met above have their folders' part already
    away = folder.join(m.select("path", F.col("feature").alias("of")), "path", "left").select("path", "of", (-F.col("w")).alias("weight"))
    told = g.inside.select("dir", F.col("a").alias("path"), F.col("b").alias("other")).union(g.inside.select("dir", F.col("b").alias("path"), F.col("a").alias("other")))
    told = told.join(folder, ["dir", "path"]).join(m.select(F.col("path").alias("other"), F.col("feature").alias("of")), "other", "left").select("path", "of", (-F.col("w")).alias("weight"))
    every = met.union(by_folder).union(away).union(told).groupBy("path", "of").agg(F.sum("weight").alias("weight"))
    share = m.select("path", "feature").join(every, "path").groupBy("path", "feature").agg(F.sum(F.when(F.col("of") == F.col("feature"), F.col("weight")).otherwise(0.0)).alias("own"), F.sum("weight").alias("all"))
    share = share.select("path", "feature", F.when(F.col("all") > 1e-9, F.col("own") / F.col("all")).alias("share"))
    role = F.when(F.col("role") == "core", 1.0).otherwise(0.5)
    return m.join(share, ["path", "feature"], "left").select("path", "feature", rounded(role * F.greatest(F.lit(floor), F.coalesce("share", F.lit(0.0))), 3).alias("weight"))


def churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """(feature, moved, base, churn) between two memberships (path, feature, weight).

    A member kept counts the change of its weight; one that moved its old weight for the old feature
    and the new for the new; lost and gained ones theirs. churn is moved over base, the weight before;
    infinite if the base is 0 and something moved, 0 if nothing did.
    """
    one, two = before.toDF("path", "f0", "w0"), after.toDF("path", "f1", "w1")
    both = one.join(two, "path", "full_outer")
    kept = F.col("f0") == F.col("f1")
    parts = F.when(kept, F.array(F.struct(F.col("f0").alias("feature"), F.abs(F.col("w0") - F.col("w1")).alias("w")))).otherwise(
        F.array(F.struct(F.col("f0").alias("feature"), F.col("w0").alias("w")), F.struct(F.col("f1").alias("feature"), F.col("w1").alias("w")))
    )
    moved = both.select(F.explode(parts).alias("p")).where("p.feature is not null").groupBy("p.feature").agg(F.sum("p.w").alias("moved"))
    base = before.groupBy("feature").agg(F.sum("weight").alias("base"))
    out = moved.join(base, "feature", "left").withColumn("base", F.coalesce("base", F.lit(0.0)))
    rate = F.when(F.col("base") > 0, F.col("moved") / F.col("base")).when(F.col("moved") > 0, float("inf")).otherwise(0.0)
    return out.select("feature", "moved", "base", rate.alias("churn"))


def placement_votes(wanted: DataFrame, members: DataFrame, imports: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, signal, feature, votes) for each of wanted(path): members(path, feature) that it imports or that import it, from
    imports(src, dst); that change with it, from changes(a, b, n), n votes each; and of its nearest folder that holds any."""
    w, m = wanted.select("path").distinct(), members.select(F.col("path").alias("other"), "feature")
    both = lambda d, a, b, *more: d.select(F.col(a).alias("path"), F.col(b).alias("other"), *more).union(d.select(F.col(b).alias("path"), F.col(a).alias("other"), *more))
    tally = lambda d, signal, n: d.join(w, "path", "left_semi").join(m, "other").groupBy("path", F.lit(signal).alias("signal"), "feature").agg(n.cast("long").alias("votes"))
    one = tally(both(imports, "src", "dst").distinct(), "imports", F.count(F.lit(1)))
    two = tally(both(changes, "a", "b", "n"), "changes", F.sum("n"))
    parts = F.split("path", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))
    inside = lambda d: d.where(F.size(parts) > 1).withColumn("p", F.explode(prefix))
    # a folder's features are counted before they meet the paths below it
    held = inside(members.select("path", "feature")).groupBy(F.col("p.folder").alias("folder"), "feature").agg(F.count(F.lit(1)).alias("votes"))
    near = inside(w).select("path", "p.depth", "p.folder").join(held, "folder")
    deepest = near.groupBy("path").agg(F.max("depth").alias("depth"))
    three = near.join(deepest, ["path", "depth"]).select("path", F.lit("folder").alias("signal"), "feature", "votes")
    return one.union(two).union(three)


def placed(signals: DataFrame) -> DataFrame:
    """(path, state, features) of new files from votes (path, signal, feature, votes).

    Of each signal all features with its most votes count; one feature in all is decided, several are
    disputed. features: sorted, comma-joined."""
    best = signals.withColumn("top", F.max("votes").over(W.partitionBy("path", "signal"))).where("votes = top")
    out = best.groupBy("path").agg(F.array_sort(F.collect_set("feature")).alias("f"))
    return out.select("path", F.when(F.size("f") == 1, "decided").otherwise("disputed").alias("state"), F.array_join("f", ",").alias("features"))
