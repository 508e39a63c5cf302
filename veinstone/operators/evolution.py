"""A script of ordered changes applied to memberships at once: maps are composed by doubling, no row is replayed change by change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.operators.lineage import written

#: seq of what was there before the script, and one behind its end.
BEFORE, AFTER = 0, 2**62


class Script:
    """ops(seq, kind, feature, into), seq from 1: rename, move, create, merge (feature into into), split, retire; uses(seq, cluster, target): the clusters that
    a move, create or split puts into a feature; clusters(cluster, path); features(feature): the active ones before the script."""

    def __init__(self, ops: DataFrame, uses: DataFrame, clusters: DataFrame, features: DataFrame):
        self.ops, self.uses, self.clusters, self.features = ops, uses, clusters, features

    def lives(self) -> DataFrame:
        """(feature, born, died, end, into): when each feature comes and goes, by which kind of change, and into what."""
        made = self.uses.join(self.ops.where("kind in ('create', 'split')").select("seq"), "seq").select(F.col("target").alias("feature"), F.col("seq").alias("born"))
        born = self.features.select("feature", F.lit(BEFORE).cast("long").alias("born")).union(made).groupBy("feature").agg(F.min("born").alias("born"))
        gone = self.ops.where("kind in ('merge', 'split', 'retire')").groupBy("feature").agg(F.min(F.struct("seq", "kind", "into")).alias("g"))
        return born.join(gone, "feature", "left").select("feature", "born", F.col("g.seq").alias("died"), F.col("g.kind").alias("end"), F.when(F.col("g.kind") == "merge", F.col("g.into")).alias("into"))


def _strides(lives: DataFrame) -> list[DataFrame]:
    """(feature, first, to, last): where 1, 2, 4, ... merges lead, and when the first and last of them happen, as long as each is later than the one before."""
    out = [written(lives.where("into is not null").select("feature", F.col("died").alias("first"), F.col("into").alias("to"), F.col("died").alias("last")))]
    while not out[-1].isEmpty():
        x = out[-1]
        y = x.select(F.col("feature").alias("to"), F.col("first").alias("then"), F.col("to").alias("next"), F.col("last").alias("end"))
        out.append(written(x.join(y, "to").where("then > last").select("feature", "first", F.col("next").alias("to"), F.col("end").alias("last"))))
    return out[:-1]


def _carried(at: DataFrame, strides: list[DataFrame]) -> DataFrame:
    """at(feature, since, until, ...) with feature moved on through the merges after since and up to until: the largest strides first."""
    for s in reversed(strides):
        step = s.select("feature", F.col("first").alias("_first"), F.col("to").alias("_to"), F.col("last").alias("_last"))
        j = at.join(step, "feature", "left")
        go = F.coalesce((F.col("_first") > F.col("since")) & (F.col("_last") <= F.col("until")), F.lit(False))
        at = j.withColumns({"feature": F.when(go, F.col("_to")).otherwise(F.col("feature")), "since": F.when(go, F.col("_last")).otherwise(F.col("since"))}).drop("_first", "_to", "_last")
    return at


def evolved(membership: DataFrame, script: Script) -> DataFrame:
    """(path, feature) of membership(path, feature) after the script, as far as it goes by its own rules (see problems()).

    A merge moves all that is in a feature then; what comes later is refused. A path is in one cluster and a cluster is used once, so a path is set down at most once:
    where it is just before tells whether a split takes it, and from where it was set down it goes on through later merges. Each path takes part in as many joins as the longest chain of merges has binary digits, twice."""
    strides = _strides(script.lives())
    kind = script.ops.select("seq", "kind", F.col("feature").alias("of"))
    use = script.clusters.join(script.uses, "cluster").join(kind, "seq").select("path", "seq", "target", "kind", "of")
    at = membership.select("path", "feature").withColumn("since", F.lit(BEFORE).cast("long"))
    paths = at.join(use, "path", "full_outer").withColumn("since", F.coalesce("since", F.lit(BEFORE).cast("long")))
    just_before = _carried(paths.where("seq is not null").withColumn("until", F.col("seq") - 1), strides)
    taken = F.col("kind").isin("move", "create") | F.coalesce(F.col("feature") == F.col("of"), F.lit(False))
    placed = just_before.select("path", F.when(taken, F.col("target")).otherwise(F.col("feature")).alias("feature"), F.when(taken, F.col("seq")).otherwise(F.col("since")).alias("since"))
    rest = paths.where("seq is null").select("path", "feature", "since")
    done = _carried(placed.union(rest).where("feature is not null").withColumn("until", F.lit(AFTER)), strides)
    return done.select("path", "feature")


def problems(membership: DataFrame, script: Script, after: DataFrame) -> DataFrame:
    """(seq, feature, problem) of every rule that the script breaks; after: evolved(). Nothing is to be applied if there is any.

    inactive: a change of a feature, or into one, that isn't active then; known: a new feature that was there already; reused: a cluster used before; unknown: a cluster without paths; itself: a merge
    of a feature into itself; left: paths still in a feature that was split or retired; empty: a feature the script touches that ends active without a path."""
    lives = written(script.lives())
    ops = script.ops.where("kind <> 'create'")
    named = ops.select("seq", "feature").union(ops.where("kind = 'merge'").select("seq", "into"))
    life = named.join(lives, "feature", "left")
    alive = F.coalesce((F.col("born") < F.col("seq")) & (F.col("died").isNull() | (F.col("died") >= F.col("seq"))), F.lit(False))
    out = [life.where(~alive).select("seq", "feature", F.lit("inactive").alias("problem"))]
    fresh = script.uses.join(script.ops.where("kind in ('create', 'split')").select("seq"), "seq").select("seq", F.col("target").alias("feature")).distinct()
    out.append(fresh.join(lives.select("feature", "born"), "feature").where("born < seq").select("seq", "feature", F.lit("known")))
    first = script.uses.groupBy("cluster").agg(F.min("seq").alias("first"))
    out.append(script.uses.join(first, "cluster").where("seq > first").select("seq", F.col("target"), F.lit("reused")))
    out.append(script.uses.join(script.clusters.select("cluster").distinct(), "cluster", "left_anti").select("seq", "target", F.lit("unknown")))
    out.append(script.ops.where("kind = 'merge' and feature = into").select("seq", "feature", F.lit("itself")))
    sizes = after.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    ended = lives.join(sizes, "feature", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out.append(ended.where("end in ('split', 'retire') and n > 0").select(F.col("died"), "feature", F.lit("left")))
    touched = script.ops.select("seq", "feature").union(script.ops.where("into is not null").select("seq", "into")).union(script.uses.select("seq", "target")).groupBy("feature").agg(F.max("seq").alias("seq"))
    out.append(touched.join(ended.where("died is null and n = 0").select("feature"), "feature").select("seq", "feature", F.lit("empty")))
    every = out[0]
    for d in out[1:]:
        every = every.union(d)
    return every.distinct()


def applied(membership: DataFrame, script: Script) -> tuple[DataFrame, DataFrame]:
    """(membership, problems): evolved if there is no problem, else as it was."""
    after = written(evolved(membership, script))
    found = written(problems(membership, script, after))
    return (after if found.isEmpty() else membership.select("path", "feature")), found
