"""What pull requests and other changes do to features, and to the tables that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.functions.numbers import rounded
from veinstone.functions.text import member_id, member_path


def placed_changes(changes: DataFrame, membership: DataFrame) -> DataFrame:
    """changes(old_path, new_path, ...) with feature: that of the old path, else that of the new one; null if neither has one."""
    m = membership.select("path", "feature")
    out = changes.join(m.toDF("old_path", "_old"), "old_path", "left").join(m.toDF("new_path", "_new"), "new_path", "left")
    return out.select(*changes.columns, F.coalesce("_old", "_new").alias("feature"))


def has_citable_lines(files: Column) -> Column:
    """Whether an array of (status, additions, deletions) has a changed file that is still there."""
    return F.exists(files, lambda f: (f["status"] != "deleted") & (f["additions"] + f["deletions"] > 0))


def feature_effects(files: DataFrame, churn: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(pr, feature, files, changed_lines, added, removed, churn, drifts, rank) from files(pr, feature, status, additions, deletions) and
    churn(pr, feature, churn), which may be infinite (then churn is null, and it drifts); heaviest first."""
    n = files.where("feature is not null").groupBy("pr", "feature").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.col("additions") + F.col("deletions")).alias("changed_lines"),
        F.count(F.when(F.col("status") == "added", 1)).alias("added"), F.count(F.when(F.col("status") == "deleted", 1)).alias("removed"),
    )
    out = n.join(churn.select("pr", "feature", F.col("churn").alias("_churn")), ["pr", "feature"], "left").withColumn("_churn", F.coalesce("_churn", F.lit(0.0)))
    out = out.withColumn("churn", F.when(F.col("_churn") < float("inf"), rounded(F.col("_churn"), 3))).withColumn("drifts", F.col("_churn") > threshold).drop("_churn")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("pr").orderBy(F.col("changed_lines").desc(), F.col("files").desc(), "feature")))


def membership_after(membership: DataFrame, changes: DataFrame, placed: DataFrame) -> DataFrame:
    """(member, feature, weight) after changes(status, old_path, new_path), from membership(member, feature, weight), members being path or path#symbol.

    Members of a deleted path go, those of a renamed one follow it, symbols too; placed(path, feature, weight) come in, or take over. A path
    has at most one change; of members that end under one name a placed one stays, else the smallest entry."""
    path, symbol = member_path(F.col("member")), F.when(F.instr("member", "#") > 0, F.substring_index("member", "#", -1))
    gone = changes.where(F.col("status").isin("deleted", "renamed")).groupBy(F.col("old_path").alias("_path")).agg(F.max(F.when(F.col("status") == "renamed", F.col("new_path"))).alias("_to"), F.lit(True).alias("_hit"))
    now = membership.select("member", "feature", "weight", path.alias("_path"), symbol.alias("_symbol")).join(gone, "_path", "left").where(F.col("_hit").isNull() | F.col("_to").isNotNull())
    now = now.select(F.when(F.col("_to").isNotNull(), member_id(F.col("_to"), F.col("_symbol"))).otherwise(F.col("member")).alias("member"), F.lit(1).alias("_late"), "feature", "weight")
    new = placed.select(member_id(F.col("path"), F.lit(None).cast("string")).alias("member"), F.lit(0).alias("_late"), "feature", "weight")
    best = now.union(new).groupBy("member").agg(F.min(F.struct("_late", "feature", "weight")).alias("b"))
    return best.select("member", "b.feature", "b.weight")


def test_only_features(files: DataFrame, is_test: Column) -> DataFrame:
    """(feature) whose files(feature, path) are all tests, if some other feature's are not."""
    per = files.groupBy("feature").agg(F.min(is_test.cast("int")).alias("all_tests"))
    other = per.agg(F.min("all_tests").alias("some"))
    return per.crossJoin(F.broadcast(other)).where("all_tests = 1 and some = 0").select("feature")  # one row on the right


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """current with changes put in: of each key the change that is last by order, else the current row. Both have the same columns."""
    rest = [c for c in current.columns if c not in keys]
    rows = current.withColumn("_new", F.lit(0)).unionByName(changes.select(current.columns).withColumn("_new", F.lit(1)))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", order)).alias("r"))
    return best.select(*keys, "r.*").select(current.columns)


def pruned(rows: DataFrame, keep: DataFrame, cited: DataFrame, key: str) -> DataFrame:
    """rows whose key is in keep, or in cited (what kept things refer to)."""
    return rows.join(keep.select(key).union(cited.select(key)).distinct(), key, "left_semi")


def oldest_match(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, id) of the oldest of rows(id, at, keys array) that shares a key with asked(query_id, keys array); ties by id.

    Each key's oldest row is found before queries meet it, so a key that many ask for and many hold costs its rows, not its pairs."""
    a = asked.select("query_id", F.explode(F.array_distinct("keys")).alias("key"))
    r = rows.select("id", "at", F.explode(F.array_distinct("keys")).alias("key"))
    oldest = r.groupBy("key").agg(F.min(F.struct("at", "id")).alias("m"))
    return a.join(oldest, "key").groupBy("query_id").agg(F.min("m").alias("m")).select("query_id", "m.id")


def swept_leases(jobs: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """jobs(job, status, attempt, lease_until) after expired leases were looked at: back in the queue with one attempt more, or failed after the last."""
    late = (F.col("status") == "running") & F.col("lease_until").isNotNull() & (F.col("lease_until") <= now)
    spent = F.col("attempt") >= most
    status = F.when(late & spent, "failed").when(late, "queued").otherwise(F.col("status"))
    attempt = F.when(late & ~spent, F.col("attempt") + 1).otherwise(F.col("attempt"))
    return jobs.withColumns({"status": status, "attempt": attempt, "lease_until": F.when(~late, F.col("lease_until"))})


def heartbeats(jobs: DataFrame, beats: DataFrame, lease: str) -> DataFrame:
    """(job, attempt, at, step, outcome) of beats(job, attempt, at, step) against jobs(job, status, attempt, step, lease_until): what each
    alone would do. Only the attempt that runs may renew its lease, before it ends, and never at an earlier step. lease: an interval."""
    j = jobs.select("job", F.col("status").alias("_s"), F.col("attempt").alias("_a"), F.col("step").alias("_step"), F.col("lease_until").alias("_until"))
    out = beats.join(j, "job", "left")
    verdict = (
        F.when(F.col("_s").isNull() | (F.col("_s") != "running"), "invalid").when(F.col("_a") != F.col("attempt"), "stale attempt")
        .when(F.col("at") > F.col("_until"), "lease expired").when(F.col("step") < F.col("_step"), "invalid").otherwise("renewed")
    )
    return out.select(*beats.columns, verdict.alias("outcome"), F.when(verdict == "renewed", F.col("at") + F.expr(f"interval {lease}")).alias("lease_until"))


def first_parent_path(parents: DataFrame, start, stop=None, max_rounds: int = 40) -> DataFrame:
    """(sha, place) of the commits from start down its first parents, place from 0, to the one before stop (or the root), from parents(sha, first_parent).

    Pointer doubling: a round doubles how far each commit on the path looks ahead, so a history of a million commits takes twenty.
    Its joins are never by broadcast: keys in a row take few bytes in a file, and many more in the driver."""
    from veinstone.operators.lineage import written

    spark = parents.sparkSession
    hop = written(parents.where("sha is not null and first_parent is not null").groupBy("sha").agg(F.min("first_parent").alias("to")))
    path = written(spark.range(1).select(F.lit(start).alias("sha"), F.lit(0).cast("long").alias("place")))
    n = 1
    for _ in range(max_rounds):
        more = path.join(hop.hint("merge"), "sha").select(F.col("to").alias("sha"), (F.col("place") + n).alias("place"))
        path = written(path.union(more))
        if path.count() < 2 * n:
            break
        hop, n = written(hop.join(hop.toDF("to", "next").hint("merge"), "to").select("sha", F.col("next").alias("to"))), 2 * n
    if stop is None:
        return path
    end = path.where(F.col("sha") == F.lit(stop)).agg(F.min("place").alias("_end"))
    return path.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (F.col("place") < F.col("_end"))).drop("_end")  # one row on the right


def merge_bases(edges: DataFrame, a, b) -> DataFrame:
    """(node): common ancestors of two commits (themselves included) that no other common ancestor descends to, from edges(node, parent)."""
    from veinstone.operators.graph import reachable

    one = lambda x: edges.sparkSession.range(1).select(F.lit(x).alias("node"))
    both = reachable(edges, one(a)).join(reachable(edges, one(b)), "node", "left_semi")
    under = edges.join(both, "node", "left_semi").select(F.col("parent").alias("node")).distinct()
    return both.join(under, "node", "left_anti")


def through_redirects(edges: DataFrame, targets: DataFrame, limit: int = 80) -> DataFrame:
    """(a, b, weight) of the heaviest pairs of features, a < b, once edges(src, dst, weight) follow targets(id, target)."""
    t = targets.select("id", "target")
    out = edges.join(t.toDF("src", "_s"), "src", "left").join(t.toDF("dst", "_d"), "dst", "left")
    out = out.select(F.coalesce("_s", "src").alias("s"), F.coalesce("_d", "dst").alias("d"), "weight").where("s <> d")
    return out.groupBy(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).agg(F.sum("weight").alias("weight")).orderBy(F.col("weight").desc(), "a", "b").limit(limit)


def heaviest_subgraph(edges: DataFrame, nodes: int = 40, most: int = 80) -> DataFrame:
    """(src, dst, weight): of edges(src, dst, weight) the heaviest `most` among the heaviest `nodes` nodes, ties by name."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("w"))
    top = ends.orderBy(F.col("w").desc(), "node").limit(nodes).select("node")
    held = edges.join(F.broadcast(top.toDF("src")), "src", "left_semi").join(F.broadcast(top.toDF("dst")), "dst", "left_semi")
    return held.orderBy(F.col("weight").desc(), "src", "dst").limit(most)


def likeliest_feature(edges: DataFrame, membership: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, feature, weight): for wanted(path, feature), the candidate that shares most edge weight with the path; ties by the smaller name."""
    both = edges.select(F.col("a").alias("path"), F.col("b").alias("other"), "weight").union(edges.select(F.col("b").alias("path"), F.col("a").alias("other"), "weight"))
    near = both.join(membership.select(F.col("path").alias("other"), "feature"), "other").groupBy("path", "feature").agg(F.sum("weight").alias("weight"))
    told = wanted.select("path", "feature").distinct().join(near, ["path", "feature"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    best = told.groupBy("path").agg(F.min(F.struct((-F.col("weight")).alias("w"), "feature")).alias("m"))
    return best.select("path", "m.feature", (-F.col("m.w")).alias("weight"))
