"""Who did what: activity, totals, features and lines by person, landed pull requests, display names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.functions.names import is_lockfile


def commit_sums(commits: DataFrame, files: DataFrame, sweep: int = 50) -> DataFrame:
    """commits(sha, merge, ...) that are no merges, with added and deleted lines over files(sha, path, added, deleted).

    Lock files and files without counts (binary ones) add nothing, nor do commits of more than sweep files."""
    n = files.groupBy("sha").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.when(~is_lockfile(F.col("path")) & F.col("added").isNotNull() & F.col("deleted").isNotNull(), F.col(c)).otherwise(F.lit(0))).alias(f"_{c}") for c in ("added", "deleted")],
    )
    out = commits.where(~F.col("merge")).join(n, "sha", "left")
    counts = lambda c: F.when(F.col("_n") <= sweep, F.col(f"_{c}")).otherwise(F.lit(0)).cast("long").alias(c)
    return out.select(*commits.columns, counts("added"), counts("deleted"))


def activity(sums: DataFrame, excluded: DataFrame, least: int = 2) -> DataFrame:
    """(person, day, commits, added, deleted) from commit_sums' (person, day, added, deleted), people in excluded(person) as 'others',
    if at least so many of them have a commit, else left out. Rows without person or day are no activity."""
    known = sums.where("person is not null").join(excluded.select("person").distinct().withColumn("_out", F.lit(True)), "person", "left")
    many = known.where("_out").agg(F.countDistinct("person").alias("_many"))
    named = known.crossJoin(F.broadcast(many)).where(F.col("_out").isNull() | (F.col("_many") >= least))  # one row on the right
    person = F.when(F.col("_out"), "others").otherwise(F.col("person"))
    return named.where("day is not null").groupBy(person.alias("person"), "day").agg(F.count(F.lit(1)).alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def totals(sums: DataFrame, co_authors: DataFrame) -> DataFrame:
    """(person, commits, added, deleted, co_authored) from commit_sums' (sha, person, added, deleted) and co_authors(sha, person): each
    person that a commit's trailers name, once a commit, never its author."""
    own = sums.where("person is not null").groupBy("person").agg(F.count(F.lit(1)).alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    named = co_authors.where("person is not null").select("sha", F.col("person").alias("named")).distinct()
    helped = named.join(sums.select("sha", "person"), "sha").where(~F.col("named").eqNullSafe(F.col("person"))).groupBy(F.col("named").alias("person")).agg(F.count(F.lit(1)).alias("co_authored"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.join(helped, "person", "full_outer").select("person", *[zero(c) for c in ("commits", "added", "deleted", "co_authored")])


def feature_shares(sums: DataFrame, touched: DataFrame, lines: DataFrame) -> DataFrame:
    """(person, feature, commits, lines, rank) from commits, touched(sha, feature) and current lines(person, feature, n); rank by lines, commits, name."""
    by_commit = sums.select("sha", "person").join(touched.select("sha", "feature").distinct(), "sha").groupBy("person", "feature").agg(F.count(F.lit(1)).alias("commits"))
    by_line = lines.groupBy("person", "feature").agg(F.sum("n").alias("lines"))
    both = by_commit.join(by_line, ["person", "feature"], "full_outer").where("person is not null and feature is not null")
    both = both.select("person", "feature", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("commits", "lines")]).where("commits + lines > 0")
    return both.withColumn("rank", F.row_number().over(W.partitionBy("person").orderBy(F.col("lines").desc(), F.col("commits").desc(), "feature")))


def contributors(lines: DataFrame, limit: int = 5) -> DataFrame:
    """(feature, person, n, share, more) of the people with most of a feature's lines(feature, person, n); more counts those left out."""
    per = lines.where("person is not null").groupBy("feature", "person").agg(F.sum("n").alias("n")).where("n > 0")
    w = W.partitionBy("feature")
    ranked = per.withColumn("_r", F.row_number().over(w.orderBy(F.col("n").desc(), "person")))
    whole = per.groupBy("feature").agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_people"))
    return ranked.where(F.col("_r") <= limit).join(whole, "feature").select("feature", "person", "n", (F.col("n") / F.col("_all")).alias("share"), F.greatest(F.col("_people") - limit, F.lit(0)).alias("more"))


def display_names(pairs: DataFrame) -> DataFrame:
    """(person, name) from pairs(person, name, proper, commits, first): the most used proper name, else the most used of two words or
    more, else the most used; ties by the earlier first use, then the smaller name. Empty names never."""
    said = pairs.where("name <> ''").groupBy("person", "name").agg(*[F.sum(F.when(c, F.col("commits"))).alias(f"n{i}") for i, c in enumerate(_tiers())], *[F.min(F.when(c, F.col("first"))).alias(f"f{i}") for i, c in enumerate(_tiers())])
    tier = F.array(*[F.when(F.col(f"n{i}").isNotNull(), F.struct(F.lit(i).alias("tier"), (-F.col(f"n{i}")).alias("n"), F.col(f"f{i}").alias("first"), F.col("name").alias("name"))) for i in range(3)])
    return said.select("person", F.explode(F.array_compact(tier)).alias("t")).groupBy("person").agg(F.min("t").alias("t")).select("person", "t.name")


def _tiers():
    return F.col("proper"), F.size(F.split("name", " ")) >= 2, F.lit(True)


def landings(commits: DataFrame) -> DataFrame:
    """(pr, sha, at, merge) of the newest commit that lands each pull request, from commits(sha, pr, merge, at)."""
    return commits.where("pr is not null").groupBy("pr").agg(F.max(F.struct("at", "sha", "merge")).alias("m")).select("pr", "m.sha", "m.at", "m.merge")
