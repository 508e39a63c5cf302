"""Freshness of line-range citations after a change of the repository, and what an update has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.operators.ranges import remapped


def citation_status(citations: DataFrame, changes: DataFrame) -> DataFrame:
    """citations(claim, path, start, stop) with status, new_path, new_start, new_stop.

    changes(old_path, new_path, status, hunks) between the two commits. An untouched file's citation is
    fresh as it is; in a changed file it moves with the lines, and is stale if an edit touches them or the file is gone.
    """
    c = changes.select(F.col("old_path").alias("path"), F.col("new_path").alias("to"), F.col("status").alias("how"), "hunks").where("path is not null")
    j = citations.join(c, "path", "left")
    moved = F.when(F.col("how").isNull(), F.struct(F.col("start").alias("start"), F.col("stop").alias("stop"))).when(F.col("how") != "deleted", remapped(F.col("start"), F.col("stop"), F.col("hunks")))
    j = j.withColumn("moved", moved)
    fresh = F.col("moved").isNotNull()
    return j.select(
        "claim", "path", "start", "stop", F.when(fresh, "fresh").otherwise("stale").alias("status"), F.when(fresh, F.coalesce("to", "path")).alias("new_path"),
        F.col("moved.start").alias("new_start"), F.col("moved.stop").alias("new_stop"), F.col("how").isNotNull().alias("touched"),
    )


def claim_status(claims: DataFrame, statuses: DataFrame) -> DataFrame:
    """(claim, status): stale if a citation is, stale-kept if it was stale before and no cited file is touched, else fresh; a
    claim with supports is stale if one of those is. claims(claim, stale_since, supports array)."""
    own = statuses.groupBy("claim").agg(F.max((F.col("status") == "stale").cast("int")).alias("bad"), F.max(F.col("touched").cast("int")).alias("hit"))
    j = claims.join(own, "claim", "left")
    first = F.when(F.col("stale_since").isNotNull() & (F.coalesce("hit", F.lit(0)) == 0), "stale-kept").when(F.col("bad") == 1, "stale").otherwise("fresh")
    body = j.select("claim", "supports", first.alias("status"))
    below = body.select("claim", F.explode("supports").alias("s")).join(body.select(F.col("claim").alias("s"), F.col("status").alias("of")), "s").groupBy("claim").agg(F.max((F.col("of") == "stale").cast("int")).alias("under"))
    return body.join(below, "claim", "left").select("claim", F.when(F.col("under") == 1, "stale").otherwise(F.col("status")).alias("status"))


def update_plan(pages: DataFrame, dirty: DataFrame, moved: DataFrame) -> DataFrame:
    """(feature, fate): rewrite where a claim is stale, whole where the members changed, carried else."""
    from veinstone.operators.integrity import partitioned

    return partitioned(pages, dirty, moved, "feature")
