"""Versioned append tables: the newest version by key, compare-and-set appends, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.operators.topk import latest


def current(revisions: DataFrame, key: str = "feature") -> DataFrame:
    """Each key's newest row of revisions(key, seq, ...)."""
    return latest(revisions, [key], ["seq"])


def history(revisions: DataFrame, key: str, value) -> DataFrame:
    return revisions.where(F.col(key) == value).orderBy(F.col("seq").desc())


def checked_append(revisions: DataFrame, new: DataFrame, key: str = "feature") -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of new(key, parent, seq, ...): a row is accepted if its parent is the key's newest seq, or null where
    there is none. Of several for one key in one batch only the smallest seq can be."""
    head = revisions.groupBy(key).agg(F.max("seq").alias("_head"))
    first = new.groupBy(key).agg(F.min("seq").alias("_first"))
    j = new.join(head, key, "left").join(first, key)
    ok = F.col("parent").eqNullSafe(F.col("_head")) & (F.col("seq") == F.col("_first"))
    return j.where(ok).drop("_head", "_first"), j.where(~ok).drop("_head", "_first")


def final_feature(manifests: DataFrame, redirects: DataFrame) -> DataFrame:
    """(path, feature): by the newest of manifests(seq, path, feature) that holds the path, then through redirects(id, target)."""
    from veinstone.operators.graph import final_targets

    newest = manifests.groupBy("path").agg(F.max_by("feature", "seq").alias("feature"))
    to = final_targets(redirects).where("state = 'done'").select(F.col("id").alias("feature"), "target")
    return newest.join(to, "feature", "left").select("path", F.coalesce("target", "feature").alias("feature"))
