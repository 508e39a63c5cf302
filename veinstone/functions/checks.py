"""Row constraints: each gives the array of what is wrong, empty if nothing is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.functions.text import repo_path_ok


def problems(*rules: tuple[Column, str]) -> Column:
    """Messages of the rules whose condition holds."""
    return F.array_compact(F.array(*[F.when(bad, message) for bad, message in rules]))


def claim_text(text: Column, most: int = 600) -> Column:
    return problems(
        (F.coalesce(F.trim(text), F.lit("")) == "", "empty"),
        (F.length(text) > most, "too long"),
        (text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), "control character"),
        (text.rlike(r"<[A-Za-z/!]"), "markup"),
        (text.rlike(r"\b[\w./-]+:[0-9]+-[0-9]+\b"), "citation in the text"),
    )


def citation(path: Column, start: Column, stop: Column, content_hash: Column, most: int = 120) -> Column:
    return problems(
        (~F.coalesce(repo_path_ok(path), F.lit(False)), "bad path"),
        (F.coalesce(start < 1, F.lit(True)) | F.coalesce(stop < start, F.lit(True)), "bad lines"),
        (stop - start + 1 > most, "too many lines"),
        (~F.coalesce(content_hash.rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad hash"),
    )


def alias(text: Column) -> Column:
    return problems((F.length(F.trim(text)) < 2, "too short"), (F.length(text) > 80, "too long"), (~text.rlike(r"\p{L}|\p{N}"), "no letter or digit"))


def document(claims: DataFrame) -> DataFrame:
    """(revision, problem) of claims(revision, section, pos, id, supports): lead first, ids unique, supports known, lead claims
    supported, body claims not."""
    lead_late = claims.groupBy("revision").agg(F.min_by("section", "pos").alias("s")).where("s <> 'lead'").select("revision", F.lit("lead is not first").alias("problem"))
    twice = claims.groupBy("revision", "id").count().where("count > 1").select("revision", F.concat(F.lit("id twice: "), "id").alias("problem"))
    named = claims.select("revision", F.explode("supports").alias("id"))
    body = claims.where("section <> 'lead'").select("revision", "id")
    unknown = named.join(body, ["revision", "id"], "left_anti").select("revision", F.concat(F.lit("unknown support: "), "id").alias("problem"))
    bare = claims.where("section = 'lead' and size(supports) = 0").select("revision", F.concat(F.lit("lead without support: "), "id").alias("problem"))
    extra = claims.where("section <> 'lead' and size(supports) > 0").select("revision", F.concat(F.lit("support in the body: "), "id").alias("problem"))
    return lead_late.union(twice).union(unknown).union(bare).union(extra)


def manifest(features: DataFrame, membership: DataFrame) -> DataFrame:
    """(feature, problem) of features(id, status, target) and membership(path, feature): unique ids, redirects that lead to
    an active feature, members only of active ones."""
    from veinstone.operators.graph import final_targets

    twice = features.groupBy("id").count().where("count > 1").select(F.col("id").alias("feature"), F.lit("id twice").alias("problem"))
    active = features.where("status = 'active'").select("id").distinct()
    ends = final_targets(features.where("status = 'redirect'").select("id", "target"))
    loops = ends.where("state = 'cycle'").select(F.col("id").alias("feature"), F.lit("redirect cycle").alias("problem"))
    lost = ends.where("state = 'done'").join(active.withColumnRenamed("id", "target"), "target", "left_anti").select(F.col("id").alias("feature"), F.lit("redirect to nothing").alias("problem"))
    idle = membership.select(F.col("feature").alias("id")).distinct().join(active, "id", "left_anti").select(F.col("id").alias("feature"), F.lit("members of an inactive feature").alias("problem"))
    return twice.union(loops).union(lost).union(idle)
