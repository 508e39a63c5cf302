"""Three-way merges of line edits, and what a merge would do to cited ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.operators.ranges import overlaps


def _gaps(edits: DataFrame) -> DataFrame:
    """Edits as ranges of gaps between lines: one that replaces lines a to b spans the gaps before a to behind b, an insertion its gap alone."""
    first = F.when(F.col("old_count") == 0, F.col("old_start")).otherwise(F.col("old_start") - 1)
    return edits.withColumns({"start": first, "stop": first + F.col("old_count")})


def merged_edits(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old_start, old_count, lines, side, conflict) of all edits of one base by two sides.

    ours and theirs: keys, old_start, old_count (0: inserted behind line old_start), lines (array). Edits of two sides conflict where they
    overlap or touch, unless they are one and the same, which then counts once with side both. The edits of a side don't touch each other. Edits meet by an interval
    join, so a file's edits are never compared pair by pair.
    """
    what = [*keys, "old_start", "old_count", "lines"]
    one, two = ours.select(*what).distinct(), theirs.select(*what).distinct()
    side = F.when(F.size("sides") == 2, "both").otherwise(F.col("sides")[0])
    every = one.withColumn("side", F.lit("ours")).union(two.withColumn("side", F.lit("theirs"))).groupBy(*what).agg(F.collect_set("side").alias("sides")).select(*what, side.alias("side"))
    spans = _gaps(every)
    # an edit both made meets neither side's others, as those don't touch it
    left = spans.where("side <> 'theirs'").select(*keys, "start", "stop", F.col("side").alias("left_side"))
    right = spans.where("side <> 'ours'").select(*keys, F.col("start").alias("r_start"), F.col("stop").alias("r_stop"), F.col("side").alias("right_side"))
    met = overlaps(left, right, keys).where("left_side <> 'both' or right_side <> 'both'")
    place = F.array(F.struct("start", "stop", F.col("left_side").alias("side")), F.struct(F.col("r_start").alias("start"), F.col("r_stop").alias("stop"), F.col("right_side").alias("side")))
    hit = met.select(*keys, F.explode(place).alias("p")).select(*keys, "p.*").distinct().withColumn("conflict", F.lit(True))
    return spans.join(hit, [*keys, "start", "stop", "side"], "left").select(*what, "side", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def merge_states(edits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state, ours, theirs) of merged_edits: conflicts, clean (both sides edited), ours or theirs (only that one), same (both alike), and the numbers of edits of each side."""
    n = lambda *sides: F.count(F.when(F.col("side").isin(*sides), 1))
    one, two, both = n("ours"), n("theirs"), n("both")
    state = F.when(F.max(F.col("conflict").cast("int")) == 1, "conflicts").when((one > 0) & (two > 0), "clean").when(one > 0, "ours").when(two > 0, "theirs").otherwise("same")
    return edits.groupBy(*keys).agg(state.alias("state"), (one + both).alias("ours"), (two + both).alias("theirs"))


def placed_edits(edits: DataFrame, keys: list[str]) -> DataFrame:
    """The edits of files without conflict with new_start, the first line (for a deletion, the line before) in the merged file, and new_count."""
    clean = edits.join(merge_states(edits, keys).where("state <> 'conflicts'").select(*keys), keys, "left_semi")
    grown = F.size("lines") - F.col("old_count")
    # at one place an insertion stands before an edit of the lines behind it
    before = F.coalesce(F.sum(grown).over(W.partitionBy(*keys).orderBy("old_start", "old_count").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = F.size("lines")
    first = F.when(F.col("old_count") == 0, F.col("old_start") + 1).otherwise(F.col("old_start"))
    return clean.select(*keys, "old_start", "old_count", "lines", "side", (first + before - F.when(n == 0, 1).otherwise(0)).cast("long").alias("new_start"), n.cast("long").alias("new_count"))


def pull_states(pulls: DataFrame, states: DataFrame) -> DataFrame:
    """(pull, merge, files, conflicts) of pulls(pull, behind): unknown where the base the pull forked from is not in our history (behind), conflicts if
    any of its files' states(pull, path, state) is one, else clean."""
    per = states.groupBy("pull").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("state") == "conflicts", 1)).alias("conflicts"))
    out = pulls.join(per, "pull", "left")
    conflicts = F.coalesce("conflicts", F.lit(0))
    merge = F.when(F.col("behind"), "unknown").when(conflicts > 0, "conflicts").otherwise("clean")
    return out.select("pull", merge.alias("merge"), F.coalesce("files", F.lit(0)).alias("files"), conflicts.alias("conflicts"))


def merge_effects(pulls: DataFrame, edits: DataFrame, cites: DataFrame) -> DataFrame:
    """(pull, claim, certain): the claims of cites(claim, path, r_start, r_stop) that a pull would make stale.

    pulls(pull, merge), of pull_states; edits: merged_edits by pull and path. A clean pull's claim is stale for sure where an edit of its side touches a cited line, inserts
    between cited lines, too; of the others every claim on an edited file may be."""
    e = edits.where("side <> 'ours'").join(pulls.select("pull", "merge"), "pull")
    sure = e.where("merge = 'clean'")
    # an insertion lies between two lines, and touches only a range that holds both
    lines = sure.withColumns({"start": F.col("old_start"), "stop": F.when(F.col("old_count") == 0, F.col("old_start") + 1).otherwise(F.col("old_start") + F.col("old_count") - 1)})
    hit = overlaps(lines.select("pull", "path", "old_count", "start", "stop"), cites, ["path"])
    hit = hit.where("old_count > 0 or (r_start <= start and r_stop >= stop)").select("pull", "claim", F.lit(True).alias("certain"))
    rest = e.where("merge <> 'clean'").select("pull", "path").distinct().join(cites.select("path", "claim"), "path").select("pull", "claim", F.lit(False).alias("certain"))
    return hit.union(rest).distinct()
