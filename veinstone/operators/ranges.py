"""Interval joins through buckets, and shifting line ranges through edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int = 128, contains: bool = False) -> DataFrame:
    """left ⋈ right on keys where [start, stop] overlap (contains: where right's range holds left's), stops inclusive.

    left has keys, start, stop; right has keys, r_start, r_stop; other columns must differ. A range's level is the least n for
    which it is no longer than width * 2^n, so in buckets of that width it touches at most two, however long it is. Two ranges
    meet in the buckets of the higher of their levels: each is dealt to its own level's buckets and to those of the levels above that the other
    side has, and joined by equality on (keys, level, bucket). A pair counts only in the first bucket that both touch,
    so nothing has to be made distinct. No nested loop at any size.
    """
    size = lambda n: F.lit(width) * F.expr(f"shiftleft(1L, {n})")
    level = lambda a, b: F.greatest(F.ceil(F.log2((F.col(b) - F.col(a) + 1) / width)), F.lit(0)).cast("int")
    x = left.where("start is not null and stop >= start").withColumn("_own", level("start", "stop"))
    y = right.where("r_start is not null and r_stop >= r_start").withColumn("_own", level("r_start", "r_stop"))
    # at most some fifty levels, whatever the ranges
    has_x, has_y = (sorted(r["_own"] for r in z.select("_own").distinct().collect()) for z in (x, y))

    def dealt(z: DataFrame, a: str, b: str, above: list[int], same: int) -> DataFrame:
        """With tag: the level, and whether it is the right side's (0) or the left's own (1)."""
        up = F.transform(F.filter(F.array(*map(F.lit, above)).cast("array<int>"), lambda n: n > F.col("_own")), lambda n: F.struct(n.alias("n"), F.lit(1 - same).alias("of")))
        own = F.array(F.struct(F.col("_own").alias("n"), F.lit(same).alias("of")))
        if same:  # equal levels meet as the right side's
            own = F.concat(own, F.array(F.struct(F.col("_own").alias("n"), F.lit(0).alias("of"))))
        z = z.withColumn("_tag", F.explode(F.concat(own, up)))
        cell = lambda c: F.floor(F.col(c) / size("_tag.n"))
        return z.withColumn("_bucket", F.explode(F.sequence(cell(a), cell(b)))).drop("_own")

    both = dealt(x, "start", "stop", has_y, 1).join(dealt(y, "r_start", "r_stop", has_x, 0), [*keys, "_tag", "_bucket"]).where("start <= r_stop and r_start <= stop")
    both = both.where(F.col("_bucket") == F.floor(F.greatest("start", "r_start") / size("_tag.n"))).drop("_bucket", "_tag")
    return both.where("r_start <= start and r_stop >= stop") if contains else both


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], by: list[str], width: int = 128) -> DataFrame:
    """For each of points (keys, start, stop and by, which tell points apart), the tightest of spans (keys, r_start, r_stop, name)
    that holds it: the shortest, then the later start, then the smaller name. Points without one are absent."""
    held = overlaps(points, spans, keys, width, contains=True)
    best = F.min(F.struct((F.col("r_stop") - F.col("r_start")).alias("size"), (-F.col("r_start")).alias("back"), F.col("name"))).alias("best")
    return held.groupBy(*by).agg(best).select(*by, F.col("best.name").alias("name"), F.col("best.size").alias("size"))


def uncovered(spans: DataFrame, covers: DataFrame, keys: list[str], by: list[str], width: int = 128) -> DataFrame:
    """Those of spans (keys, start, stop, by) that none of covers (keys, r_start, r_stop) overlaps."""
    hit = overlaps(spans, covers, keys, width).select(*by).distinct()
    return spans.join(hit, by, "left_anti")


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of one value in order: keys, run (from 1), value, first and last of order[0], n."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n"))


def remapped(start: Column, stop: Column, hunks: Column) -> Column:
    """struct(start, stop) of a line range after an edit, null if a hunk touches it.

    hunks: array of struct(old_start, old_count, new_start, new_count), zero context, ascending. A hunk wholly above moves the range
    by its growth, one behind leaves it; an insertion (old_count 0) stands after its line old_start.
    """
    zero = F.struct(F.lit(0).cast("long").alias("shift"), F.lit(False).alias("hit"))

    def step(acc: Column, h: Column) -> Column:
        insert = h["old_count"] == 0
        above = F.when(insert, h["old_start"] < start).otherwise(h["old_start"] + h["old_count"] - 1 < start)
        behind = F.when(insert, h["old_start"] >= stop).otherwise(h["old_start"] > stop)
        shift = F.when(above, acc["shift"] + (h["new_count"] - h["old_count"]).cast("long")).otherwise(acc["shift"])
        return F.struct(shift.alias("shift"), (acc["hit"] | (~above & ~behind)).alias("hit"))

    done = F.aggregate(hunks, zero, step)
    return F.when(~done["hit"], F.struct((start + done["shift"]).alias("start"), (stop + done["shift"]).alias("stop")))
