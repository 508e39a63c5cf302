"""Bounded samples of rows, of the same kind at every size of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sampled(rows: DataFrame, most: int, by: list[str], group: Column | None = None, seed: int = 7) -> DataFrame:
    """At most `most` rows of each group (of all without a group): those with the smallest hashes of the columns `by`.

    Rows that agree in all of `by` count as one, whichever of them is met, so copies of one row, be they a third of the table, take one
    place. Where there are rows there is a sample: hashes are first cut off at a share that is sure to leave enough of
    an estimated number of distinct rows, as a fraction of 64 bits, then the smallest are taken exactly. Only rows
    below the cut are shuffled, some `most` a group. The number of groups must be small: it reaches the driver.
    """
    columns = rows.columns
    told = rows.withColumns({"_place": F.xxhash64(F.lit(seed), *by), "_group": F.lit(0) if group is None else group})
    counts = told.groupBy("_group").agg(F.approx_count_distinct("_place", 0.02).alias("n")).collect()
    if not counts:
        return rows.limit(0)
    below = [(r["_group"], min(1.0, 1.3 * (most + 50) / max(1, r["n"]))) for r in counts]
    cut = F.lit(None).cast("double")
    for value, share in below:
        cut = F.when(F.col("_group").eqNullSafe(F.lit(value)), F.lit(share)).otherwise(cut)
    # a hash as a number from 0 to 1, to 53 bits
    part = F.col("_place").cast("double") / float(2**64) + 0.5
    few = told.where(part <= cut)
    # the hash up to which a group's sample reaches; only hashes are ranked
    ranked = few.select("_group", "_place").distinct().withColumn("_rank", F.row_number().over(W.partitionBy("_group").orderBy("_place")))
    last = F.lit(None).cast("long")
    for r in ranked.where(F.col("_rank") <= most).groupBy("_group").agg(F.max("_place").alias("last")).collect():
        last = F.when(F.col("_group").eqNullSafe(F.lit(r["_group"])), F.lit(r["last"])).otherwise(last)
    return few.where(F.col("_place") <= last).dropDuplicates(["_group", "_place"]).select(*columns)
