"""Integrity checks and set algebra over keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.operators.lineage import written
from veinstone.operators.spreading import spread


def violations(rows: DataFrame, parents: DataFrame, key: str, problem: str) -> DataFrame:
    """(key, problem) of rows whose key no parent has; null keys refer to nothing and are fine."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti").select(key, F.lit(problem).alias("problem"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def partitioned(every: DataFrame, rewrites: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """(key, fate): rewrite if in rewrites, else whole if in whole, else carried."""
    marks = rewrites.select(key, F.lit(2).alias("m")).union(whole.select(key, F.lit(1).alias("m"))).groupBy(key).agg(F.max("m").alias("m"))
    fate = F.when(F.col("m") == 2, "rewrite").when(F.col("m") == 1, "whole").otherwise("carried")
    return every.select(key).distinct().join(marks, key, "left").select(key, fate.alias("fate"))


def same_members(one: DataFrame, two: DataFrame, keys: list[str]) -> bool:
    """Whether two tables hold the same sets of keys."""
    a, b = one.select(*keys).distinct(), two.select(*keys).distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def contained(sets: DataFrame, within: str, key: str, item: str) -> DataFrame:
    """(within, key, other): of sets(within, key, item), those that hold all items of another set of the same `within`.

    A set looks for its holders only where its rarest item occurs, so sets of common items alone meet many; each set fits a row. Sets are written, and dealt to
    tasks of one size."""
    rows = written(sets.select(within, key, item))
    rows = written(spread(rows, rows.count(), within, key).distinct())
    n = rows.count()
    often = spread(rows, n, within, item).groupBy(within, item).agg(F.count(F.lit(1)).alias("_n"))
    counted = spread(rows, n, within, item).join(often, [within, item])
    # sets with their rarest items
    whole = spread(counted, n, within, key).groupBy(within, key).agg(F.collect_set(item).alias("_items"), F.min(F.struct("_n", item)).alias("_m"))
    whole = written(whole.select(within, key, "_items", F.col(f"_m.{item}").alias("_rarest")))
    small = whole.select(within, F.col("_rarest").alias(item), F.col(key).alias("other"), F.col("_items").alias("_held"))
    each = whole.select(within, key, "_items", F.explode("_items").alias(item))
    met = spread(each, n, within, item).join(small, [within, item]).where(F.col(key) != F.col("other"))
    return met.where(F.size(F.array_except("_held", "_items")) == 0).select(within, key, "other")
