"""Calendar buckets, dense spines, adaptive grains and top series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")


def bucket(day: Column, grain: str) -> Column:
    """First day of the day, Monday week, month, quarter or year."""
    return F.trunc(day, grain) if grain != "day" else day.cast("date")


def spine(first: Column, last: Column, grain: str) -> Column:
    """Array of all buckets from first's to last's."""
    step = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}[grain]
    return F.sequence(bucket(first, grain), bucket(last, grain), F.expr(f"interval {step}"))


def dense_counts(df: DataFrame, day: str, grain: str) -> DataFrame:
    """(bucket, n): rows in each bucket from the first to the last, zeros kept."""
    counts = df.where(F.col(day).isNotNull()).groupBy(bucket(F.col(day), grain).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).select(F.explode(spine(F.col("lo"), F.col("hi"), grain)).alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def finest_grain(df: DataFrame, keys: list[str], day: str, limit: int) -> DataFrame:
    """keys, grain: the finest with at most limit distinct buckets, else span."""
    counts = [F.countDistinct(bucket(F.col(day), g)).alias(f"n_{g}") for g in GRAINS]
    chosen = F.lit("span")
    for g in reversed(GRAINS):
        chosen = F.when(F.col(f"n_{g}") <= limit, g).otherwise(chosen)
    return df.where(F.col(day).isNotNull()).groupBy(*keys).agg(*counts).select(*keys, chosen.alias("grain"))


def top_series(df: DataFrame, bucket_col: str, who: str, k: int) -> DataFrame:
    """(bucket, series, n): the k most active by total (ties: smaller who) by name, all others as Others."""
    per = df.groupBy(bucket_col, who).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy(who).agg(F.sum("n").alias("total"))
    best = total.orderBy(F.col("total").desc(), who).limit(k).select(who, F.col(who).cast("string").alias("series"))
    named = per.join(best, who, "left").select(bucket_col, F.coalesce("series", F.lit("Others")).alias("series"), "n")
    return named.groupBy(bucket_col, "series").agg(F.sum("n").alias("n"))


def busiest_period(df: DataFrame, keys: list[str], day: str, grain: str) -> DataFrame:
    """keys, period, n: the bucket with most rows, the earlier on a tie."""
    per = df.groupBy(*keys, bucket(F.col(day), grain).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("n").desc(), "period"))).where("rank = 1").drop("rank")
