"""Top-k, newest-first, budgets, numbering and sampling over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by order; one partial maximum a key, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*")


def within_budget(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """Rows taken in order while their costs add up to at most budget; after the first that does not fit none is taken."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    so_far = df.withColumn("spent", F.sum(cost).over(w))
    return so_far.withColumn("over", F.max((F.col("spent") > budget).cast("int")).over(w)).where("over = 0").drop("over")


def first_appearance(df: DataFrame, keys: list[str], position: str, ref: str) -> DataFrame:
    """df with number (dense, by first appearance of ref within keys) and occurrence (0, 1, ... of that ref)."""
    first = df.groupBy(*keys, ref).agg(F.min(position).alias("_first"))
    first = first.withColumn("number", F.dense_rank().over(W.partitionBy(*keys).orderBy("_first", ref)))
    out = df.join(first, [*keys, ref])
    return out.withColumn("occurrence", F.row_number().over(W.partitionBy(*keys, ref).orderBy(position)) - 1).drop("_first")


def round_robin(df: DataFrame, group: str, key: Column, n: int) -> DataFrame:
    """n rows, one of each group in turn, each group in the order of a hash of key."""
    hashed = df.withColumn("h", F.substring(F.sha2(key, 256), 1, 16))
    picked = hashed.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy("h"))).where(F.col("turn") <= n)
    return picked.orderBy("turn", group).limit(n)


def at_most(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Rows whose value is their key's greatest, ties included."""
    return df.withColumn(name, F.rank().over(W.partitionBy(*keys).orderBy(F.col(value).desc()))).where(F.col(name) == 1).drop(name)
