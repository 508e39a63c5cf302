"""Mixing sources to target weights: repetition rates by source, whole copies and one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.operators.lineage import written

WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many sources is sent to all executors; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: How many draws of a document there are to choose from, and the hex digits of each.
DRAWS, DIGITS = 48, 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from docs' (source, size).

    Sources by code point, null last, weigh weights in turn. They share budget times all sizes by
    weight; a share above cap times the source's size stops there and the excess goes to the
    others by weight, until none is above. In closed form: by rising cap over weight, the stopped
    sources are a prefix; a source stops if what is left at its place, shared by the weights from
    it on, exceeds its cap. Only the table of sources, five numbers and a name each, is ordered, in one task, after the
    sizes were added up: some ten million sources are meant to be the most.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    rise = W.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before, after = rise.rowsBetween(W.unboundedPreceding, -1), rise.rowsBetween(0, W.unboundedFollowing)
    per = (
        per.withColumn("pool", F.lit(float(budget)) * F.sum("source_size").over(every))
        .withColumn("left", F.col("pool") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("heavy", F.sum("weight").over(after))
        .withColumn("stops", F.col("left") * F.col("weight") / F.col("heavy") > F.col("most"))
    )
    # the prefix ends at the first source that doesn't stop
    per = per.withColumn("stops", F.min(F.col("stops").cast("int")).over(rise.rowsBetween(W.unboundedPreceding, 0)) == 1)
    first = F.first(F.when(~F.col("stops"), F.col("left") / F.col("heavy")), ignorenulls=True).over(rise.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    per = per.withColumn("level", first)
    return per.select("source", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, seed: int = 20240229) -> DataFrame:
    """docs with size, source_size, target, rate, draw and copies added (columns of these names are replaced).

    rate is target over source_size; a row is taken floor(rate) times, and once more if its draw, a number in [0, 1),
    is below the rest of the rate. SHA-256 of seed:doc_id holds DRAWS numbers for each row, DIGITS hex digits from the first, the
    second digit on and so forth; each source uses those by which its taken words come nearest its target (ties: the first), so
    that long documents don't throw small sources off. Reruns agree. An empty source has rate 0. A null source is a
    source of its own. Repeated rows of one doc_id are taken alike; rows without doc_id are told apart by the SHA-256 of their texts.
    """
    drop = [c for c in ("size", "source_size", "target", "rate", "draw", "copies") if c in docs.columns]
    sized = docs.drop(*drop).withColumn("size", n_words(F.col("text")))
    targets = source_targets(sized.select("source", "size"), weights, budget, cap)
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    most = F.floor((F.col("rate") - F.floor("rate")) * float(16**DIGITS)).cast("long")
    targets = written(targets.withColumn("_below", F.lower(F.lpad(F.hex(most), DIGITS, "0"))).withColumnRenamed("source", "_source_of"))
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = F.broadcast if few else (lambda x: x)
    token = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))

    def extra(k: int, below: Column) -> Column:
        return F.substring("_digits", k, DIGITS) < below

    known = F.col("source").eqNullSafe(F.col("_source_of"))
    drawn = sized.select("source", "size", F.sha2(token, 256).alias("_digits")).join(side(targets), known)
    sums = drawn.groupBy("_source_of").agg(*[F.sum(F.when(extra(k, F.col("_below")), F.col("size")).otherwise(F.lit(0))).alias(f"s{k}") for k in range(1, DRAWS + 1)])
    sums = sums.join(side(targets).toDF(*[f"t_{c}" for c in targets.columns]), F.col("_source_of").eqNullSafe(F.col("t__source_of")))
    off = lambda k: F.abs(F.floor("t_rate") * F.col("t_source_size") + F.col(f"s{k}") - F.col("t_target"))
    best = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("k")) for k in range(1, DRAWS + 1)]))["k"]
    chosen = written(sums.select("_source_of", F.col("t_source_size").alias("source_size"), F.col("t_target").alias("target"), F.col("t_rate").alias("rate"), F.col("t__below").alias("_below"), best.alias("draw")))
    out = sized.withColumn("_digits", F.sha2(token, 256)).join(side(chosen), known, "left")
    more = F.substring(F.col("_digits"), F.col("draw"), F.lit(DIGITS)) < F.col("_below")
    return out.withColumn("copies", F.floor("rate").cast("long") + more.cast("long")).drop("_digits", "_source_of", "_below")
