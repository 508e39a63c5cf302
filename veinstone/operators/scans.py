"""Grouping in order by rules that look at the group so far: where a group would end is known for every place it might begin, and only begun ones are followed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.operators.lineage import written

#: Rows of one key in a block: a block is summarised, and later numbered, in one task.
BLOCK = 4_096


def followed(jumps: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, pos) of the groups' beginnings: 0 and all that is reached from it through jumps(keys, pos, next), next > pos; positions count from 0 without gaps.

    Positions are parted into blocks. Within each, on its own, doubling finds for every place where the way from it leaves the block; these exits are followed from block to
    block by doubling too, so the places entered are known; from them doubling marks what is passed. Rounds grow with the logarithm of a key's rows, and a key's rows are shared by many tasks."""
    keyed = [*keys, "pos"]
    all_ = written(jumps.select(*keyed, "next", F.floor(F.col("pos") / block).alias("_block")))
    most = all_.agg(F.max("pos")).first()[0]
    if most is None:
        return jumps.select(*keyed)
    if int(most) < block:  # no key goes beyond its first block
        return _reached(all_.select(*keyed, "next"), keys, int(most) + 1)
    # strides inside blocks, until all have left theirs; keys of one block begin at 0 alone
    long = written(all_.where(F.col("pos") == block).select(*keys))
    exits = all_.join(long, keys, "left_semi").withColumn("_in", F.floor(F.col("next") / block) == F.col("_block")).select(*keyed, "next", "_block", "_in")
    for _ in range(max(1, block - 1).bit_length()):
        ahead = exits.select(*keys, F.col("pos").alias("next"), F.col("next").alias("_then"))
        exits = exits.join(ahead, [*keys, "next"], "left").select(*keyed, F.when(F.col("_in"), F.coalesce("_then", "next")).otherwise(F.col("next")).alias("next"), "_block")
        exits = written(exits.withColumn("_in", F.floor(F.col("next") / block) == F.col("_block")))
        if exits.where("_in").join(all_.select(*keys, F.col("pos").alias("next")), [*keys, "next"], "left_semi").isEmpty():
            break
    entered = _reached(exits.select(*keyed, "next"), keys, int(most) // block + 2).union(all_.where("pos = 0").select(*keyed)).distinct()
    return _reached(all_.select(*keyed, "next"), keys, block, entered)


def _reached(jumps: DataFrame, keys: list[str], steps: int, starts: DataFrame | None = None) -> DataFrame:
    """(keys, pos) reached from starts (from 0 without any) in fewer than so many steps: strides of 1, 2, 4, ..., each taken from all that is reached before."""
    keyed = [*keys, "pos"]
    there = jumps.select(*keyed)
    now = jumps.where("pos = 0").select(*keyed) if starts is None else starts.select(*keyed)
    stride = jumps
    for _ in range(max(1, steps).bit_length()):
        stepped = now.join(stride, keyed).select(*keys, F.col("next").alias("pos"))
        now = written(now.union(stepped.join(there, keyed, "left_semi")).distinct())
        ahead = stride.select(*keys, F.col("pos").alias("next"), F.col("next").alias("_then"))
        stride = written(stride.join(ahead, [*keys, "next"]).select(*keyed, F.col("_then").alias("next")))
        if stride.isEmpty():
            break
    return now


def paragraphs(claims: DataFrame, keys: list[str], order: list[str], length: Column, files: Column, chars: int = 550, orphan: int = 200, block: int = BLOCK) -> DataFrame:
    """claims with group, from 1 within keys: a section's claims in paragraphs.

    A group closes before a claim when it holds two already and either its lengths add up to `chars`, or the claim and the group both name files and share none. A last
    group of one claim shorter than `orphan` joins the one before it. length: a number a claim; files: an array, null or empty where it names none.

    Where a group that begins at a claim would close doesn't depend on what was before it: by length that is found by a window over running sums; a claim that shares no file with the one before it ends
    any group it might, if those between name the same. Such ends are sought step by step among claims that still go on, at most as many as a group is long."""
    w = W.partitionBy(*keys).orderBy(*order)
    taken = [c for c in claims.columns if c not in ("group",)]
    rows = claims.select(*taken).withColumns({"pos": (F.row_number().over(w) - 1).cast("long"), "_len": F.coalesce(length, F.lit(0)).cast("long"), "_files": F.array_distinct(F.coalesce(files, F.array().cast("array<string>")))})
    sums = F.coalesce(F.sum("_len").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = written(rows.withColumn("_before", sums))
    # claims whose start lies less than `chars` behind the group's start belong to it by length; rows of length 0 share a start
    full = F.max("pos").over(W.partitionBy(*keys).orderBy("_before").rangeBetween(0, chars - 1)) + 1
    spans = written(rows.select(*keys, "pos", "_files", F.greatest(full, F.col("pos") + 2).alias("_full")))
    # does a claim inside the span, third or later, share no file with those before it? the files so far grow claim by claim
    going, ends, step = spans.select(*keys, "pos", "_full", F.col("_files").alias("_so_far"), (F.col("pos") + 1).alias("_at")), None, 1
    named = rows.select(*keys, F.col("pos").alias("_at"), F.col("_files").alias("_own"))
    while True:
        j = going.join(named, [*keys, "_at"]).where("_at < _full")
        moved = (F.lit(step >= 2)) & (F.size("_own") > 0) & (F.size("_so_far") > 0) & ~F.arrays_overlap("_own", "_so_far")
        j = written(j.withColumn("_moved", moved))
        hit = j.where("_moved").select(*keys, "pos", F.col("_at").alias("_end"))
        ends = hit if ends is None else ends.union(hit)
        going = j.where("not _moved").select(*keys, "pos", "_full", F.array_union("_so_far", "_own").alias("_so_far"), (F.col("_at") + 1).alias("_at"))
        step += 1
        if going.isEmpty():
            break
    jumps = spans.join(ends, [*keys, "pos"], "left").select(*keys, "pos", F.coalesce("_end", "_full").alias("next"))
    begun = followed(jumps, keys, block).withColumn("_new", F.lit(1))
    told = rows.join(begun, [*keys, "pos"], "left")
    by = W.partitionBy(*keys).orderBy("pos")
    told = told.withColumn("group", F.sum(F.coalesce("_new", F.lit(0))).over(by.rowsBetween(W.unboundedPreceding, 0)))
    last = F.lead("pos").over(by).isNull() & (F.col("_new") == 1) & (F.col("group") > 1) & (F.col("_len") < orphan)
    told = told.withColumn("group", F.when(last, F.col("group") - 1).otherwise(F.col("group")).cast("long"))
    return told.select(*taken, "group")
