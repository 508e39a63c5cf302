"""Results kept up to date by what changed: signed rows are added to counts, unchanged keys carry their rows forward."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.operators.cochange import grouped_items, paired
from veinstone.operators.lineage import written
from veinstone.operators.spreading import spread


def added_up(counts: DataFrame, delta: DataFrame, keys: list[str], value: str, rows: int = 0) -> DataFrame:
    """counts(keys, value) with delta(keys, value), of either sign, added; rows that come to 0 are gone. Null keys agree with null keys.
    rows: how many both have, where that is known, so that they are dealt to tasks of one size."""
    both = counts.select(*keys, value).unionByName(delta.select(*keys, value))
    return spread(both, rows, *keys).groupBy(*keys).agg(F.sum(value).alias(value)).where(F.col(value) != 0)


def after(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """The distinct rows of rows once signed(rows' columns, sign) has been applied: 1 adds, -1 removes; what is added and removed stays as the sum says. Rows that are not there can't be removed,
    rows that are there are not added twice."""
    names = rows.columns
    now = rows.distinct().withColumn("sign", F.lit(1)).unionByName(signed.groupBy(*names).agg(F.signum(F.sum("sign")).cast("int").alias("sign")).where("sign <> 0").withColumn("sign", F.col("sign") * 2))
    # there: 1, added: 2, removed: -2; so 1, 2 and 3 stay, -1 and -2 don't
    return now.groupBy(*names).agg(F.sum("sign").alias("sign")).where("sign > 0").select(*names)


def cochange_delta(changes: DataFrame, signed: DataFrame, sweep: int) -> DataFrame:
    """(a, b, n_shared), of either sign: by how much the pairs of changes(grp, item) change by signed(grp, item, sign).

    Only the groups that signed names are read from changes; their pairs before count -1 and after 1. A group that grows beyond
    sweep, or shrinks below, loses or gains all its pairs."""
    touched = signed.select("grp").where("grp is not null").distinct()
    old = changes.select("grp", "item").join(touched, "grp", "left_semi")
    before = paired(grouped_items(old, sweep)).withColumn("n_shared", -F.col("n_shared"))
    now = paired(grouped_items(after(old, signed.select("grp", "item", "sign")), sweep))
    both = written(before.union(now))
    return spread(both, both.count(), "a", "b").groupBy("a", "b").agg(F.sum("n_shared").alias("n_shared")).where("n_shared <> 0")


def updated_pairs(pairs: DataFrame, changes: DataFrame, signed: DataFrame, sweep: int) -> DataFrame:
    """pairs(a, b, n_shared), which are those of changes, as they are after signed: the same as counting anew."""
    delta = written(cochange_delta(changes, signed, sweep))
    return added_up(pairs, delta, ["a", "b"], "n_shared", pairs.count() + delta.count())


def carried_forward(previous: DataFrame, current: DataFrame, keys: list[str], version: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each of current(keys, version)'s keys with its row: previous' own where the version is the same (state carried), else what compute makes of
    the (keys, version) rows left over (state new or changed). Keys no longer in current are gone. compute returns previous' columns but state, and sees only those rows.

    Null versions never agree. Repeated keys of current count once."""
    names = [c for c in previous.columns if c != "state"]
    wanted = current.select(*keys, version).dropDuplicates(keys)
    old = previous.select(*names)
    kept = written(old.join(wanted, [*keys, version], "left_semi"))
    rest = written(wanted.join(kept.select(*keys), keys, "left_anti").join(old.select(*keys).distinct().withColumn("_known", F.lit(True)), keys, "left"))
    state = rest.select(*keys, F.when(F.col("_known"), "changed").otherwise("new").alias("state"))
    made = compute(rest.drop("_known")).select(*names).join(state, keys)
    return kept.withColumn("state", F.lit("carried")).unionByName(made)
