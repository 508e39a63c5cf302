"""Stored people meet newly resolved groups: who keeps an id, who turns into a redirect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.operators.lineage import written

#: People and groups of at most so many keys meet by the sets of keys they might share, and groups' keys then prove at most so many things in all.
SET_KEYS, SET_PROOFS = 6, 64
#: Every set of a sorted array's items but the empty one.
_SETS = "transform(sequence(1, shiftleft(1, size({0})) - 1), m -> filter({0}, (x, i) -> (m & shiftleft(1, i)) <> 0))"


def overlaps_of(stored: DataFrame, group_keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, rank, group, emails, logins, names, commits): what each of stored(id, rank, keys) shares with the groups that share any key with it.

    group_keys(group, kind, key, placeholder): kind is email, login or name; shared placeholder addresses prove nothing. pairs(group, pair, key, commits): the
    keys and commits of each identity of a group; commits are those of its identities that share a key. People and groups meet by key only."""
    known = stored.select("id", "rank", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    told = group_keys.where("not coalesce(placeholder, false)").select("group", "kind", "key").distinct()
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(kind + "s")
    shared = known.join(told, "key").groupBy("id", "rank", "group").agg(n("email"), n("login"), n("name"))
    proving = pairs.join(told.select("group", "key").distinct(), ["group", "key"], "left_semi")
    held = known.join(proving, "key").select("id", "group", "pair", "commits").distinct().groupBy("id", "group").agg(F.sum("commits").alias("commits"))
    return shared.join(held, ["id", "group"], "left").withColumn("commits", F.coalesce("commits", F.lit(0)))


def _down(*names: str) -> list:
    return [(-F.col(c)).alias(c) for c in names]


def _by_sets(stored: DataFrame, told: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, rank, b): the best group of each of stored(id, rank, keys) of few keys, b being the negated emails, logins, names and commits, then the group.

    A group stands under every set of its keys with what that set would share, a person looks under every set of theirs, and only the best group of a
    set is kept. The set of all that the two share counts more than any smaller one, so the best that is found is right; nobody meets a group twice over
    by each key, however many share it."""
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(kind + "s")
    proofs = pairs.join(told.select("group", "key").distinct(), ["group", "key"], "left_semi").groupBy("group", "key").agg(F.collect_set(F.struct("pair", "commits")).alias("proofs"))
    parts = told.groupBy("group", "key").agg(n("email"), n("login"), n("name")).join(proofs, ["group", "key"], "left")
    # no proof is null, so that arrays of them can be put together
    parts = parts.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("key", "emails", "logins", "names", F.coalesce("proofs", F.array().cast(proofs.schema["proofs"].dataType)).alias("proofs")))).alias("parts"))
    sets = parts.select("group", F.explode(F.expr(_SETS.format("parts"))).alias("s"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    number = "double" if dict(pairs.dtypes)["commits"] in ("float", "double") else "long"
    commits = F.aggregate(F.array_distinct(F.flatten("s.proofs")), F.lit(0).cast(number), lambda x, y: x + F.coalesce(y["commits"], F.lit(0)).cast(number))
    sets = sets.select("group", F.col("s.key").alias("set"), *[total(f"s.{c}").alias(c) for c in ("emails", "logins", "names")], commits.alias("commits"))
    best = sets.groupBy("set").agg(F.min(F.struct(*_down("emails", "logins", "names", "commits"), "group")).alias("b"))
    own = stored.select("id", "rank", F.sort_array(F.array_distinct(F.array_compact("keys"))).alias("keys")).select("id", "rank", F.explode(F.expr(_SETS.format("keys"))).alias("set"))
    return own.join(best, "set").groupBy("id", "rank").agg(F.min("b").alias("b"))


def _likeliest(stored: DataFrame, group_keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, rank, b) as _by_sets, whatever the number of keys: people and groups of many keys meet key by key."""
    told = group_keys.where("key is not null and not coalesce(placeholder, false)").select("group", "kind", "key").distinct()
    many = told.groupBy("group").agg(F.countDistinct("key").alias("n")).where((F.col("n") > SET_KEYS) | F.col("group").isNull()).select("group")
    proven = pairs.select("group", "pair", "key", "commits").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SET_PROOFS).select("group")
    large = written(many.union(proven).distinct())
    keys = F.size(F.array_distinct(F.array_compact("keys")))
    few, rest = stored.where(keys.between(1, SET_KEYS)), stored.where(keys > SET_KEYS)
    small = lambda d: d.where("group is not null").join(large, "group", "left_anti")
    out = [_by_sets(few, small(told), small(pairs))]
    by_key = lambda s, k, p: out.append(overlaps_of(s, k, p).groupBy("id", "rank").agg(F.min(F.struct(*_down("emails", "logins", "names", "commits"), "group")).alias("b")))
    if not large.isEmpty():
        held = lambda d: d.join(large.withColumnRenamed("group", "_g"), F.col("group").eqNullSafe(F.col("_g")), "left_semi")
        by_key(few, held(group_keys), held(pairs))
    if not rest.isEmpty():
        by_key(rest, group_keys, pairs)
    every = out[0]
    for d in out[1:]:
        every = every.union(d)
    return every.groupBy("id", "rank").agg(F.min("b").alias("b")) if len(out) > 1 else every


def assigned(stored: DataFrame, group_keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group, kept, target) of each stored person that shares a key with any group.

    A person goes to the group that shares the most emails with it, then logins, then names, then holds the most commits; ties go to the smaller group. A group keeps the
    id with the most of its commits, then the most shared keys, then the smallest rank and id; the others won by it (kept is false) become redirects to that one (target).
    Both choices are minima by key, computed partly before the shuffle. The groups of a person of at most SET_KEYS keys are looked up by sets of keys, not met one by one. Inputs as in overlaps_of()."""
    best = _likeliest(stored, group_keys, pairs)
    won = best.select("id", "rank", F.col("b.group").alias("group"), F.col("b.commits").alias("commits"), (F.col("b.emails") + F.col("b.logins") + F.col("b.names")).alias("shared"))
    # commits and shared are negative here
    keeper = won.groupBy("group").agg(F.min(F.struct("commits", "shared", "rank", "id")).alias("k")).select("group", F.col("k.id").alias("keeper"))
    out = won.join(keeper, "group")
    kept = F.col("id") == F.col("keeper")
    return out.select("id", "group", kept.alias("kept"), F.when(~kept, F.col("keeper")).alias("target"))


def renamed(ids: DataFrame, given: DataFrame) -> DataFrame:
    """(id, target): redirects from the ids that groups keep to the ids that given(group, given_id) sets for them, where they differ."""
    return ids.where("kept").join(given, "group").where("given_id is not null and given_id <> id").select("id", F.col("given_id").alias("target"))


def unmatched(group_keys: DataFrame, ids: DataFrame) -> DataFrame:
    """(group) of those that no stored person went to: they need new ids."""
    return group_keys.select("group").distinct().join(ids.select("group"), "group", "left_anti")
