"""Contributor identities: distinct name and address pairs, and who they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.functions.text import is_bot, noreply_login, placeholder_email
from veinstone.operators.graph import components


def pairs(commits: DataFrame) -> DataFrame:
    """(name, email, n, first, last) of commits(name, email, at)."""
    clean = commits.select(F.trim("name").alias("name"), F.lower(F.trim("email")).alias("email"), "at")
    return clean.groupBy("name", "email").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def resolved(identity_pairs: DataFrame) -> DataFrame:
    """(name, email, person, bot): person is the smallest pair key of those joined by a shared address (placeholders
    aside), a shared noreply login, a name that is another's login, or an equal full name of two words or more.

    Each rule gives the pair a key; pairs with a key hang on the key, so that no rule ever pairs all
    its members. A person is a bot only if all pairs look like one.
    """
    p = identity_pairs.select("name", "email").distinct().withColumn("pair", F.concat_ws("\u0001", F.col("name"), F.col("email")))
    login = noreply_login(F.col("email"))
    full = F.lower(F.regexp_replace("name", r"\s+", " "))
    keys = F.array_compact(
        F.array(
            F.when(~placeholder_email(F.col("email")) & (F.col("email") != ""), F.concat(F.lit("e:"), "email")),
            F.when(login.isNotNull(), F.concat(F.lit("l:"), login)),
            F.when(full.rlike(r"\S \S"), F.concat(F.lit("n:"), full)),
            F.when(full.rlike(r"^[a-z0-9-]+$"), F.concat(F.lit("l:"), full)),
        )
    )
    keyed = p.select(F.col("pair").alias("b"), F.explode(keys).alias("a"))
    # a one-word name joins only where it is really someone's login
    logins = p.where(login.isNotNull()).select(F.concat(F.lit("l:"), login).alias("a")).distinct()
    keyed = keyed.where("a not like 'l:%'").union(keyed.join(logins, "a", "left_semi").select("b", "a"))
    part = components(keyed.select(F.concat(F.lit("k\u0002"), "a").alias("a"), F.concat(F.lit("p\u0002"), "b").alias("b")))
    named = part.where("node like 'p\u0002%'").select(F.expr("substring(node, 3)").alias("pair"), "component")
    out = p.join(named, "pair", "left").withColumn("component", F.coalesce("component", F.col("pair")))
    people = out.groupBy("component").agg(F.min("pair").alias("person"), F.min(is_bot(F.col("name"), noreply_login(F.col("email"))).cast("int")).alias("b"))
    return out.join(people, "component").select("name", "email", "person", (F.col("b") == 1).alias("bot"))
