"""Freshness, versions and differences: orders stand for claims, customers for files and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions.diffs import line_diff
from veinstone.operators import freshness, versions
from veinstone.sources.tables import table


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return o.select(k.alias("claim"), F.col("o_custkey").alias("path"), (k % 40 + 1).alias("start"), (k % 40 + 1 + k % 7).alias("stop"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the files is untouched, some are deleted, some renamed, the rest has one edit and one insertion."""
    k = F.col("c_custkey")
    hunk = lambda a, n, m: F.struct(F.lit(a).cast("long").alias("old_start"), F.lit(n).cast("long").alias("old_count"), F.lit(a).cast("long").alias("new_start"), m.cast("long").alias("new_count"))
    c = table(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 3 <> 0")
    return c.select(
        k.alias("old_path"), F.when(k % 10 == 1, None).when(k % 10 == 2, k + 1_000_000).otherwise(k).alias("new_path"), F.when(k % 10 == 1, "deleted").when(k % 10 == 2, "renamed").otherwise("modified").alias("status"),
        F.array(hunk(8, 3, k % 6), hunk(25, 0, k % 4 + 1)).alias("hunks"),
    )


def citation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.citation_status(_citations(spark, sf_dir), _changes(spark, sf_dir)).select("claim", "status", "new_path", "new_start", "new_stop")


def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    claims = table(spark, sf_dir, "orders", "o_orderkey").select(k.alias("claim"), F.when(k % 11 == 0, "before").alias("stale_since"), F.when(k % 9 == 0, F.array(k + 1, k + 2)).otherwise(F.array().cast("array<bigint>")).alias("supports"))
    return freshness.claim_status(claims, freshness.citation_status(_citations(spark, sf_dir), _changes(spark, sf_dir)))


def update_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = freshness.citation_status(_citations(spark, sf_dir), _changes(spark, sf_dir))
    pages = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("feature"))
    dirty = status.where("status = 'stale'").select(F.col("path").alias("feature"))
    moved = _changes(spark, sf_dir).where("status = 'renamed'").select(F.col("old_path").alias("feature"))
    return freshness.update_plan(pages, dirty, moved)


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return o.select(F.col("o_custkey").alias("feature"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("body"), F.col("o_orderstatus").alias("kind"))


def version_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.current(_revisions(spark, sf_dir)).select("feature", "seq", "body")


def checked_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd orders try to follow the newest even one, some with a wrong parent."""
    r = _revisions(spark, sf_dir)
    old = r.where("seq % 2 = 0")
    head = old.groupBy("feature").agg(F.max("seq").alias("head"))
    new = r.where("seq % 2 = 1").join(head, "feature", "left").select("feature", "seq", F.when(F.col("seq") % 7 == 0, F.col("head") - 1).otherwise(F.col("head")).alias("parent"))
    ok, refused = versions.checked_append(old, new)
    return ok.select("feature", "seq", F.lit(True).alias("accepted")).union(refused.select("feature", "seq", F.lit(False).alias("accepted")))


def turn_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept, cut and added from each turn of a conversation to the next (no SQL: a longest common subsequence)."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    d = c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", line_diff(F.col("text"), F.col("after")).alias("d"))
    n = lambda op: F.size(F.filter("d", lambda x: x["op"] == op))
    return d.select("conv_id", "turn", n("=").alias("kept"), n("-").alias("cut"), n("+").alias("added"))


_S = """
WITH c AS (SELECT o_orderkey AS claim, o_custkey AS path, o_orderkey % 40 + 1 AS a, o_orderkey % 40 + 1 + o_orderkey % 7 AS b FROM orders),
j AS (SELECT *, path % 3 <> 0 AS touched, path % 10 AS t, CASE WHEN 10 < a THEN path % 6 - 3 ELSE 0 END + CASE WHEN 25 < a THEN path % 4 + 1 ELSE 0 END AS shift,
  NOT (10 < a OR 8 > b) OR NOT (25 < a OR 25 >= b) AS hit FROM c),
s AS (SELECT *, NOT touched OR (t <> 1 AND NOT hit) AS fresh FROM j),
st AS (SELECT claim, path, touched, CASE WHEN fresh THEN 'fresh' ELSE 'stale' END AS status, CASE WHEN fresh THEN CASE WHEN touched AND t = 2 THEN path + 1000000 ELSE path END END AS new_path,
  CASE WHEN fresh THEN a + CASE WHEN touched THEN shift ELSE 0 END END AS new_start, CASE WHEN fresh THEN b + CASE WHEN touched THEN shift ELSE 0 END END AS new_stop FROM s)
"""
QUERIES = {
    "citation_status": citation_status,
    "claim_status": claim_status,
    "update_plan": update_plan,
    "version_current": version_current,
    "checked_appends": checked_appends,
    "turn_diffs": turn_diffs,
}
ORACLES = {
    "citation_status": _S + "SELECT claim, status, new_path, new_start, new_stop FROM st",
    "claim_status": _S + """, f AS (SELECT claim, CASE WHEN claim % 11 = 0 AND NOT touched THEN 'stale-kept' WHEN status = 'stale' THEN 'stale' ELSE 'fresh' END AS status FROM st)
SELECT f.claim, CASE WHEN f.claim % 9 = 0 AND EXISTS (SELECT 1 FROM f g WHERE g.claim IN (f.claim + 1, f.claim + 2) AND g.status = 'stale') THEN 'stale' ELSE f.status END AS status FROM f""",
    "update_plan": _S + """SELECT c_custkey AS feature, CASE WHEN c_custkey IN (SELECT path FROM st WHERE status = 'stale') THEN 'rewrite' WHEN c_custkey % 3 <> 0 AND c_custkey % 10 = 2 THEN 'whole' ELSE 'carried' END AS fate FROM customer""",
    "version_current": "SELECT feature, seq, body FROM (SELECT o_custkey AS feature, o_orderkey AS seq, o_totalprice AS body, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "checked_appends": """
WITH h AS (SELECT o_custkey, max(o_orderkey) AS head FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
n AS (SELECT o.o_custkey AS feature, o_orderkey AS seq, head, CASE WHEN o_orderkey % 7 = 0 THEN head - 1 ELSE head END AS parent, min(o_orderkey) OVER (PARTITION BY o.o_custkey) AS first FROM orders o LEFT JOIN h ON h.o_custkey = o.o_custkey WHERE o_orderkey % 2 = 1)
SELECT feature, seq, parent IS NOT DISTINCT FROM head AND seq = first AS accepted FROM n""",
}
