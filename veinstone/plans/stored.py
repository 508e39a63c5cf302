"""Cached results, rows kept for a time, limited lists and graph checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions import cost
from veinstone.functions import names as N
from veinstone.operators import caching, graph
from veinstone.sources.tables import table


def cached_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lengths by document and content, of which a cache holds two thirds, a third of them outdated."""
    d, k = table(spark, sf_dir, "documents", "doc_id", "text"), F.col("doc_id")
    now = d.select(k.alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("oid"), "text")
    had = now.where("path % 3 > 0").select("path", F.when(F.col("path") % 3 == 1, F.col("oid")).otherwise("old").alias("oid"), F.lit(-1).cast("long").alias("size"))
    return caching.cached(now, had, ["path", "oid"], lambda rows: rows.select("path", "oid", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size")))


def kept_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order, of those of the 900 days before a day."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    old, new = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    out = caching.kept_for(old, new, ["o_custkey"], "o_orderdate", F.lit("1998-08-01"), 900)
    return out.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def capped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons why orders are odd: returns, then late lines, then rush orders; 30 of each, 70 in all."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_quantity")
    back = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct()
    big = li.where("l_quantity >= 49").select(F.col("l_orderkey").alias("k")).distinct()
    rush = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("k"))
    return caching.capped_union([back, big, rush], ["k"], 30, 70)


def shallow_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 shallowest paths of pages, among them the first with each of two endings."""
    p = table(spark, sf_dir, "pages", "url").where("url is not null").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return caching.shallow_first(p, 40, ["html$", "/es/"])


def graph_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    nodes = table(spark, sf_dir, "part", "p_partkey").where("p_partkey % 9 > 0").select(F.col("p_partkey").alias("node"))
    nodes = nodes.union(nodes.where("node % 50 = 1"))
    return caching.graph_problems(nodes, li.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(F.col("l_linenumber") == 3, -1.0).otherwise(F.col("l_quantity")).alias("weight")))


def merged_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers' redirects (each to its key without the lowest bit) end where."""
    c = table(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 64 <> 0")
    out = caching.merged_into(graph.final_targets(c.select(F.col("c_custkey").alias("id"), F.expr("c_custkey & (c_custkey - 1)").alias("target"))))
    return out.select("target", F.size("ids").alias("n"), F.element_at("ids", 1).alias("first"))


def year_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderdate").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return caching.year_grid(o)


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), F.col("o_orderkey")
    model = F.when(k % 4 == 0, "model-1-20250101").when(k % 4 == 1, "other").otherwise("model-2")
    return o.select("o_orderkey", cost.reserve_micros(model, F.floor("o_totalprice").cast("long"), (k % 5000).cast("long"), k % 3 == 0).alias("micros"), N.judged_score(F.array(k % 2 == 0, k % 3 == 0), k % 7 == 0).alias("score"))


def whole_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts' types hold a word as a whole name."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    ground = F.concat_ws("_", F.lower("p_type"), F.col("p_name"))
    return p.select("p_partkey", N.writes_name(ground, F.substring_index("p_name", " ", -1)).alias("last"), N.writes_name(ground, F.substring_index("p_name", " ", 1)).alias("first"), N.writes_name(ground, F.lower("p_type")).alias("type"))


def known_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lists of hashes made of each customer's key, those that are known."""
    c, k = table(spark, sf_dir, "customer", "c_custkey"), F.col("c_custkey")
    sha = lambda x: F.sha1(x.cast("string"))
    text = F.concat_ws("\n", F.upper(sha(k)), sha(k + 1), F.lit("# no"), F.concat(F.lit(" "), sha(k), F.lit("\r")), F.substring(sha(k), 1, 39), sha(k + 2))
    return c.select("c_custkey", F.array_join(N.known_revisions(text, F.array(sha(k), sha(k + 2))), ",").alias("revs"))


def tokens_issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of each user and kind there are, and when the last was."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "ts")
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm").alias("last"))


QUERIES = {
    "cached_sizes": cached_sizes, "kept_orders": kept_orders, "capped_evidence": capped_evidence, "shallow_paths": shallow_paths, "graph_problems": graph_problems, "merged_ids": merged_ids,
    "year_grid": year_grid, "reservations": reservations, "whole_names": whole_names, "known_revisions": known_revisions, "tokens_issued": tokens_issued,
}
ORACLES = {
    "cached_sizes": "SELECT doc_id AS path, sha256(coalesce(text, '')) AS oid, CASE WHEN doc_id % 3 = 1 THEN -1 ELSE length(coalesce(text, '')) END AS size FROM documents",
    "kept_orders": """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM r WHERE k = 1 AND o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 900 DAY""",
    "capped_evidence": """
WITH a AS (SELECT DISTINCT l_orderkey AS k, 1 AS part FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey, 2 FROM lineitem WHERE l_quantity >= 49 UNION SELECT o_orderkey, 3 FROM orders WHERE o_orderpriority LIKE '1%'),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY k) AS r FROM a), p AS (SELECT k, part, row_number() OVER (ORDER BY part, k) AS place FROM r WHERE r <= 30) SELECT k, part, place FROM p WHERE place <= 70""",
    "shallow_paths": """
WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages WHERE url IS NOT NULL), d AS (SELECT path, len(string_split(path, '/')) AS depth FROM p),
f AS (SELECT path FROM (SELECT path, row_number() OVER (ORDER BY depth, path) AS r FROM d WHERE path LIKE '%html') WHERE r = 1 UNION SELECT path FROM (SELECT path, row_number() OVER (ORDER BY depth, path) AS r FROM d WHERE path LIKE '%/es/%') WHERE r = 1),
h AS (SELECT path, depth, row_number() OVER (ORDER BY CASE WHEN path IN (SELECT path FROM f) THEN 0 ELSE 1 END, depth, path) AS n FROM d)
SELECT path, row_number() OVER (ORDER BY depth, path) AS place FROM h WHERE n <= 40""",
    "graph_problems": """
WITH n AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 9 > 0 UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 9 > 0 AND p_partkey % 50 = 1),
e AS (SELECT l_partkey AS a, l_suppkey AS b, CASE WHEN l_linenumber = 3 THEN -1 ELSE l_quantity END AS w FROM lineitem)
SELECT 'node twice' AS problem, node::VARCHAR AS item, count(*) AS n FROM n GROUP BY node HAVING count(*) > 1
UNION ALL SELECT 'unknown end', x::VARCHAR, count(*) FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e) WHERE x NOT IN (SELECT node FROM n) GROUP BY x
UNION ALL SELECT 'bad weight', a || ' ' || b, count(*) FROM e WHERE NOT w > 0 GROUP BY a, b""",
    "merged_ids": """
WITH RECURSIVE p AS (SELECT c_custkey AS id, c_custkey & (c_custkey - 1) AS target FROM customer WHERE c_custkey % 64 <> 0), r AS (SELECT id, target FROM p UNION SELECT r.id, p.target FROM r JOIN p ON p.id = r.target)
SELECT target, count(*) AS n, min(id) AS first FROM r WHERE target NOT IN (SELECT id FROM p) GROUP BY 1""",
    "year_grid": """
WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT year(day) AS year, (datediff('day', date_trunc('year', day), day) + isodow(date_trunc('year', day)) - 1) // 7 AS week, isodow(day) - 1 AS weekday, n FROM d""",
    "reservations": """
WITH o AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS tin, o_orderkey % 5000 AS most, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 2 END AS m, CASE WHEN o_orderkey % 3 = 0 THEN 0.5::DOUBLE ELSE 1 END AS f FROM orders)
SELECT o_orderkey, ceil(f * CASE WHEN m = 1 THEN tin * 1.25::DOUBLE + most * 1.25::DOUBLE WHEN m = 2 AND tin > 100000 THEN tin * 0.625::DOUBLE + most * 0.625::DOUBLE WHEN m = 2 THEN tin * 0.125::DOUBLE + most * 0.125::DOUBLE END - 0.000001)::BIGINT AS micros,
  CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 7 > 0 THEN 1 ELSE 0 END AS score FROM o""",
    "whole_names": r"""
WITH p AS (SELECT p_partkey, '_' || replace(lower(p_type), ' ', ' ') || '_' || p_name AS g, lower(p_type) || '_' || p_name AS ground, split_part(p_name, ' ', -1) AS l, split_part(p_name, ' ', 1) AS f, lower(p_type) AS t FROM part)
SELECT p_partkey, regexp_matches(ground, '(^|[^A-Za-z0-9_])' || l || '($|[^A-Za-z0-9_])') AS last, regexp_matches(ground, '(^|[^A-Za-z0-9_])' || f || '($|[^A-Za-z0-9_])') AS first, regexp_matches(ground, '(^|[^A-Za-z0-9_])' || t || '($|[^A-Za-z0-9_])') AS type FROM p""",
    "known_revisions": "SELECT c_custkey, sha1(c_custkey::VARCHAR) || ',' || sha1((c_custkey + 2)::VARCHAR) AS revs FROM customer",
    "tokens_issued": "SELECT user_id, event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M') AS last FROM events GROUP BY 1, 2",
}
