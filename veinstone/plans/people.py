"""People, pull requests, memberships and stored rows: orders stand for commits, order lines for changed files, brands for features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions.numbers import rounded
from veinstone.functions.text import test_file
from veinstone.operators import impact, people
from veinstone.sources.tables import table


def _person(key: str) -> Column:
    k = F.col(key) % 97
    return F.when(k > 0, F.concat(F.lit("c"), k.cast("string")))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return o.select(F.col("o_orderkey").alias("sha"), _person("o_custkey").alias("person"), (F.col("o_orderstatus") == "P").alias("merge"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderkey") % 4 == 0, F.floor(F.col("o_orderkey") / 8)).alias("pr"), F.col("o_orderdate").alias("at"))


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    path = F.when(F.col("l_partkey") % 40 == 0, "web/yarn.lock").otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    files = li.select(F.col("l_orderkey").alias("sha"), path.alias("path"), F.when(F.col("l_partkey") % 11 > 0, F.col("l_quantity").cast("long")).alias("added"), F.col("l_linenumber").cast("long").alias("deleted"))
    return people.commit_sums(_commits(spark, sf_dir), files)


def person_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits and lines by person and day; three people are shown as others."""
    out = spark.range(5, 8).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("person"))
    return people.activity(_sums(spark, sf_dir), out)


def person_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    helped = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey").select(F.col("l_orderkey").alias("sha"), _person("l_suppkey").alias("person"))
    return people.totals(_sums(spark, sf_dir), helped)


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_brand").toDF("l_partkey", "feature")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_quantity").join(_brands(spark, sf_dir), "l_partkey")
    return li.select(_person("l_suppkey").alias("person"), "feature", F.col("l_quantity").cast("long").alias("n"))


def person_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").join(_brands(spark, sf_dir), "l_partkey").select(F.col("l_orderkey").alias("sha"), "feature")
    return people.feature_shares(_sums(spark, sf_dir), touched, _lines(spark, sf_dir))


def top_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.contributors(_lines(spark, sf_dir)).withColumn("share", rounded(F.col("share"), 6))


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), F.col("c_custkey")
    name = F.when(k % 4 == 0, "").when(k % 4 == 1, F.col("c_mktsegment")).otherwise(F.concat_ws(" ", F.col("c_mktsegment"), (k % 5).cast("string")))
    return people.display_names(c.select(F.col("c_nationkey").alias("person"), name.alias("name"), (k % 50 == 2).alias("proper"), F.floor(F.abs("c_acctbal")).alias("commits"), k.alias("first")))


def pr_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.landings(_commits(spark, sf_dir)).select("pr", "sha", "merge")


def _status() -> Column:
    return F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "R", "deleted").otherwise("modified")


def pull_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order (a pull request) does to each brand."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_returnflag").join(_brands(spark, sf_dir), "l_partkey")
    files = li.select(F.col("l_orderkey").alias("pr"), "feature", _status().alias("status"), F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"))
    churn = li.groupBy(F.col("l_orderkey").alias("pr"), "feature").agg(F.max("l_partkey").alias("k")).select("pr", "feature", F.when(F.col("k") % 50 == 0, float("inf")).otherwise(F.col("k") % 1000 / 2048.0).alias("churn"))
    return impact.feature_effects(files, churn)


def placed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").where("p_size > 25").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("feature"))
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("old_path"), (F.col("l_partkey") + 1).alias("new_path"))
    return impact.placed_changes(li, m)


def membership_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are members, some by a symbol; one in seven goes, one in seven is renamed; suppliers come in."""
    p, k = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size"), F.col("p_partkey")
    path = F.concat(F.lit("p"), k.cast("string"))
    now = p.select(F.when(F.col("p_size") > 30, F.concat(path, F.lit("#s"))).otherwise(path).alias("member"), F.col("p_brand").alias("feature"), (F.col("p_size") / 64.0).alias("weight"))
    changes = p.where("p_partkey % 7 < 3").select(F.when(k % 7 == 0, "deleted").when(k % 7 == 1, "renamed").otherwise("modified").alias("status"), path.alias("old_path"), F.concat(path, F.lit("x")).alias("new_path"))
    placed = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("path"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("feature"), F.lit(0.5).alias("weight"))
    return impact.membership_after(now, changes, placed)


def test_only_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    files = p.select(F.concat_ws("/", "p_brand", "p_type", (F.col("p_partkey") % 40).cast("string")).alias("feature"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 > 0, "/tests/a.py").otherwise("/a.py")).alias("path"))
    return impact.test_only_features(files, test_file(F.col("path")))


def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, overwritten by returned order lines, the last of each."""
    now = table(spark, sf_dir, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("size"), F.lit(0).cast("long").alias("seq"))
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag").where("l_returnflag = 'R'")
    return impact.upserted(now, li.select(F.col("l_partkey").alias("k"), F.col("l_quantity").cast("long").alias("size"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")), ["k"], "seq")


def pruned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that some urgent order or some return refers to."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    urgent = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").where("o_orderpriority like '1%'")
    keep = li.join(urgent, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("p_partkey"))
    cited = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return impact.pruned(table(spark, sf_dir, "part", "p_partkey", "p_brand"), keep, cited, "p_partkey")


def oldest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = lambda nation, bal: F.array(F.concat(F.lit("n"), F.col(nation).cast("string")), F.concat(F.lit("b"), F.floor(F.col(bal) / 100).cast("string")))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), keys("s_nationkey", "s_acctbal").alias("keys"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.abs("c_acctbal")).alias("at"), keys("c_nationkey", "c_acctbal").alias("keys"))
    return impact.oldest_match(asked, rows)


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate"), F.col("o_orderkey")
    running = F.col("o_orderstatus") != "O"
    return o.select(k.alias("job"), F.when(running, "running").otherwise("queued").alias("status"), (k % 4).alias("attempt"), (k % 3).alias("step"), F.when(running, F.col("o_orderdate") + F.expr("interval 60 days")).alias("lease_until"))


def swept_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = impact.swept_leases(_jobs(spark, sf_dir), F.lit("1996-06-01").cast("timestamp"))
    return out.select("job", "status", "attempt", F.date_format("lease_until", "yyyy-MM-dd").alias("lease_until"))


def lease_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    beats = li.select(F.col("l_orderkey").alias("job"), (F.col("l_linenumber") % 4).cast("long").alias("attempt"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").cast("long").alias("step"))
    return impact.heartbeats(_jobs(spark, sf_dir), beats, "1 day").groupBy("job", "outcome").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("lease_until"), "yyyy-MM-dd").alias("lease_until"))


def _newest(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "customer", "c_custkey").agg(F.max("c_custkey")).first()[0]


def first_parent_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey").where("c_custkey > 1")
    parents = c.select(F.col("c_custkey").alias("sha"), F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey") - 2).otherwise(F.col("c_custkey") - 1).alias("first_parent"))
    return impact.first_parent_path(parents, _newest(spark, sf_dir), 20)


def merge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer", "c_custkey").where("c_custkey > 0"), _newest(spark, sf_dir)
    e = c.select(F.col("c_custkey").alias("node"), F.explode(F.array(F.floor(F.col("c_custkey") / 2), F.floor(F.col("c_custkey") / 3))).alias("parent"))
    return impact.merge_bases(e, n, n - 1)


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    cust, sup = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").toDF("o_custkey", "src"), table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").toDF("l_suppkey", "dst")
    return li.join(cust, "o_custkey").join(sup, "l_suppkey").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def redirected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "nation", "n_nationkey").where("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") + 1).cast("int").alias("target"))
    return impact.through_redirects(_flows(spark, sf_dir), targets)


def heaviest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.heaviest_subgraph(_flows(spark, sf_dir), 10, 80)


def likeliest_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier, of the brands of its orders' first lines, the one that it ships most of."""
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_linenumber").join(_brands(spark, sf_dir), "l_partkey")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    edges = li.groupBy(s.alias("a"), p.alias("b")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    m = table(spark, sf_dir, "part", "p_partkey", "p_brand").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_brand").alias("feature"))
    return impact.likeliest_feature(edges, m, li.where("l_linenumber = 1").select(s.alias("path"), "feature"))


_C = """WITH c AS (SELECT o_orderkey AS sha, CASE WHEN o_custkey % 97 > 0 THEN 'c' || (o_custkey % 97) END AS person, o_orderstatus = 'P' AS merge, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey // 8 END AS pr, o_orderdate AS at_ FROM orders),
f AS (SELECT l_orderkey AS sha, count(*) AS n, sum(CASE WHEN l_partkey % 40 > 0 AND l_partkey % 11 > 0 THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS added,
  sum(CASE WHEN l_partkey % 40 > 0 AND l_partkey % 11 > 0 THEN l_linenumber ELSE 0 END)::BIGINT AS deleted FROM lineitem GROUP BY 1),
s AS (SELECT c.*, CASE WHEN n <= 50 THEN coalesce(added, 0) ELSE 0 END AS added, CASE WHEN n <= 50 THEN coalesce(deleted, 0) ELSE 0 END AS deleted FROM c LEFT JOIN f USING (sha) WHERE NOT merge)"""
_L = ", li AS (SELECT CASE WHEN l_suppkey % 97 > 0 THEN 'c' || (l_suppkey % 97) END AS person, p_brand AS feature, l_quantity::BIGINT AS n, l_orderkey AS sha FROM lineitem JOIN part ON l_partkey = p_partkey)"
_F = """WITH w AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""
_J = """WITH j AS (SELECT o_orderkey AS job, CASE WHEN o_orderstatus <> 'O' THEN 'running' ELSE 'queued' END AS status, o_orderkey % 4 AS attempt, o_orderkey % 3 AS step,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 60 DAY END AS lease_until FROM orders)"""

QUERIES = {
    "person_activity": person_activity, "person_totals": person_totals, "person_features": person_features, "top_contributors": top_contributors, "display_names": display_names,
    "pr_landings": pr_landings, "pull_features": pull_features, "placed_changes": placed_changes, "membership_after": membership_after, "test_only_features": test_only_features,
    "upserted_rows": upserted_rows, "pruned_rows": pruned_rows, "oldest_match": oldest_match, "swept_leases": swept_leases, "lease_heartbeats": lease_heartbeats,
    "first_parent_path": first_parent_path, "merge_bases": merge_bases, "redirected_pairs": redirected_pairs, "heaviest_edges": heaviest_edges, "likeliest_feature": likeliest_feature,
}
ORACLES = {
    "person_activity": _C + """, k AS (SELECT *, person IN ('c5', 'c6', 'c7') AS hid FROM s WHERE person IS NOT NULL), m AS (SELECT count(DISTINCT person) AS m FROM k WHERE hid)
SELECT CASE WHEN hid THEN 'others' ELSE person END AS person, day, count(*) AS commits, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted FROM k, m WHERE NOT hid OR m >= 2 GROUP BY 1, 2""",
    "person_totals": _C + """, own AS (SELECT person, count(*) AS commits, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted FROM s WHERE person IS NOT NULL GROUP BY 1),
h AS (SELECT DISTINCT l_orderkey AS sha, 'c' || (l_suppkey % 97) AS who FROM lineitem WHERE l_suppkey % 97 > 0), hh AS (SELECT who AS person, count(*) AS co FROM h JOIN s USING (sha) WHERE who IS DISTINCT FROM person GROUP BY 1)
SELECT person, coalesce(commits, 0) AS commits, coalesce(added, 0) AS added, coalesce(deleted, 0) AS deleted, coalesce(co, 0) AS co_authored FROM own FULL JOIN hh USING (person)""",
    "person_features": _C + _L + """, t AS (SELECT DISTINCT sha, feature FROM li), a AS (SELECT person, feature, count(*) AS commits FROM s JOIN t USING (sha) WHERE person IS NOT NULL GROUP BY 1, 2),
b AS (SELECT person, feature, sum(n)::BIGINT AS lines FROM li WHERE person IS NOT NULL GROUP BY 1, 2),
u AS (SELECT person, feature, coalesce(commits, 0) AS commits, coalesce(lines, 0) AS lines FROM a FULL JOIN b USING (person, feature))
SELECT *, row_number() OVER (PARTITION BY person ORDER BY lines DESC, commits DESC, feature) AS rank FROM u WHERE commits + lines > 0""",
    "top_contributors": _C + _L + """, p AS (SELECT feature, person, sum(n)::BIGINT AS n FROM li WHERE person IS NOT NULL GROUP BY 1, 2 HAVING sum(n) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, person) AS r, sum(n) OVER (PARTITION BY feature) AS a, count(*) OVER (PARTITION BY feature) AS c FROM p)
SELECT feature, person, n, floor(n / a * 1000000 + 0.5) / 1000000 AS share, greatest(c - 5, 0) AS more FROM r WHERE r <= 5""",
    "display_names": """
WITH p AS (SELECT c_nationkey AS person, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_mktsegment ELSE c_mktsegment || ' ' || (c_custkey % 5) END AS name, c_custkey % 50 = 2 AS proper, floor(abs(c_acctbal)) AS n, c_custkey AS first FROM customer),
t AS (SELECT person, name, n, first, 0 AS tier FROM p WHERE proper UNION ALL SELECT person, name, n, first, 1 FROM p WHERE name LIKE '% %' UNION ALL SELECT person, name, n, first, 2 FROM p),
s AS (SELECT person, name, tier, sum(n) AS n, min(first) AS first FROM t WHERE name <> '' GROUP BY 1, 2, 3)
SELECT person, name FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY tier, n DESC, first, name) AS r FROM s) WHERE r = 1""",
    "pr_landings": _C + " SELECT pr, sha, merge FROM (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY at_ DESC, sha DESC) AS r FROM c WHERE pr IS NOT NULL) WHERE r = 1",
    "pull_features": """
WITH n AS (SELECT l_orderkey AS pr, p_brand AS feature, count(*) AS files, sum(l_quantity::BIGINT + l_linenumber)::BIGINT AS changed_lines, count(*) FILTER (l_returnflag = 'A') AS added,
  count(*) FILTER (l_returnflag = 'R') AS removed, max(l_partkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT pr, feature, files, changed_lines, added, removed, CASE WHEN k % 50 > 0 THEN floor(k % 1000 / 2048.0::DOUBLE * 1000 + 0.5) / 1000 END AS churn, k % 50 = 0 OR k % 1000 / 2048.0::DOUBLE > 0.2 AS drifts,
  row_number() OVER (PARTITION BY pr ORDER BY changed_lines DESC, files DESC, feature) AS rank FROM n""",
    "placed_changes": """SELECT l_orderkey, l_linenumber, l_partkey AS old_path, l_partkey + 1 AS new_path, coalesce(a.p_brand, b.p_brand) AS feature
FROM lineitem LEFT JOIN part a ON a.p_partkey = l_partkey AND a.p_size > 25 LEFT JOIN part b ON b.p_partkey = l_partkey + 1 AND b.p_size > 25""",
    "membership_after": """
WITH m AS (SELECT 'p' || p_partkey || CASE WHEN p_partkey % 7 = 1 THEN 'x' ELSE '' END || CASE WHEN p_size > 30 THEN '#s' ELSE '' END AS member, 1 AS late, p_brand AS feature, p_size / 64.0::DOUBLE AS weight FROM part WHERE p_partkey % 7 <> 0
  UNION ALL SELECT 'p' || s_suppkey, 0, 'n' || s_nationkey, 0.5 FROM supplier)
SELECT member, feature, weight FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY late, feature, weight) AS r FROM m) WHERE r = 1""",
    "test_only_features": """
WITH f AS (SELECT p_brand || '/' || p_type || '/' || (p_partkey % 40) AS feature, bool_and(p_size % 3 > 0) AS t FROM part GROUP BY 1)
SELECT feature FROM f WHERE t AND EXISTS (SELECT 1 FROM f WHERE NOT t)""",
    "upserted_rows": """
WITH r AS (SELECT p_partkey AS k, p_size::BIGINT AS size, 0::BIGINT AS seq, 0 AS new FROM part UNION ALL SELECT l_partkey, l_quantity::BIGINT, l_orderkey * 10 + l_linenumber, 1 FROM lineitem WHERE l_returnflag = 'R')
SELECT k, size, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY new DESC, seq DESC) AS r FROM r) WHERE r = 1""",
    "pruned_rows": """SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%')
OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""",
    "oldest_match": """
SELECT query_id, id FROM (SELECT s_suppkey AS query_id, c_custkey AS id, row_number() OVER (PARTITION BY s_suppkey ORDER BY floor(abs(c_acctbal)), c_custkey) AS r
FROM supplier JOIN customer ON s_nationkey = c_nationkey OR floor(s_acctbal / 100) = floor(c_acctbal / 100)) WHERE r = 1""",
    "swept_leases": _J + """, l AS (SELECT *, status = 'running' AND lease_until <= TIMESTAMP '1996-06-01' AS late FROM j)
SELECT job, CASE WHEN late AND attempt >= 3 THEN 'failed' WHEN late THEN 'queued' ELSE status END AS status, CASE WHEN late AND attempt < 3 THEN attempt + 1 ELSE attempt END AS attempt,
  CASE WHEN NOT coalesce(late, false) THEN strftime(lease_until, '%Y-%m-%d') END AS lease_until FROM l""",
    "lease_heartbeats": _J + """, b AS (SELECT l_orderkey AS job, l_shipdate AS at_, CASE WHEN j.status IS NULL OR j.status <> 'running' THEN 'invalid' WHEN j.attempt <> l_linenumber % 4 THEN 'stale attempt'
  WHEN l_shipdate > lease_until THEN 'lease expired' WHEN l_linenumber < j.step THEN 'invalid' ELSE 'renewed' END AS outcome FROM lineitem LEFT JOIN j ON j.job = l_orderkey)
SELECT job, outcome, count(*) AS n, strftime(max(CASE WHEN outcome = 'renewed' THEN at_ + INTERVAL 1 DAY END), '%Y-%m-%d') AS lease_until FROM b GROUP BY 1, 2""",
    "first_parent_path": """
WITH RECURSIVE p AS (SELECT c_custkey AS sha, CASE WHEN c_custkey % 7 = 0 THEN c_custkey - 2 ELSE c_custkey - 1 END AS to_ FROM customer WHERE c_custkey > 1),
w AS (SELECT max(c_custkey) AS sha, 0::BIGINT AS place FROM customer UNION ALL SELECT p.to_, place + 1 FROM w JOIN p USING (sha))
SELECT sha, place FROM w WHERE place < coalesce((SELECT min(place) FROM w WHERE sha = 20), 9000000000)""",
    "merge_bases": """
WITH RECURSIVE e AS (SELECT c_custkey AS node, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey > 0),
a AS (SELECT max(c_custkey) AS node FROM customer UNION SELECT e.parent FROM a JOIN e USING (node)), b AS (SELECT max(c_custkey) - 1 AS node FROM customer UNION SELECT e.parent FROM b JOIN e USING (node)),
c AS (SELECT node FROM a INTERSECT SELECT node FROM b) SELECT node FROM c WHERE node NOT IN (SELECT parent FROM e WHERE node IN (SELECT node FROM c))""",
    "redirected_pairs": _F + """, d AS (SELECT CASE WHEN src % 5 = 0 THEN src + 1 ELSE src END AS s, CASE WHEN dst % 5 = 0 THEN dst + 1 ELSE dst END AS d, weight FROM w)
SELECT least(s, d) AS a, greatest(s, d) AS b, sum(weight)::BIGINT AS weight FROM d WHERE s <> d GROUP BY 1, 2 ORDER BY weight DESC, a, b LIMIT 80""",
    "heaviest_edges": _F + """, e AS (SELECT node, sum(weight) AS w FROM (SELECT src AS node, weight FROM w UNION ALL SELECT dst, weight FROM w) GROUP BY 1), t AS (SELECT node FROM e ORDER BY e.w DESC, node LIMIT 10)
SELECT src, dst, weight FROM w WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t) ORDER BY weight DESC, src, dst LIMIT 80""",
    "likeliest_feature": """
WITH n AS (SELECT 's' || l_suppkey AS path, p_brand AS feature, count(*)::DOUBLE AS weight, count(*) FILTER (l_linenumber = 1) AS one FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT path, feature, weight FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY weight DESC, feature) AS r FROM n WHERE one > 0) WHERE r = 1""",
}
