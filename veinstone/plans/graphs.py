"""Graph queries: parts and suppliers stand for files, brands for features, orders for commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions.numbers import rounded
from veinstone.operators import graph, membership
from veinstone.operators.cochange import cochange_pairs, grouped_items
from veinstone.operators.lineage import written
from veinstone.operators.spreading import spread
from veinstone.operators.topk import top_k
from veinstone.plans.cochange import SWEEP
from veinstone.sources.tables import table


def _inputs(spark: SparkSession, sf_dir: str, *folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A part's folder is told by the columns `folder`, brand, type and size if there are none; where one is null it has none."""
    part = table(spark, sf_dir, "part")
    dirs = [F.col(c).cast("string") for c in folder or ("p_brand", "p_type", "p_size")]
    parts = part.select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.when(F.forall(F.array(*dirs), F.isnotnull), F.array_join(F.array(*dirs), "/")).alias("dir"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), F.lit(None).cast("string").alias("dir"))
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    imports = line.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    changes = line.select(F.col("l_orderkey").alias("grp"), F.concat(F.lit("p"), "l_partkey").alias("item"))
    return parts.union(suppliers), imports, changes


def _compact(spark: SparkSession, sf_dir: str) -> graph.FileGraph:
    return graph.compact_file_graph(*_inputs(spark, sf_dir), sweep=SWEEP)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.col("p_brand").alias("feature"), F.when(F.col("p_size") % 2 == 0, "core").otherwise("supporting").alias("role"))
    sup = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), F.concat(F.lit("nation"), "s_nationkey").alias("feature"), F.lit("core").alias("role"))
    return parts.union(sup)


def file_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of a brand are of one folder."""
    edges = graph.file_graph(*_inputs(spark, sf_dir, "p_brand"), sweep=SWEEP)
    return edges.select("a", "b", rounded(F.col("weight"), 6).alias("weight"))


def see_also(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_files(_compact(spark, sf_dir), 5)


def feature_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, imports, changes = _inputs(spark, sf_dir)
    out = graph.rolled_up_files(graph.signals(files, imports, changes, SWEEP), graph.folders_of(files), _features(spark, sf_dir))
    return out.select("src", "dst", rounded(F.col("weight"), 6).alias("weight"))


def see_also_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(feature_neighbours(spark, sf_dir), ["src"], [F.col("weight").desc(), F.col("dst")], 5)


def cross_feature_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation to nation flows with counts by kind and the first two places."""
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").withColumnRenamed("o_orderkey", "l_orderkey")
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").toDF("o_custkey", "src")
    sup = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").toDF("l_suppkey", "dst")
    flows = line.join(orders, "l_orderkey").join(cust, "o_custkey").join(sup, "l_suppkey").where("src <> dst")
    site = F.struct("l_orderkey", "l_linenumber")
    counts = flows.groupBy("src", "dst").agg(
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("imports"), F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("calls"),
        F.min(site).alias("one"),
    )
    # the second place: the least that is not the first, so that no list of places is ever held
    later = flows.join(counts.select("src", "dst", "one"), ["src", "dst"]).where(site > F.col("one")).groupBy("src", "dst").agg(F.min(site).alias("two"))
    name = lambda c: F.concat_ws(":", F.col(f"{c}.l_orderkey").cast("string"), F.col(f"{c}.l_linenumber").cast("string"))
    out = counts.join(later, ["src", "dst"], "left")
    return out.select("src", "dst", "imports", "calls", F.concat_ws(",", name("one"), F.when(F.col("two").isNotNull(), name("two"))).alias("sites"))


def centrality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.centrality_of_files(_compact(spark, sf_dir), _features(spark, sf_dir))


def _year(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """Membership of suppliers in the market segment that ordered most from them in a year."""
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_shipdate").where(F.year("l_shipdate") == year)
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").withColumnRenamed("o_orderkey", "l_orderkey")
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").toDF("o_custkey", "feature")
    n = line.join(orders, "l_orderkey").join(cust, "o_custkey").groupBy(F.col("l_suppkey").alias("path"), "feature").agg(F.count(F.lit(1)).alias("n"))
    best = top_k(n, ["path"], [F.col("n").desc(), F.col("feature")], 1)
    total = n.groupBy("path").agg(F.sum("n").alias("total"))
    return best.join(total, "path").select("path", "feature", rounded(F.col("n") / F.col("total"), 3).alias("weight"))


def membership_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = membership.churn(_year(spark, sf_dir, 1996), _year(spark, sf_dir, 1997))
    return out.select("feature", *[rounded(F.col(c), 6).alias(c) for c in ("moved", "base", "churn")])


def drifted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership_churn(spark, sf_dir).where("churn > 0.2").select("feature", "churn")


def new_file_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each supplier would go by three signals: segments it ships to, priorities it ships at, flags it ships under."""
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").withColumnRenamed("o_orderkey", "l_orderkey")
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").toDF("o_custkey", "feature")
    flows = line.join(orders, "l_orderkey").join(cust, "o_custkey")
    votes = flows.withColumn("signal", F.concat("o_orderstatus", "l_returnflag")).where(F.col("signal").isin("FR", "OR", "PR")).groupBy(F.col("l_suppkey").alias("path"), "signal", "feature").agg(F.count(F.lit(1)).alias("votes"))
    return membership.placed(votes)


def placement_by_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every tenth part would go, by what it refers to, what it is ordered with and its nearest folder."""
    p, k = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size"), F.col("p_partkey")
    path = F.concat_ws("/", "p_brand", "p_type", F.concat(F.lit("p"), k.cast("string")))
    named = p.select(k.alias("key"), path.alias("path"), F.concat_ws("-", "p_brand", (F.col("p_size") % 3).cast("string")).alias("feature"))
    imports = named.select("key", F.col("path").alias("src")).join(named.select((F.col("key") - 1).alias("key"), F.col("path").alias("dst")), "key").select("src", "dst")
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").join(named.select(F.col("key").alias("l_partkey"), "path"), "l_partkey")
    pairs = cochange_pairs(line.select(F.col("l_orderkey").alias("grp"), F.col("path").alias("item")), SWEEP).select("a", "b", F.col("n_shared").alias("n"))
    return membership.placed(membership.placement_votes(named.where("key % 10 = 0"), named.where("key % 10 > 0"), imports, pairs))


def graph_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are files; each refers to custkey // 3 and custkey // 2."""
    c = table(spark, sf_dir, "customer", "c_custkey")
    e = c.select(F.col("c_custkey").alias("src"), F.explode(F.array(F.floor(F.col("c_custkey") / 3), F.floor(F.col("c_custkey") / 2))).alias("dst"))
    return graph.entry_points(e)


def linked_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of customers that share nation, segment and hundred of balance, or neighbouring keys in a ten."""
    c = table(spark, sf_dir, "customer")
    key = F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor(F.col("c_acctbal") / 100).cast("string"))
    keyed = c.select(F.col("c_custkey").alias("b"), key.alias("k"))
    star = keyed.join(keyed.groupBy("k").agg(F.min("b").alias("a")), "k").select("a", "b")
    near = c.where("c_custkey % 10 in (1, 2)").select((F.col("c_custkey") - 1).alias("a"), F.col("c_custkey").alias("b"))
    out = graph.components(star.union(near))
    return c.select(F.col("c_custkey").alias("node")).join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def ancestors_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey").where("c_custkey > 0")
    # two parents, as merge commits have, so that paths fork and meet
    e = c.select(F.col("c_custkey").alias("node"), F.explode(F.array(F.floor(F.col("c_custkey") / 2), F.floor(F.col("c_custkey") / 3))).alias("parent"))
    return graph.ancestors(e)


def commits_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey").where("c_custkey > 0")
    e = c.select(F.col("c_custkey").alias("node"), F.explode(F.array(F.floor(F.col("c_custkey") / 2), F.floor(F.col("c_custkey") / 3))).alias("parent"))
    return graph.reachable(e, c.where("c_custkey % 50 = 7").select(F.col("c_custkey").alias("node")))


def redirect_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 64 <> 0")
    p = c.select(F.col("c_custkey").alias("id"), F.expr("c_custkey & (c_custkey - 1)").alias("target"))
    return graph.final_targets(p)


def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of parts by co-change alone (no SQL: the result depends on the order of visits)."""
    _, _, changes = _inputs(spark, sf_dir)
    # numbered in the order of their names, so groups are of numbers from the start
    ids = written(graph.ordered_ids(changes.select(F.col("item").alias("node"))))
    numbers = written(spread(changes, changes.count(), "item").join(ids.toDF("item", "id"), "item").select("grp", F.col("id").alias("item")))
    return graph.named(graph.louvain_of_groups(written(grouped_items(numbers, SWEEP).select("items"))), ids)


_E = f"""
WITH line AS (SELECT l_orderkey AS grp, 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem),
imp AS (SELECT DISTINCT src, dst FROM line), deg AS (SELECT dst, count(*) AS d FROM imp GROUP BY dst),
e1 AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, least(1.0, 4.0 / d) AS w FROM imp JOIN deg USING (dst)),
ch AS (SELECT DISTINCT grp, dst AS item FROM line), sz AS (SELECT grp FROM ch GROUP BY grp HAVING count(*) <= {SWEEP}),
k AS (SELECT ch.* FROM ch JOIN sz USING (grp)), fc AS (SELECT item, count(*) AS n FROM k GROUP BY item),
co AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM k x JOIN k y ON x.grp = y.grp AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 2),
e2 AS (SELECT a, b, 2.0 * co.n / (fa.n + fb.n - co.n) AS w FROM co JOIN fc fa ON fa.item = a JOIN fc fb ON fb.item = b),
f AS (SELECT 'p' || p_partkey AS path, p_brand || '/' || p_type || '/' || p_size AS dir FROM part), dn AS (SELECT dir, count(*) AS n FROM f GROUP BY dir),
e3 AS (SELECT x.path AS a, y.path AS b, 0.3 / (n - 1) AS w FROM f x JOIN f y ON x.dir = y.dir AND x.path < y.path JOIN dn ON dn.dir = x.dir),
edges AS (SELECT a, b, sum(w) AS weight FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3) GROUP BY 1, 2),
exact AS (SELECT a, b, floor(weight * 1000000 + 0.5) / 1000000 AS weight FROM edges),
m AS (SELECT 'p' || p_partkey AS path, p_brand AS feature, CASE WHEN p_size % 2 = 0 THEN 'core' ELSE 'supporting' END AS role FROM part
  UNION ALL SELECT 's' || s_suppkey, 'nation' || s_nationkey, 'core' FROM supplier),
sym AS (SELECT a, b, weight FROM exact UNION ALL SELECT b, a, weight FROM exact),
fn AS (SELECT x.feature AS src, y.feature AS dst, floor(sum(weight) * 1000000 + 0.5) / 1000000 AS weight
  FROM (SELECT a, b, weight FROM edges UNION ALL SELECT b, a, weight FROM edges) s JOIN m x ON x.path = a JOIN m y ON y.path = b WHERE x.feature <> y.feature GROUP BY 1, 2)
"""
_Y = """n{y} AS (SELECT l_suppkey AS path, c_mktsegment AS feature, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE year(l_shipdate) = {y} GROUP BY 1, 2),
m{y} AS (SELECT path, feature, floor(n * 1000.0 / sum(n) OVER (PARTITION BY path) + 0.5) / 1000 AS weight, row_number() OVER (PARTITION BY path ORDER BY n DESC, feature) AS r FROM n{y})"""
_CHURN = f"""
WITH {_Y.format(y=1996)}, {_Y.format(y=1997)},
b AS (SELECT path, feature AS f0, weight AS w0 FROM m1996 WHERE r = 1), c AS (SELECT path, feature AS f1, weight AS w1 FROM m1997 WHERE r = 1),
j AS (SELECT * FROM b FULL JOIN c USING (path)),
p AS (SELECT f0 AS feature, abs(w0 - w1) AS w FROM j WHERE f0 = f1 UNION ALL SELECT f0, w0 FROM j WHERE f0 IS DISTINCT FROM f1 AND f0 IS NOT NULL
  UNION ALL SELECT f1, w1 FROM j WHERE f0 IS DISTINCT FROM f1 AND f1 IS NOT NULL),
mv AS (SELECT feature, sum(w) AS moved FROM p GROUP BY 1), bs AS (SELECT f0 AS feature, sum(w0) AS base FROM b GROUP BY 1),
ch AS (SELECT feature, moved, coalesce(base, 0) AS base, CASE WHEN coalesce(base, 0) > 0 THEN moved / base WHEN moved > 0 THEN 'inf'::DOUBLE ELSE 0 END AS churn FROM mv LEFT JOIN bs USING (feature)),
out AS (SELECT feature, floor(moved * 1000000 + 0.5) / 1000000 AS moved, floor(base * 1000000 + 0.5) / 1000000 AS base,
  CASE WHEN isinf(churn) THEN churn ELSE floor(churn * 1000000 + 0.5) / 1000000 END AS churn FROM ch)
"""
_DAG = "e AS (SELECT c_custkey AS node, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey > 0)"

QUERIES = {
    "file_graph_edges": file_graph_edges,
    "see_also_topk": see_also,
    "feature_neighbours": feature_neighbours,
    "see_also_features": see_also_features,
    "cross_feature_edges": cross_feature_edges,
    "centrality_weights": centrality_weights,
    "membership_churn": membership_churn,
    "drifted_features": drifted_features,
    "new_file_placement": new_file_placement,
    "placement_by_signals": placement_by_signals,
    "entry_points": graph_entry_points,
    "connected_components": linked_customers,
    "ancestors_closure": ancestors_closure,
    "commits_reachable": commits_reachable,
    "redirect_closure": redirect_closure,
    "louvain_communities": louvain_communities,
}
ORACLES = {
    "file_graph_edges": _E.replace("p_brand || '/' || p_type || '/' || p_size AS dir", "p_brand AS dir") + "SELECT a, b, weight FROM exact",
    "see_also_topk": _E + "SELECT * FROM (SELECT a AS node, b AS neighbour, weight, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS rank FROM sym) WHERE rank <= 5",
    "feature_neighbours": _E + "SELECT src, dst, weight FROM fn",
    "see_also_features": _E + "SELECT * FROM (SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM fn) WHERE rank <= 5",
    "cross_feature_edges": """
WITH f AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_returnflag AS flag, l_orderkey AS o, l_linenumber AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
d AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY o, n) AS r FROM (SELECT DISTINCT src, dst, o, n FROM f)),
s AS (SELECT src, dst, string_agg(o || ':' || n, ',' ORDER BY r) AS sites FROM d WHERE r <= 2 GROUP BY 1, 2)
SELECT src, dst, count(*) FILTER (flag = 'R') AS imports, count(*) FILTER (flag <> 'R') AS calls, any_value(sites) AS sites FROM f JOIN s USING (src, dst) GROUP BY 1, 2""",
    "centrality_weights": _E + """, sh AS (SELECT x.path, x.feature, x.role, sum(CASE WHEN y.feature = x.feature THEN weight ELSE 0 END) / sum(weight) AS share
  FROM m x JOIN sym ON a = x.path LEFT JOIN m y ON y.path = b GROUP BY 1, 2, 3)
SELECT m.path, m.feature, floor(CASE WHEN m.role = 'core' THEN 1.0 ELSE 0.5 END * greatest(0.05, coalesce(share, 0)) * 1000 + 0.5) / 1000 AS weight FROM m LEFT JOIN sh ON sh.path = m.path""",
    "membership_churn": _CHURN + "SELECT * FROM out",
    "drifted_features": _CHURN + "SELECT feature, churn FROM out WHERE churn > 0.2",
    "new_file_placement": """
WITH v AS (SELECT l_suppkey AS path, o_orderstatus AS signal, c_mktsegment AS feature, count(*) AS votes FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE l_returnflag = 'R' AND o_orderstatus IN ('F', 'O', 'P') GROUP BY 1, 2, 3),
t AS (SELECT DISTINCT path, feature FROM (SELECT *, max(votes) OVER (PARTITION BY path, signal) AS top FROM v) WHERE votes = top)
SELECT path, CASE WHEN count(*) = 1 THEN 'decided' ELSE 'disputed' END AS state, string_agg(feature, ',' ORDER BY feature) AS features FROM t GROUP BY path""",
    "placement_by_signals": f"""
WITH n AS (SELECT p_partkey AS k, p_brand || '/' || p_type AS d, p_brand AS b, p_brand || '/' || p_type || '/p' || p_partkey AS path, p_brand || '-' || (p_size % 3) AS feature FROM part),
m AS (SELECT * FROM n WHERE k % 10 > 0), w AS (SELECT * FROM n WHERE k % 10 = 0),
v1 AS (SELECT w.path, 'i' AS signal, m.feature, count(*) AS votes FROM w JOIN m ON m.k IN (w.k - 1, w.k + 1) GROUP BY 1, 2, 3),
l AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS k FROM lineitem JOIN part ON p_partkey = l_partkey), s AS (SELECT g FROM l GROUP BY g HAVING count(*) <= {SWEEP}),
v2 AS (SELECT w.path, 'c', m.feature, count(*) FROM w JOIN l x ON x.k = w.k JOIN s ON s.g = x.g JOIN l y ON y.g = x.g JOIN m ON m.k = y.k GROUP BY 1, 2, 3),
v3 AS (SELECT w.path, 'f', m.feature, count(*) FROM w JOIN m ON m.d = w.d GROUP BY 1, 2, 3
  UNION ALL SELECT w.path, 'f', m.feature, count(*) FROM w JOIN m ON m.b = w.b WHERE w.d NOT IN (SELECT d FROM m) GROUP BY 1, 2, 3),
v AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3),
t AS (SELECT DISTINCT path, feature FROM (SELECT *, max(votes) OVER (PARTITION BY path, signal) AS top FROM v) WHERE votes = top)
SELECT path, CASE WHEN count(*) = 1 THEN 'decided' ELSE 'disputed' END AS state, string_agg(feature, ',' ORDER BY feature) AS features FROM t GROUP BY path""",
    "entry_points": """
WITH e AS (SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer UNION SELECT c_custkey, c_custkey // 2 FROM customer)
SELECT DISTINCT src AS node FROM e WHERE src <> dst AND src NOT IN (SELECT dst FROM e WHERE src <> dst)""",
    "connected_components": """
WITH RECURSIVE k AS (SELECT c_custkey AS n, c_nationkey || '|' || c_mktsegment || '|' || floor(c_acctbal / 100)::BIGINT AS k FROM customer),
e0 AS (SELECT min(n) OVER (PARTITION BY k) AS a, n AS b FROM k UNION SELECT c_custkey - 1, c_custkey FROM customer WHERE c_custkey % 10 IN (1, 2)),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
r AS (SELECT c_custkey AS node, c_custkey AS seen FROM customer UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node""",
    "ancestors_closure": f"WITH RECURSIVE {_DAG}, r AS (SELECT node, parent AS ancestor FROM e UNION SELECT r.node, e.parent FROM r JOIN e ON e.node = r.ancestor) SELECT node, ancestor FROM r",
    "commits_reachable": f"WITH RECURSIVE {_DAG}, r AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 50 = 7 UNION SELECT e.parent FROM r JOIN e ON e.node = r.node) SELECT node FROM r",
    "redirect_closure": """
WITH RECURSIVE p AS (SELECT c_custkey AS id, c_custkey & (c_custkey - 1) AS target FROM customer WHERE c_custkey % 64 <> 0),
r AS (SELECT id, target FROM p UNION SELECT r.id, p.target FROM r JOIN p ON p.id = r.target)
SELECT id, target, 'done' AS state FROM r WHERE target NOT IN (SELECT id FROM p)""",
}
