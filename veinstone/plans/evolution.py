"""Queries on histories, merges, registries and scripts of changes: orders, parts and suppliers stand for commits, files and people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.functions.dates import stated_dates as dates_of
from veinstone.functions.diffs import changed_rows
from veinstone.operators import deltas, evolution, history, merging, registry, scans
from veinstone.operators.cochange import cochange_pairs
from veinstone.operators.lineage import written
from veinstone.plans.cochange import SWEEP
from veinstone.sources.tables import table


def brought_in_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is a repository, its orders are commits in order: every ninth merges what came since the ninth before it, every third what came since the third before, the others follow one another. The
    innermost merge that brought each commit in."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    o = o.withColumn("r", r)
    node = lambda c: F.col("o_custkey") * 10_000 + c
    r = F.col("r")
    parents = F.when(r % 9 == 0, F.array(r - 9, r - 1)).when(r % 3 == 0, F.array(r - 3, r - 1)).otherwise(F.array(r - 1))
    own = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey"))
    commits = o.select(node(r).alias("node"), F.transform(parents, lambda p: F.when(p > 0, node(p))).alias("parents"), own.alias("own"), ((r % 3 == 0) & own.isNotNull()).alias("merges"))
    heads = o.groupBy("o_custkey").agg(F.max("r").alias("last")).select(node(F.col("last")).alias("node"))
    return history.brought_in(commits, heads)


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edits of a base by two sides: flags A ours, R theirs, N both."""
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    place = (F.col("l_orderkey") % 40) * 5
    side = F.when(F.col("l_returnflag") == "A", F.array(F.lit("ours"))).when(F.col("l_returnflag") == "R", F.array(F.lit("theirs"))).otherwise(F.array(F.lit("ours"), F.lit("theirs")))
    start = F.when(F.col("l_returnflag") == "A", place + 1).when(F.col("l_returnflag") == "R", place + 3).otherwise(place + 1001)
    rows = line.select((F.col("l_suppkey") % 20).alias("pull"), (F.col("l_partkey") % 50).alias("path"), start.alias("old_start"), (F.col("l_linenumber") % 4).alias("c"), (F.col("l_suppkey") % 3).alias("n"), F.explode(side).alias("side"))
    per = rows.groupBy("pull", "path", "old_start", "side").agg(F.min("c").cast("long").alias("old_count"), F.min("n").alias("n"))
    lines = F.array_repeat(F.concat(F.lit("x"), F.col("old_start").cast("string")), (F.col("n") + F.when(F.col("old_count") == 0, 1).otherwise(0)).cast("int"))
    return per.select("pull", "path", "old_start", "old_count", lines.alias("lines"), "side")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edits(spark, sf_dir)
    return merging.merged_edits(e.where("side = 'ours'"), e.where("side = 'theirs'"), ["pull", "path"])


def merge_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each file of each pull request merges."""
    return merging.merge_states(_merged(spark, sf_dir), ["pull", "path"])


def merged_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits of the files that merge, and their places in the merged file."""
    return merging.placed_edits(_merged(spark, sf_dir), ["pull", "path"]).drop("lines")


def _pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pulls = table(spark, sf_dir, "supplier", "s_suppkey").select((F.col("s_suppkey") % 20).alias("pull")).distinct().withColumn("behind", F.col("pull") % 7 == 0)
    # only parts of the files, so that some pulls merge
    some = merge_states(spark, sf_dir).where("path % 20 = pull % 10")
    return merging.pull_states(pulls, some)


def pull_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each pull request merges."""
    return _pulls(spark, sf_dir)


def pull_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims that merging each pull request would make stale, for sure or perhaps."""
    o, k = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").where("o_orderkey % 5 = 0"), F.col("o_orderkey")
    cites = o.select(k.alias("claim"), (F.col("o_custkey") % 50).alias("path"), (k % 200 + 1).alias("r_start"), (k % 200 + 1 + k % 7).alias("r_stop"))
    some = _merged(spark, sf_dir).where("path % 20 = pull % 10")
    return merging.merge_effects(_pulls(spark, sf_dir), some, cites)


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    key = lambda kind, value: F.concat(F.lit(kind), value.cast("string"))
    stored = table(spark, sf_dir, "supplier", "s_suppkey").select(s.alias("id"), (s * 7 % 100).alias("rank"), F.array(key("e", s % 37), key("e", s % 23), key("l", s % 11), key("n", s % 5)).alias("keys"))
    cust = table(spark, sf_dir, "customer", "c_custkey").select(c.alias("group"), F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("key"), flag.alias("placeholder")) for kind, value, flag in (
        ("email", key("e", c % 41), c % 3 == 0), ("email", key("e", c * 5 % 29), F.lit(False)), ("login", key("l", c % 13), F.lit(False)), ("name", key("n", c % 7), F.lit(False)))]).alias("k"))
    group_keys = cust.select("group", F.inline("k"))
    pairs = group_keys.select("group", F.col("kind").alias("pair"), "key", (F.col("group") * 3 % 17).alias("commits"))
    return stored, group_keys, pairs


def stored_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which group each stored person goes to, and whether it keeps its id."""
    return registry.assigned(*_people(spark, sf_dir))


def unmatched_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that need a new id."""
    stored, keys, pairs = _people(spark, sf_dir)
    return registry.unmatched(keys, registry.assigned(stored, keys, pairs))


def _script(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, evolution.Script]:
    """Parts are in their brand; brands in order are b1, b2, ...; every nation is a change: merges of brand k into the next, moves of parts of one size into a brand, new features of such parts, renames."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    brands = part.select("p_brand").distinct().withColumn("k", F.row_number().over(W.orderBy("p_brand")))  # some dozens
    feature = F.concat(F.lit("b"), F.col("k").cast("string"))
    membership = part.join(brands, "p_brand").select(F.col("p_partkey").alias("path"), feature.alias("feature"))
    n = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation", "n_nationkey")
    k = F.floor(n / 5) + 1
    b = lambda x: F.concat(F.lit("b"), x.cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("merge", "move", "create", "rename", "rename"))), (n % 5 + 1).cast("int"))
    of = F.when(n % 5 == 2, F.concat(F.lit("new"), n.cast("string"))).otherwise(b(k + F.when(n % 5 == 0, 0).otherwise(1)))
    ops = nation.select((n + 1).cast("long").alias("seq"), kind.alias("kind"), of.alias("feature"), F.when(n % 5 == 0, b(k + 1)).alias("into"))
    uses = ops.where("kind in ('move', 'create')").select("seq", F.col("seq").alias("cluster"), F.col("feature").alias("target"))
    clusters = part.select(F.col("p_size").cast("long").alias("cluster"), F.col("p_partkey").alias("path"))
    return membership, evolution.Script(ops, uses, clusters, membership.select("feature").distinct())


def evolved_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each part is after all changes."""
    return evolution.evolved(*_script(spark, sf_dir))


def script_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a script breaks that also moves into a brand already merged, merges one into itself, and uses a size twice."""
    membership, s = _script(spark, sf_dir)
    extra = spark.createDataFrame([(26, "move", "b1", None), (27, "merge", "b9", "b9"), (28, "move", "b9", None), (29, "retire", "b8", None), (30, "create", "extra", None), (31, "create", "new2", None)], "seq long, kind string, feature string, into string")
    uses = spark.createDataFrame([(26, 40, "b1"), (28, 2, "b9"), (30, 99, "extra"), (31, 45, "new2")], "seq long, cluster long, target string")
    bad = evolution.Script(s.ops.unionByName(extra), s.uses.unionByName(uses), s.clusters, s.features)
    return evolution.problems(membership, bad, evolution.evolved(membership, bad))


def claim_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in paragraphs: long enough, or moved on to other files."""
    o, k = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice"), F.col("o_orderkey")
    files = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("f"), (F.floor(k / 8) % 3).cast("string"))))
    rows = o.select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 2000).alias("len"), files.alias("files"))
    return scans.paragraphs(rows, ["o_custkey"], ["o_orderkey"], F.col("len"), F.col("files"), orphan=60).select("o_custkey", "o_orderkey", "group")


def updated_cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts of orders, brought up to date: what was shipped from 1998 on is added to what was before, and every tenth order's returned parts are taken out."""
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
    rows = line.select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("item"), (F.year("l_shipdate") < 1998).alias("early"), F.expr("l_orderkey % 10 = 0 and l_returnflag = 'R'").alias("out"))
    old = rows.where("early").select("grp", "item")
    sign = F.when(F.col("out"), -1).otherwise(1)
    signed = rows.where("out or not early").select("grp", "item", sign.alias("sign"))
    pairs = written(cochange_pairs(old, SWEEP))
    return deltas.updated_pairs(pairs, old, signed, SWEEP)


def carried_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of customers' orders after every twentieth order came in: those without a new one carry theirs forward, and only the others' orders are read again."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    version = F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.max("o_orderkey").cast("string")).alias("version")

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("o_custkey").agg(version, F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("largest"))

    previous = written(summed(o.where("o_orderkey % 20 <> 0")))
    now = o.groupBy("o_custkey").agg(version)
    return deltas.carried_forward(previous, now, ["o_custkey"], "version", lambda rest: summed(o.join(rest.select("o_custkey"), "o_custkey", "left_semi")))


def stated_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates that sentences about orders state, in eight ways."""
    o, k = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), F.col("o_orderkey")
    d = lambda form: F.date_format("o_orderdate", form)
    said = (
        F.concat(F.lit("It shipped on "), d("d MMMM yyyy"), F.lit(", at last.")), F.concat(F.lit("On "), d("MMM"), F.lit(". "), d("d"), F.lit("th, "), d("yyyy"), F.lit(" it left")),
        F.concat(F.lit("During "), d("MMMM yyyy"), F.lit("; May came later")), F.concat(F.lit("at "), d("yyyy-MM-dd"), F.lit("T10:00:00Z sharp")), F.concat(F.lit("("), d("yyyy-MM"), F.lit(")")),
        F.concat(F.lit("Back in "), d("yyyy"), F.lit(", item x1995 and 19951 moved")), F.concat(F.lit("Between January and "), d("MMMM yyyy"), F.lit(" all was well")), F.concat(F.lit("by 31 February "), d("yyyy"), F.lit(" or never")),
    )
    text = F.element_at(F.array(*said), (k % 8 + 1).cast("int"))
    return o.select("o_orderkey", F.explode(dates_of(text)).alias("s")).select("o_orderkey", F.col("s.text").alias("stated"), F.col("s.from").alias("first"), F.col("s.to").alias("last"))


def claim_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of what changed from each turn of a conversation to the next, sentence by sentence (no SQL: a longest common subsequence)."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("claims", F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("claims").alias("after"))
    # equal turns have nothing but context; asked of the rows themselves, as posexplode does too, this would run the comparison twice
    rows = c.join(nxt, ["conv_id", "turn"]).where(F.col("claims") != F.col("after")).select("conv_id", "turn", changed_rows(F.col("claims"), F.col("after")).alias("d"))
    return rows.select("conv_id", "turn", F.posexplode_outer("d").alias("place", "d")).select("conv_id", "turn", "place", "d.*")


_M = """
WITH l AS (SELECT l_suppkey % 20 AS pull, l_partkey % 50 AS path, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 3 ELSE 1001 END + (l_orderkey % 40) * 5 AS old_start, l_linenumber % 4 AS c, l_suppkey % 3 AS n,
  unnest(CASE l_returnflag WHEN 'A' THEN ['ours'] WHEN 'R' THEN ['theirs'] ELSE ['ours', 'theirs'] END) AS side FROM lineitem),
g AS (SELECT pull, path, old_start, side, min(c) AS old_count, min(n) + CASE WHEN min(c) = 0 THEN 1 ELSE 0 END AS n FROM l GROUP BY ALL),
e AS (SELECT pull, path, old_start, old_count, n, CASE WHEN count(*) = 2 THEN 'both' ELSE any_value(side) END AS side, CASE WHEN old_count = 0 THEN old_start ELSE old_start - 1 END AS a FROM g GROUP BY pull, path, old_start, old_count, n),
m AS (SELECT e.*, EXISTS (SELECT 1 FROM e f WHERE f.pull = e.pull AND f.path = e.path AND f.side <> e.side AND f.a <= e.a + e.old_count AND e.a <= f.a + f.old_count) AS conflict FROM e),
s AS (SELECT pull, path, CASE WHEN bool_or(conflict) THEN 'conflicts' WHEN count(*) FILTER (side = 'ours') > 0 AND count(*) FILTER (side = 'theirs') > 0 THEN 'clean' WHEN count(*) FILTER (side = 'ours') > 0 THEN 'ours'
  WHEN count(*) FILTER (side = 'theirs') > 0 THEN 'theirs' ELSE 'same' END AS state, count(*) FILTER (side IN ('ours', 'both')) AS ours, count(*) FILTER (side IN ('theirs', 'both')) AS theirs FROM m GROUP BY pull, path),
p AS (SELECT q.pull, CASE WHEN q.pull % 7 = 0 THEN 'unknown' WHEN count(*) FILTER (state = 'conflicts') > 0 THEN 'conflicts' ELSE 'clean' END AS merge, count(state) AS files, count(*) FILTER (state = 'conflicts') AS conflicts
  FROM (SELECT DISTINCT s_suppkey % 20 AS pull FROM supplier) q LEFT JOIN s ON s.pull = q.pull AND s.path % 20 = s.pull % 10 GROUP BY q.pull)
"""
_SC = """
WITH RECURSIVE br AS (SELECT p_brand, 'b' || row_number() OVER (ORDER BY p_brand) AS feature FROM (SELECT DISTINCT p_brand FROM part)),
o AS (SELECT n_nationkey + 1 AS seq, ['merge', 'move', 'create', 'rename', 'rename'][n_nationkey % 5 + 1] AS kind, CASE n_nationkey % 5 WHEN 2 THEN 'new' || n_nationkey WHEN 0 THEN 'b' || (n_nationkey // 5 + 1) ELSE 'b' || (n_nationkey // 5 + 2) END AS feature,
  CASE WHEN n_nationkey % 5 = 0 THEN 'b' || (n_nationkey // 5 + 2) END AS into_ FROM nation),
r AS (SELECT p_partkey AS path, p_size, feature, 0 AS seq FROM part JOIN br ON br.p_brand = part.p_brand UNION ALL
  SELECT path, p_size, CASE WHEN o.kind = 'merge' AND r.feature = o.feature THEN o.into_ WHEN o.kind IN ('move', 'create') AND r.p_size = o.seq THEN o.feature ELSE r.feature END, o.seq FROM r JOIN o ON o.seq = r.seq + 1)
"""
QUERIES = {
    "brought_in_by": brought_in_by,
    "merge_states": merge_states,
    "merged_edits": merged_edits,
    "pull_merges": pull_merges,
    "pull_effects": pull_effects,
    "stored_people": stored_people,
    "unmatched_groups": unmatched_groups,
    "evolved_membership": evolved_membership,
    "script_problems": script_problems,
    "claim_paragraphs": claim_paragraphs,
    "claim_changes": claim_changes,
    "stated_dates": stated_dates,
    "updated_cochange": updated_cochange,
    "carried_summaries": carried_summaries,
}
_P = """
WITH st AS (SELECT s_suppkey AS id, s_suppkey * 7 % 100 AS rank, unnest(list_distinct(['e' || (s_suppkey % 37), 'e' || (s_suppkey % 23), 'l' || (s_suppkey % 11), 'n' || (s_suppkey % 5)])) AS key FROM supplier),
gk AS (SELECT c_custkey AS grp, 'email' AS kind, 'e' || (c_custkey % 41) AS key FROM customer WHERE c_custkey % 3 <> 0 UNION SELECT c_custkey, 'email', 'e' || (c_custkey * 5 % 29) FROM customer
  UNION SELECT c_custkey, 'login', 'l' || (c_custkey % 13) FROM customer UNION SELECT c_custkey, 'name', 'n' || (c_custkey % 7) FROM customer),
pr AS (SELECT DISTINCT grp, kind AS pair, key FROM gk UNION SELECT c_custkey, 'email', 'e' || (c_custkey % 41) FROM customer WHERE 'e' || (c_custkey % 41) = 'e' || (c_custkey * 5 % 29)),
sh AS (SELECT id, rank, grp, count(*) FILTER (kind = 'email') AS emails, count(*) FILTER (kind = 'login') AS logins, count(*) FILTER (kind = 'name') AS names FROM st JOIN gk USING (key) GROUP BY ALL),
co AS (SELECT id, grp, sum(commits) AS commits FROM (SELECT DISTINCT id, grp, pair, grp * 3 % 17 AS commits FROM st JOIN pr USING (key)) GROUP BY ALL),
b AS (SELECT id, rank, grp, emails, logins, names, commits, row_number() OVER (PARTITION BY id ORDER BY emails DESC, logins DESC, names DESC, commits DESC, grp) AS r FROM sh JOIN co USING (id, grp)),
w AS (SELECT *, first_value(id) OVER (PARTITION BY grp ORDER BY commits DESC, emails + logins + names DESC, rank, id) AS keeper FROM b WHERE r = 1)
"""
ORACLES = {
    "brought_in_by": """
WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
e AS (SELECT c, r, 0 AS n, CASE WHEN r % 9 = 0 THEN r - 9 WHEN r % 3 = 0 THEN r - 3 ELSE r - 1 END AS p FROM o UNION ALL SELECT c, r, 1, r - 1 FROM o WHERE r % 3 = 0),
w AS (SELECT c, max(r) AS r, []::INT[] AS path, NULL::BIGINT AS number FROM o GROUP BY c UNION ALL
  SELECT w.c, e.p, list_append(w.path, e.n), CASE WHEN e.n = 1 AND o.k % 4 = 0 THEN o.k ELSE w.number END FROM w JOIN o ON o.c = w.c AND o.r = w.r JOIN e ON e.c = w.c AND e.r = w.r AND e.p > 0),
f AS (SELECT c, r, min(struct_pack(path := path, number := number)).number AS number FROM w GROUP BY c, r)
SELECT f.c * 10000 + f.r AS node, CASE WHEN k % 4 = 0 THEN k ELSE number END AS number FROM f JOIN o ON o.c = f.c AND o.r = f.r""",
    "merge_states": _M + "SELECT * FROM s",
    "merged_edits": _M + """SELECT m.pull, m.path, old_start, old_count, side, old_start + CASE WHEN old_count = 0 THEN 1 ELSE 0 END - CASE WHEN n = 0 THEN 1 ELSE 0 END
  + coalesce(sum(n - old_count) OVER (PARTITION BY m.pull, m.path ORDER BY old_start, old_count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_start, n AS new_count
FROM m JOIN s ON s.pull = m.pull AND s.path = m.path WHERE state <> 'conflicts'""",
    "pull_merges": _M + "SELECT * FROM p",
    "pull_effects": _M + """, c AS (SELECT o_orderkey AS claim, o_custkey % 50 AS path, o_orderkey % 200 + 1 AS a, o_orderkey % 200 + 1 + o_orderkey % 7 AS b FROM orders WHERE o_orderkey % 5 = 0),
t AS (SELECT m.*, merge FROM m JOIN p ON p.pull = m.pull WHERE side <> 'ours' AND m.path % 20 = m.pull % 10)
SELECT DISTINCT pull, claim, merge = 'clean' AS certain FROM t JOIN c ON c.path = t.path
WHERE merge <> 'clean' OR CASE WHEN old_count = 0 THEN c.a <= old_start AND c.b >= old_start + 1 ELSE c.a <= old_start + old_count - 1 AND c.b >= old_start END""",
    "stored_people": _P + "SELECT id, grp AS \"group\", id = keeper AS kept, CASE WHEN id <> keeper THEN keeper END AS target FROM w",
    "unmatched_groups": _P + "SELECT c_custkey AS \"group\" FROM customer WHERE c_custkey NOT IN (SELECT grp FROM w)",
    "evolved_membership": _SC + "SELECT path, feature FROM r WHERE seq = (SELECT max(seq) FROM o)",
    "script_problems": _SC + """, q AS (SELECT seq, feature FROM r WHERE seq = 25)
SELECT 26 AS seq, 'b1' AS feature, 'inactive' AS problem UNION ALL SELECT 27, 'b9', 'itself' UNION ALL SELECT 28, 'b9', 'inactive' UNION ALL SELECT 28, 'b9', 'reused' UNION ALL SELECT 30, 'extra', 'unknown' UNION ALL SELECT 30, 'extra', 'empty' UNION ALL SELECT 31, 'new2', 'known'
UNION ALL SELECT DISTINCT 29, 'b8', 'left' FROM q WHERE feature = 'b8'""",
    "claim_paragraphs": """
WITH RECURSIVE c AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, floor(o_totalprice / 2000)::BIGINT AS n,
  CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE ['f' || (o_orderkey // 8 % 3)] END AS files FROM orders),
w AS (SELECT c, k, r, 1 AS g, 1 AS held, n AS len, n, files FROM c WHERE r = 1 UNION ALL
  SELECT x.c, x.k, x.r, CASE WHEN cut THEN w.g + 1 ELSE w.g END, CASE WHEN cut THEN 1 ELSE w.held + 1 END, CASE WHEN cut THEN x.n ELSE w.len + x.n END, x.n, CASE WHEN cut THEN x.files ELSE list_concat(w.files, x.files) END
  FROM w JOIN c x ON x.c = w.c AND x.r = w.r + 1, LATERAL (SELECT w.held >= 2 AND (w.len >= 550 OR (len(x.files) > 0 AND len(w.files) > 0 AND NOT list_has_any(x.files, w.files))) AS cut))
SELECT c AS o_custkey, k AS o_orderkey, CASE WHEN g > 1 AND held = 1 AND n < 60 AND r = max(r) OVER (PARTITION BY c) THEN g - 1 ELSE g END AS "group" FROM w""",
    "updated_cochange": """
WITH l AS (SELECT l_orderkey AS g, l_partkey AS i, year(l_shipdate) < 1998 AS early, l_orderkey % 10 = 0 AND l_returnflag = 'R' AS gone FROM lineitem),
n AS (SELECT g, i FROM l GROUP BY g, i HAVING CASE WHEN bool_or(early) THEN sum(CASE WHEN gone THEN -1 WHEN early THEN 0 ELSE 1 END) >= 0 ELSE sum(CASE WHEN gone THEN -1 ELSE 1 END) > 0 END),
c AS (SELECT g FROM n GROUP BY g HAVING count(*) <= 50)
SELECT x.i AS a, y.i AS b, count(*) AS n_shared FROM n x JOIN n y ON x.g = y.g AND x.i < y.i WHERE x.g IN (SELECT g FROM c) GROUP BY 1, 2""",
    "carried_summaries": """
SELECT o_custkey, count(*) || ':' || max(o_orderkey) AS version, count(*) AS n, max(o_totalprice) AS largest,
  CASE WHEN count(*) FILTER (o_orderkey % 20 = 0) = 0 THEN 'carried' WHEN count(*) FILTER (o_orderkey % 20 <> 0) = 0 THEN 'new' ELSE 'changed' END AS state FROM orders GROUP BY o_custkey""",
    "stated_dates": """
WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS f, o_orderdate::DATE AS d, year(o_orderdate) AS y, monthname(o_orderdate) AS m, strftime(o_orderdate, '%Y-%m') AS ym FROM orders),
r AS (SELECT o_orderkey, CASE f WHEN 0 THEN day(d) || ' ' || m || ' ' || y WHEN 1 THEN substr(m, 1, 3) || '. ' || day(d) || 'th, ' || y WHEN 2 THEN m || ' ' || y WHEN 3 THEN d || 'T10:00:00Z' WHEN 4 THEN ym WHEN 5 THEN y::VARCHAR WHEN 6 THEN m || ' ' || y ELSE '31 February ' || y END AS stated,
  CASE WHEN f IN (0, 1, 3) THEN d::VARCHAR WHEN f IN (2, 4, 6) THEN ym || '-01' WHEN f = 5 THEN y || '-01-01' ELSE '' END AS first, CASE WHEN f IN (0, 1, 3) THEN d::VARCHAR WHEN f IN (2, 4, 6) THEN last_day(d)::VARCHAR WHEN f = 5 THEN y || '-12-31' ELSE '' END AS last FROM o)
SELECT * FROM r UNION ALL SELECT o_orderkey, 'January', y || '-01-01', y || '-01-31' FROM o WHERE f = 6""",
}
