"""Interval, ordered-sequence, top-k and calendar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.functions.numbers import floored, heat_level, rounded
from veinstone.operators import activity, ranges, topk
from veinstone.sources.tables import table


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as ranges of days: from the order's day, as long as its price says."""
    day = F.datediff("o_orderdate", F.lit("1995-01-01"))
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("claim"), day.alias("start"), (day + F.floor(F.col("o_totalprice") / 10000).cast("int")).alias("stop"))


def citing_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part-of-the-year window of a customer's, the orders whose days it overlaps."""
    asked = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("path"), F.explode(F.array(F.lit(100), F.lit(900))).alias("r_start"))
    asked = asked.withColumn("r_stop", F.col("r_start") + 29)
    return ranges.overlaps(_days(spark, sf_dir), asked, ["path"], 64).select("path", "claim", "start", "stop", "r_start")


def innermost_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _days(spark, sf_dir).select("path", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"), F.col("claim").alias("name"))
    points = _days(spark, sf_dir).select("path", F.col("claim"), F.col("start"), F.col("start").alias("stop"))
    return ranges.innermost(points, spans, ["path"], ["path", "claim"], 64)


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _days(spark, sf_dir)
    late = d.where("claim % 3 = 0").select("path", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    return ranges.uncovered(d.where("claim % 3 <> 0"), late, ["path"], ["path", "claim"], 64).select("path", "claim")


def remap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' line ranges through three edits each, derived from the keys."""
    o = table(spark, sf_dir, "orders", "o_orderkey")
    start = (F.col("o_orderkey") % 40 + 1).cast("long")
    stop = start + F.col("o_orderkey") % 7
    hunk = lambda a, n, m: F.struct(F.lit(a).cast("long").alias("old_start"), F.lit(n).cast("long").alias("old_count"), F.lit(a).cast("long").alias("new_start"), m.cast("long").alias("new_count"))
    hunks = F.array(hunk(5, 2, F.col("o_orderkey") % 5), hunk(15, 0, F.col("o_orderkey") % 4 + 1), hunk(30, 3, F.lit(0)))
    out = o.select("o_orderkey", ranges.remapped(start, stop, hunks).alias("r"))
    return out.select("o_orderkey", "r.start", "r.stop")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return topk.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


def landings_arg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's most frequent event type; ties go to the earlier first event, then the smaller name."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "ts")
    n = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    return topk.top_k(n, ["user_id"], [F.col("n").desc(), F.col("first"), F.col("event_type")], 1).select("user_id", "event_type", "n")


def run_length_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_type", "ts", "event_id")
    out = ranges.islands(e.withColumn("at", F.col("event_id")), ["user_id"], ["ts", "event_id"], "event_type")
    return out.select("user_id", F.col("run").cast("long").alias("run"), "event_type", "n")


def _orders_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").select("o_custkey", F.to_date("o_orderdate").alias("day"))


def _events_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "user_id", "ts").select("user_id", F.to_date("ts").alias("day"))


def _activity(source, grain: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = activity.dense_counts(source(spark, sf_dir), "day", grain)
        return out.select(F.col("bucket").cast("string").alias("bucket"), "n", heat_level(F.col("n")).alias("heat"))

    return query


def adaptive_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.finest_grain(_orders_day(spark, sf_dir), ["o_custkey"], "day", 7)


def top_series_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.top_series(_events_day(spark, sf_dir), "day", "user_id", 8).withColumn("day", F.col("day").cast("string"))


def zoom_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.busiest_period(_orders_day(spark, sf_dir), ["o_custkey"], "day", "month").withColumn("period", F.col("period").cast("string"))


def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice").withColumn("cents", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long"))
    kept = topk.within_budget(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], "cents", 50_000_000)
    return kept.select("o_custkey", "o_orderkey", F.col("spent").cast("long").alias("spent"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spot check: ten rows, one of each segment in turn by hash."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    return topk.round_robin(c, "c_mktsegment", F.concat(F.lit("seed:"), F.col("c_custkey").cast("string")), 10).select("c_custkey", "c_mktsegment", "h")


def reference_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    return topk.first_appearance(e, ["user_id"], "event_id", "event_type").select("user_id", "event_id", "event_type", F.col("number").cast("long").alias("number"), F.col("occurrence").cast("long").alias("occurrence"))


def newest_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All largest line items of each order, ties included."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return topk.at_most(li, ["l_orderkey"], "r", "l_quantity")


def k_anonymous_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded users' daily events, only summed where enough of them were active; others by user."""
    e = _events_day(spark, sf_dir).withColumn("out", F.col("user_id") % 3 == 0)
    hidden = e.where("out").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("people")).where("people >= 5")
    shown = e.where("not out").groupBy("day", F.col("user_id").cast("string").alias("who")).agg(F.count(F.lit(1)).alias("n"))
    return shown.union(hidden.select("day", F.lit("others").alias("who"), "n")).withColumn("day", F.col("day").cast("string"))


def lang_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "lang", "n_chars").groupBy("lang").agg(F.sum("n_chars").alias("n"))
    total = d.agg(F.sum("n").alias("total"))
    out = d.crossJoin(F.broadcast(total)).select("lang", floored(F.col("n") / F.col("total"), 3).alias("share"))
    return out.where("share > 0").orderBy(F.col("share").desc(), "lang").limit(20)


def infobox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: customers, orders, first and last day, top three segments."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").withColumnRenamed("o_custkey", "c_custkey")
    per = c.join(o, "c_custkey").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("orders"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"))
    seg = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    top = topk.top_k(seg, ["c_nationkey"], [F.col("n").desc(), F.col("c_mktsegment")], 3)
    names = top.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "c_mktsegment"))), lambda x: x["c_mktsegment"]), ",").alias("top_segments"))
    people = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return people.join(per, "c_nationkey", "left").join(names, "c_nationkey").select("c_nationkey", "customers", F.coalesce("orders", F.lit(0)).alias("orders"), "first_day", "last_day", "top_segments")


def revision_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as revisions: number, and change of price against the one before."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("number"), rounded(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("change"))


def dedup_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names made unique by -2, -3 in key order."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name").withColumn("slug", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"))
    n = F.row_number().over(W.partitionBy("slug").orderBy("p_partkey"))
    return p.select("p_partkey", F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("-", F.col("slug"), n.cast("string"))).alias("slug"))


_DAYS = "d AS (SELECT o_custkey AS path, o_orderkey AS claim, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS start, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) + floor(o_totalprice / 10000)::INT AS stop FROM orders)"


def _dense(src: str, day: str, grain: str) -> str:
    step = {"day": "1 day", "week": "7 day", "month": "1 month", "quarter": "3 month", "year": "1 year"}[grain]
    return f"""WITH c AS (SELECT date_trunc('{grain}', {day}::DATE)::DATE AS bucket, count(*) AS n FROM {src} GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM c)::TIMESTAMP, (SELECT max(bucket) FROM c)::TIMESTAMP, INTERVAL {step}))::DATE AS bucket),
o AS (SELECT bucket, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (bucket))
SELECT bucket::VARCHAR AS bucket, n, CASE WHEN n <= 0 THEN 0 WHEN n = 1 THEN 1 WHEN n <= 3 THEN 2 WHEN n <= 6 THEN 3 ELSE 4 END AS heat FROM o"""


_ACTIVITY = {"day": ("events", "ts"), "week": ("events", "ts"), "month": ("orders", "o_orderdate"), "quarter": ("orders", "o_orderdate"), "year": ("orders", "o_orderdate")}
QUERIES = {
    "citing_range": citing_range,
    "innermost_symbol": innermost_symbol,
    "coverage_gaps": coverage_gaps,
    "remap_ranges": remap_ranges,
    "latest_per_key": latest_per_key,
    "landings_arg_max": landings_arg_max,
    "run_length_islands": run_length_islands,
    "adaptive_grain": adaptive_grain,
    "top_series_others": top_series_others,
    "zoom_period": zoom_period,
    "prefix_budget": prefix_budget,
    "stratified_sample": stratified_sample,
    "reference_numbers": reference_numbers,
    "rank_with_ties": newest_ties,
    "k_anonymous_others": k_anonymous_others,
    "lang_shares": lang_shares,
    "infobox": infobox,
    "revision_numbers": revision_numbers,
    "dedup_suffixes": dedup_suffixes,
} | {f"activity_{g}": _activity(_events_day if t == "events" else _orders_day, g) for g, (t, _) in _ACTIVITY.items()}
ORACLES = {
    "citing_range": f"WITH {_DAYS}, q AS (SELECT c_custkey AS path, unnest([100, 900]) AS r_start FROM customer) SELECT path, claim, start, stop, r_start FROM d JOIN q USING (path) WHERE start <= r_start + 29 AND r_start <= stop",
    "innermost_symbol": f"""WITH {_DAYS} SELECT path, claim, name, size FROM (SELECT p.path, p.claim, s.claim AS name, s.stop - s.start AS size,
  row_number() OVER (PARTITION BY p.path, p.claim ORDER BY s.stop - s.start, s.start DESC, s.claim) AS r FROM d p JOIN d s ON s.path = p.path AND s.start <= p.start AND s.stop >= p.start) WHERE r = 1""",
    "coverage_gaps": f"WITH {_DAYS} SELECT path, claim FROM d WHERE claim % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM d x WHERE x.claim % 3 = 0 AND x.path = d.path AND x.start <= d.stop AND d.start <= x.stop)",
    "remap_ranges": """
WITH o AS (SELECT o_orderkey, o_orderkey % 40 + 1 AS a, o_orderkey % 40 + 1 + o_orderkey % 7 AS b, o_orderkey % 5 AS n1, o_orderkey % 4 + 1 AS n2 FROM orders),
h AS (SELECT *, NOT (6 < a OR 5 > b) OR NOT (15 < a OR 15 >= b) OR NOT (32 < a OR 30 > b) AS hit,
  CASE WHEN 6 < a THEN n1 - 2 ELSE 0 END + CASE WHEN 15 < a THEN n2 ELSE 0 END + CASE WHEN 32 < a THEN -3 ELSE 0 END AS shift FROM o)
SELECT o_orderkey, CASE WHEN NOT hit THEN a + shift END AS start, CASE WHEN NOT hit THEN b + shift END AS stop FROM h""",
    "latest_per_key": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "landings_arg_max": """SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type) AS r
  FROM (SELECT user_id, event_type, count(*) AS n, min(ts) AS f FROM events GROUP BY 1, 2)) WHERE r = 1""",
    "run_length_islands": """
WITH x AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n FROM y GROUP BY 1, 2, 3""",
    "adaptive_grain": """
SELECT o_custkey, CASE WHEN count(DISTINCT o_orderdate::DATE) <= 7 THEN 'day' WHEN count(DISTINCT date_trunc('week', o_orderdate)) <= 7 THEN 'week' WHEN count(DISTINCT date_trunc('month', o_orderdate)) <= 7 THEN 'month'
  WHEN count(DISTINCT date_trunc('quarter', o_orderdate)) <= 7 THEN 'quarter' WHEN count(DISTINCT date_trunc('year', o_orderdate)) <= 7 THEN 'year' ELSE 'span' END AS grain FROM orders GROUP BY 1""",
    "top_series_others": """
WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 8)
SELECT ts::DATE::VARCHAR AS day, CASE WHEN t.user_id IS NULL THEN 'Others' ELSE t.user_id::VARCHAR END AS series, count(*) AS n FROM events e LEFT JOIN t ON t.user_id = e.user_id GROUP BY 1, 2""",
    "zoom_period": """SELECT o_custkey, period, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, period) AS r
  FROM (SELECT o_custkey, date_trunc('month', o_orderdate)::DATE::VARCHAR AS period, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r = 1""",
    "prefix_budget": """
SELECT o_custkey, o_orderkey, spent FROM (SELECT o_custkey, o_orderkey, sum(floor(o_totalprice * 100 + 0.5)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM orders) WHERE spent <= 50000000""",
    "stratified_sample": """
WITH h AS (SELECT c_custkey, c_mktsegment, substr(sha256('seed:' || c_custkey), 1, 16) AS h FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h) AS turn FROM h)
SELECT c_custkey, c_mktsegment, h FROM r ORDER BY turn, c_mktsegment LIMIT 10""",
    "reference_numbers": """
WITH f AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events)
SELECT user_id, event_id, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY first, event_type) AS number, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS occurrence FROM f""",
    "rank_with_ties": "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r = 1",
    "k_anonymous_others": """
SELECT ts::DATE::VARCHAR AS day, user_id::VARCHAR AS who, count(*) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY 1, 2
UNION ALL SELECT ts::DATE::VARCHAR, 'others', count(*) FROM events WHERE user_id % 3 = 0 GROUP BY 1 HAVING count(DISTINCT user_id) >= 5""",
    "lang_shares": "SELECT * FROM (SELECT lang, floor(sum(n_chars) * 1000.0 / (SELECT sum(n_chars) FROM documents)) / 1000 AS share FROM documents GROUP BY lang) WHERE share > 0 ORDER BY share DESC, lang LIMIT 20",
    "infobox": """
WITH p AS (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1),
o AS (SELECT c_nationkey, count(*) AS orders, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
s AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)),
t AS (SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY r) AS top_segments FROM s WHERE r <= 3 GROUP BY 1)
SELECT c_nationkey, customers, coalesce(orders, 0) AS orders, first_day, last_day, top_segments FROM p LEFT JOIN o USING (c_nationkey) JOIN t USING (c_nationkey)""",
    "revision_numbers": """
SELECT o_custkey, o_orderkey, row_number() OVER w AS number, floor((o_totalprice - lag(o_totalprice) OVER w) * 100 + 0.5) / 100 AS change FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "dedup_suffixes": r"""
WITH s AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS slug FROM n""",
} | {f"activity_{g}": _dense(t, d, g) for g, (t, d) in _ACTIVITY.items()}
