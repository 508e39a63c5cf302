"""Dates as written, row constraints and hunks, over fields of orders, order lines and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions import checks, dates
from veinstone.functions import text as T
from veinstone.sources.tables import table


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate"), F.col("o_orderkey")
    zone = F.element_at(F.array(*map(F.lit, ("Z", "+02:00", "-05:30", "+25:00", "?"))), (k % 5 + 1).cast("int"))
    return o.withColumn("iso", dates.iso_or_null(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), zone)))


def commit_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first and last order by instant, as written; impossible offsets count as none."""
    return _dated(spark, sf_dir).where("iso is not null").groupBy("o_custkey").agg(dates.earliest(F.col("iso")).alias("first"), dates.latest(F.col("iso")).alias("last"), F.count(F.lit(1)).alias("n"))


def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dated(spark, sf_dir)
    quarter, month = F.trunc("o_orderdate", "quarter"), F.trunc("o_orderdate", "month")
    return d.select(
        "o_orderkey", dates.label(quarter, "quarter").alias("quarter"), dates.label(month, "month").alias("month"), F.date_format(dates.last_day(quarter, "quarter"), "yyyy-MM-dd").alias("quarter_end"),
        F.date_format(dates.last_day(F.trunc("o_orderdate", "year"), "year"), "yyyy-MM-dd").alias("year_end"), dates.long_form(F.col("iso")).alias("long"), dates.stale(F.col("o_orderdate"), F.lit("1997-01-01").cast("timestamp")).alias("stale"),
    )


def claim_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, " src/a.py:10-20").when(F.col("turn") % 3 == 1, " <b>").otherwise("\x01"))
    return c.select("conv_id", "turn", F.array_join(checks.claim_text(text, 100), "|").alias("problems"))


def citation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    path = F.concat(F.when(F.col("l_partkey") % 5 == 0, "/").when(F.col("l_partkey") % 5 == 1, "a/../").otherwise(""), F.lit("p"), F.col("l_partkey").cast("string"))
    start = F.col("l_quantity").cast("long") - 2
    h = F.substring(F.sha2(path, 256), F.lit(1), F.when(F.col("l_linenumber") == 2, 60).otherwise(64))
    bad = checks.citation(path, start, start + F.col("l_partkey") % 150 - 5, h)
    return li.select("l_orderkey", "l_linenumber", F.array_join(bad, "|").alias("problems"))


def document_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as claims: every fourth part is in the lead and supported by the part before it."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    lead = F.col("l_partkey") % 4 == 0
    supports = F.when(F.col("l_partkey") % 3 == 0, F.array(F.concat(F.lit("c"), (F.col("l_partkey") % 10 + 1).cast("string")))).otherwise(F.expr("cast(array() as array<string>)"))
    claims = li.select(F.col("l_orderkey").alias("revision"), F.when(lead, "lead").otherwise("body").alias("section"), (F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey")).alias("pos"), F.concat(F.lit("c"), (F.col("l_partkey") % 10).cast("string")).alias("id"), supports.alias("supports"))
    return checks.document(claims).groupBy("revision", "problem").agg(F.count(F.lit(1)).alias("n"))


def hunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    text = F.concat(F.lit("@@ -"), q, F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(","), n)).otherwise(""), F.lit(" +"), n, F.lit(",3 @@ f()\n-x\n@@ -9 +"), q, F.lit(" @@\n"))
    return li.select("l_orderkey", "l_linenumber", F.posexplode(T.hunks_of(text)).alias("pos", "h")).select("l_orderkey", "l_linenumber", "pos", "h.*")


_D = """WITH d AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ['Z', '+02:00', '-05:30', '+00:00'][o_orderkey % 5 + 1] END AS iso,
  o_orderdate + to_minutes([0, -120, 330, 0][o_orderkey % 5 + 1]) AS at_ FROM orders)"""

QUERIES = {"commit_dates": commit_dates, "period_labels": period_labels, "claim_problems": claim_problems, "citation_problems": citation_problems, "document_problems": document_problems, "hunk_rows": hunk_rows}
ORACLES = {
    "commit_dates": _D + """, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY at_, iso) AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY at_ DESC, iso) AS l FROM d WHERE iso IS NOT NULL)
SELECT o_custkey, max(iso) FILTER (f = 1) AS first, max(iso) FILTER (l = 1) AS last, count(*) AS n FROM r GROUP BY 1""",
    "period_labels": _D + """ SELECT o_orderkey, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter, strftime(o_orderdate, '%Y-%m') AS month,
  strftime(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS quarter_end, year(o_orderdate) || '-12-31' AS year_end, strftime(o_orderdate, '%-d %B %Y') || left(iso, 0) AS long,
  TIMESTAMP '1997-01-01' - o_orderdate > INTERVAL 7 DAY AS stale FROM d""",
    "claim_problems": r"""
WITH c AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' src/a.py:10-20' WHEN 1 THEN ' <b>' ELSE chr(1) END AS t FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN coalesce(trim(t, ' '), '') = '' THEN 'empty' END, CASE WHEN length(t) > 100 THEN 'too long' END, CASE WHEN regexp_matches(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN 'control character' END,
  CASE WHEN regexp_matches(t, '<[A-Za-z/!]') THEN 'markup' END, CASE WHEN regexp_matches(t, '\b[\w./-]+:[0-9]+-[0-9]+\b') THEN 'citation in the text' END], lambda x: x IS NOT NULL), '|') AS problems FROM c""",
    "citation_problems": """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT - 2 AS s, l_quantity::BIGINT - 7 + l_partkey % 150 AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_partkey % 5 < 2 THEN 'bad path' END, CASE WHEN s < 1 OR e < s THEN 'bad lines' END, CASE WHEN e - s + 1 > 120 THEN 'too many lines' END,
  CASE WHEN l_linenumber = 2 THEN 'bad hash' END], lambda x: x IS NOT NULL), '|') AS problems FROM c""",
    "document_problems": """
WITH c AS (SELECT l_orderkey AS r, l_linenumber::BIGINT * 10000000000 + l_partkey AS pos, l_partkey % 4 = 0 AS lead, 'c' || l_partkey % 10 AS id, CASE WHEN l_partkey % 3 = 0 THEN 'c' || (l_partkey % 10 + 1) END AS sup FROM lineitem),
p AS (SELECT r, 'lead is not first' AS problem FROM (SELECT r, lead, row_number() OVER (PARTITION BY r ORDER BY pos) AS k FROM c) WHERE k = 1 AND NOT lead
  UNION ALL SELECT r, 'id twice: ' || id FROM c GROUP BY r, id HAVING count(*) > 1
  UNION ALL SELECT r, 'unknown support: ' || sup FROM c x WHERE sup IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c y WHERE y.r = x.r AND NOT y.lead AND y.id = x.sup)
  UNION ALL SELECT r, 'lead without support: ' || id FROM c WHERE lead AND sup IS NULL UNION ALL SELECT r, 'support in the body: ' || id FROM c WHERE NOT lead AND sup IS NOT NULL)
SELECT r AS revision, problem, count(*) AS n FROM p GROUP BY 1, 2""",
    "hunk_rows": """
SELECT l_orderkey, l_linenumber, 0 AS pos, l_quantity::BIGINT AS old_start, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 1 END AS old_count, l_linenumber AS new_start, 3 AS new_count FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 1, 9, 1, l_quantity::BIGINT, 1 FROM lineitem""",
}
