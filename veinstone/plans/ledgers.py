"""Ledger, evaluation, usage, integrity, set and stateful queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.functions import cost
from veinstone.functions.numbers import rounded
from veinstone.operators import identity, integrity, ledger, stateful
from veinstone.operators.spreading import spread
from veinstone.sources.tables import table


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as model calls: user turns in, assistant turns out."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    n = F.ceil(F.length("text") / 2.5).cast("long")
    tin, tout = F.when(F.col("role") == "user", n).otherwise(F.lit(0)), F.when(F.col("role") != "user", n).otherwise(F.lit(0))
    out = c.select((F.col("conv_id") % 7).alias("run"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), (F.col("turn") % 2 == 0).alias("batch"), tin.cast("long").alias("tin"), tout.cast("long").alias("tout"), F.when(F.col("conv_id") % 5 == 0, "model-1-20250101").when(F.col("conv_id") % 5 == 1, "other").otherwise("model-2").alias("model"),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("k"), (F.col("conv_id") % 11).cast("string"))).alias("request_key"), (F.col("turn") % 3 == 0).alias("collected"))
    zero = F.lit(0).cast("long")
    return out.withColumn("micros", cost.micros(cost.usd(F.col("model"), F.col("tin"), F.col("tout"), zero, zero, F.col("batch"))))


def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.totals(_ledger(spark, sf_dir), "model")


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.run_totals(_ledger(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, doc = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents", "doc_id", "n_chars", "lang")
    j = lab.join(doc, "doc_id")
    pair = F.array(F.struct(F.lit("wiki").alias("agent"), F.col("quality").alias("correct"), F.floor(F.col("n_chars") / 10).cast("long").alias("tokens")), F.struct(F.lit("repo").alias("agent"), (1 - F.col("toxic")).alias("correct"), F.col("n_chars").alias("tokens")))
    out = j.select("doc_id", "lang", F.explode(pair).alias("p")).select("doc_id", "lang", "p.*")
    return out.withColumn("usd", F.when((F.col("agent") == "repo") & (F.col("doc_id") % 97 == 0), F.lit(None).cast("double")).otherwise(F.col("tokens") * 1e-6))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ledger.agent_summary(_records(spark, sf_dir))
    return s.select("agent", "answered", "judged", "correct", rounded(F.col("accuracy"), 6).alias("accuracy"), rounded(F.col("mean_tokens"), 4).alias("mean_tokens"), rounded(F.col("mean_usd"), 8).alias("mean_usd"))


def eval_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.passes(ledger.agent_summary(_records(spark, sf_dir)), "wiki", "repo")


def eval_by_kind_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).groupBy("lang", "agent", "correct").agg(F.count(F.lit(1)).alias("n"))
    out = r.rollup("lang").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("correct", F.lit(0))).alias("correct"))
    return out.select(F.coalesce("lang", F.lit("total")).alias("lang"), "n", "correct")


def usage_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("""
SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%') AS urgent,
  cast(sum(CASE WHEN o_orderstatus = 'P' THEN floor(o_totalprice) ELSE 0 END) AS bigint) AS pending, (SELECT count(*) FROM {orders}) AS all_orders
FROM {orders} GROUP BY o_custkey""", orders=table(spark, sf_dir, "orders"))


def cost_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job counts for: the larger of its cap and what is settled and open while active; settled, spent or 0 after."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_linestatus")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    per = li.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_linestatus") == "F", cents).otherwise(0)).alias("settled"), F.sum(F.when(F.col("l_linestatus") != "F", cents).otherwise(0)).alias("open"))
    o = table(spark, sf_dir, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    s, n, cap = F.coalesce("settled", F.lit(0)), F.coalesce("open", F.lit(0)), F.floor(F.col("o_totalprice") * 100).cast("long")
    worth = F.when(F.col("o_orderstatus") == "O", F.greatest(F.when(F.year("o_orderdate") >= 1998, cap).otherwise(0), s + n)).when(s > 0, s).when(F.year("o_orderdate") >= 1998, n).otherwise(0)
    return o.select("o_orderkey", worth.cast("long").alias("cost"))


def daily_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderdate", "o_totalprice")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n"))


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, lab = table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id")
    pages = table(spark, sf_dir, "pages", "page_id").withColumnRenamed("page_id", "doc_id")
    return integrity.violations(lab.select("doc_id"), pages, "doc_id", "label without page").union(integrity.violations(docs.select("doc_id"), lab, "doc_id", "document without label"))


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_name", "p_brand")
    return integrity.duplicates(p, ["p_name", "p_brand"])


def set_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by what an update does to them: rewrite (late orders), whole (early ones only), carried (none)."""
    c, o = table(spark, sf_dir, "customer", "c_custkey"), table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").withColumnRenamed("o_custkey", "c_custkey")
    return integrity.partitioned(c, o.where("o_orderdate >= timestamp'2001-01-01'").select("c_custkey"), o.where("o_orderdate < timestamp'1996-01-01'").select("c_custkey"), "c_custkey")


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose set of parts holds that of another order of the same customer."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 10).alias("item"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(spread(li, li.count(), "o_orderkey"), "o_orderkey")
    return integrity.contained(orders, "o_custkey", "o_orderkey", "item").select("o_orderkey", "other")


def alias_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of part names with what they stand for: one part a redirect, several a choice."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    s = p.select(F.regexp_replace(F.lower(F.concat_ws(" ", "p_name", "p_brand")), "[^a-z0-9]+", "-").alias("slug"), F.col("p_partkey").alias("id"))
    out = s.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return out.select("slug", "n", "first", F.when(F.col("n") == 1, "redirect").otherwise("disambiguation").alias("state"))


def identity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.pairs(_authors(spark, sf_dir)).select("name", "email", "n")


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits: users under some names and addresses each."""
    u, k = F.col("user_id"), F.col("event_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("User Number"), u.cast("string"))).when(k % 4 == 1, F.concat(F.lit("u"), u.cast("string"))).when(u % 17 == 3, F.concat(F.lit("helper"), u.cast("string"), F.lit("[bot]"))).otherwise(F.concat(F.lit(" User  Number"), u.cast("string")))
    email = F.when(k % 3 == 0, F.concat(F.lit("u"), u.cast("string"), F.lit("@users.noreply.github.com"))).when(k % 3 == 1, F.lit("noreply@github.com")).otherwise(F.concat(F.lit("Mail"), (u % 40).cast("string"), F.lit("@example.com")))
    return table(spark, sf_dir, "events", "event_id", "user_id", "ts").select(name.alias("name"), email.alias("email"), F.col("ts").alias("at"))


def resolved_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the rules chain through components over several kinds of keys (tested against a union-find)."""
    return identity.resolved(identity.pairs(_authors(spark, sf_dir)))


def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    return stateful.rate_limited(e, "user_id", "ts", 3600, 3).select("event_id", "limited")


def dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    return stateful.first_within(e, ["user_id", "event_type"], "ts", "event_id", 7 * 86400).select("event_id", "user_id", "event_type")


def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's job folded over its events in order (no SQL: a stateful fold)."""
    return stateful.job_states(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts"))


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscription events that arrive in event_id order, applied only if not older than the last applied."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "value")
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    old = F.max("value").over(w)
    return e.select("event_id", (old.isNull() | (F.col("value") >= old)).alias("applied"))


def running_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    return e.select("event_id", F.sum(step).over(w).alias("running"))


_L = """
WITH l AS (SELECT conv_id % 7 AS run, conv_id * 1000 + turn AS seq, turn % 2 = 0 AS batch, CASE WHEN role = 'user' THEN ceil(length(text) / 2.5)::BIGINT ELSE 0 END AS tin,
  CASE WHEN role <> 'user' THEN ceil(length(text) / 2.5)::BIGINT ELSE 0 END AS tout, CASE conv_id % 5 WHEN 0 THEN 'model-1-20250101' WHEN 1 THEN 'other' ELSE 'model-2' END AS model,
  CASE WHEN turn % 3 = 0 THEN 'k' || conv_id % 11 END AS request_key, turn % 3 = 0 AS collected FROM conversations),
c AS (SELECT *, ceil((CASE model WHEN 'model-1-20250101' THEN tin * 1.0::DOUBLE + tout * 5.0::DOUBLE WHEN 'model-2' THEN CASE WHEN tin > 100000 THEN tin * 0.5::DOUBLE + tout * 2.5::DOUBLE ELSE tin * 0.1::DOUBLE + tout * 0.5::DOUBLE END END)
  / 1e6::DOUBLE * CASE WHEN batch THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * 1e6::DOUBLE - 1e-6::DOUBLE)::BIGINT AS micros FROM l)
"""
_SUM = "count(*) AS calls, count(*) FILTER (batch) AS batch_calls, sum(tin)::BIGINT AS tokens_in, sum(tout)::BIGINT AS tokens_out, sum(micros)::BIGINT AS micros, count(*) FILTER (micros IS NULL) AS unpriced"
_R = """
WITH r AS (SELECT doc_id, lang, 'wiki' AS agent, quality AS correct, n_chars // 10 AS tokens FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, lang, 'repo', 1 - toxic, n_chars FROM labels JOIN documents USING (doc_id)),
u AS (SELECT *, CASE WHEN agent = 'repo' AND doc_id % 97 = 0 THEN NULL ELSE tokens * 1e-6 END AS usd FROM r)
"""
_A = """
WITH a AS (SELECT event_id, user_id AS u, trim(CASE WHEN event_id % 4 = 0 THEN 'User Number' || user_id WHEN event_id % 4 = 1 THEN 'u' || user_id WHEN user_id % 17 = 3 THEN 'helper' || user_id || '[bot]' ELSE ' User  Number' || user_id END) AS name,
  lower(CASE WHEN event_id % 3 = 0 THEN 'u' || user_id || '@users.noreply.github.com' WHEN event_id % 3 = 1 THEN 'noreply@github.com' ELSE 'Mail' || user_id % 40 || '@example.com' END) AS email FROM events)
"""

QUERIES = {
    "ledger_totals": ledger_totals,
    "run_totals": run_totals,
    "eval_summary": eval_summary,
    "eval_pass": eval_pass,
    "eval_by_kind_total": eval_by_kind_total,
    "usage_filtered_counts": usage_filtered_counts,
    "cost_case": cost_case,
    "daily_spend": daily_spend,
    "fk_violations": fk_violations,
    "duplicate_keys": duplicate_keys,
    "set_partition": set_partition,
    "set_containment": containment,
    "alias_multimap": alias_multimap,
    "identity_pairs": identity_pairs,
    "resolved_identities": resolved_identities,
    "rate_limited": rate_limited,
    "dedup_ttl": dedup_ttl,
    "state_machine": state_machine,
    "late_events": late_events,
    "running_cap": running_cap,
}
ORACLES = {
    "ledger_totals": _L + f"SELECT model, {_SUM} FROM c GROUP BY model",
    "run_totals": _L + f"SELECT run, {_SUM} FROM (SELECT *, first_value(run) OVER (PARTITION BY request_key ORDER BY seq) AS f FROM c) WHERE NOT (collected AND request_key IS NOT NULL AND f <> run) GROUP BY run",
    "eval_summary": _R + """SELECT agent, count(*) AS answered, count(correct) AS judged, coalesce(sum(correct), 0)::BIGINT AS correct, floor(sum(correct) / count(correct) * 1000000 + 0.5) / 1000000 AS accuracy,
  floor(avg(tokens) * 10000 + 0.5) / 10000 AS mean_tokens, CASE WHEN count(*) = count(usd) THEN floor(avg(usd) * 100000000 + 0.5) / 100000000 END AS mean_usd FROM u GROUP BY agent""",
    "eval_pass": _R + """, s AS (SELECT sum(correct) FILTER (agent = 'wiki') AS cw, sum(correct) FILTER (agent = 'repo') AS cr, sum(tokens) FILTER (agent = 'wiki') AS tw, sum(tokens) FILTER (agent = 'repo') AS tr FROM u)
SELECT cw::BIGINT AS correct_w, cr::BIGINT AS correct_r, tw::BIGINT AS tokens_w, tr::BIGINT AS tokens_r, coalesce(cr > 0 AND 100 * cw >= 90 * cr AND 100 * tw <= 40 * tr, false) AS pass FROM s""",
    "eval_by_kind_total": _R + "SELECT coalesce(lang, 'total') AS lang, count(*) AS n, sum(coalesce(correct, 0))::BIGINT AS correct FROM u GROUP BY GROUPING SETS ((lang), ())",
    "usage_filtered_counts": """SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority LIKE '1%') AS urgent,
  sum(CASE WHEN o_orderstatus = 'P' THEN floor(o_totalprice) ELSE 0 END)::BIGINT AS pending, (SELECT count(*) FROM orders) AS all_orders FROM orders GROUP BY o_custkey""",
    "cost_case": """
WITH p AS (SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'F' THEN floor(l_extendedprice * 100 + 0.5)::BIGINT ELSE 0 END) AS s, sum(CASE WHEN l_linestatus <> 'F' THEN floor(l_extendedprice * 100 + 0.5)::BIGINT ELSE 0 END) AS n FROM lineitem GROUP BY 1),
j AS (SELECT o.*, coalesce(s, 0) AS s, coalesce(n, 0) AS n, year(o_orderdate) >= 1998 AS late FROM orders o LEFT JOIN p ON l_orderkey = o_orderkey)
SELECT o_orderkey, (CASE WHEN o_orderstatus = 'O' THEN greatest(CASE WHEN late THEN floor(o_totalprice * 100)::BIGINT ELSE 0 END, s + n) WHEN s > 0 THEN s WHEN late THEN n ELSE 0 END)::BIGINT AS cost FROM j""",
    "daily_spend": "SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(floor(o_totalprice * 100 + 0.5)::BIGINT)::BIGINT AS cents, count(*) AS n FROM orders GROUP BY 1",
    "fk_violations": """SELECT doc_id, 'label without page' AS problem FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)
UNION ALL SELECT doc_id, 'document without label' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "duplicate_keys": "SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1",
    "set_partition": """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= '2001-01-01') THEN 'rewrite'
  WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < '1996-01-01') THEN 'whole' ELSE 'carried' END AS fate FROM customer""",
    "set_containment": """
WITH s AS (SELECT DISTINCT o_custkey, o_orderkey, l_partkey % 10 AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey), n AS (SELECT o_orderkey, o_custkey, count(*) AS n FROM s GROUP BY 1, 2)
SELECT x.o_orderkey, y.o_orderkey AS other FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.b = y.b AND x.o_orderkey <> y.o_orderkey JOIN n ON n.o_orderkey = y.o_orderkey GROUP BY 1, 2, n.n HAVING count(*) = n.n""",
    "alias_multimap": r"""SELECT regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g') AS slug, count(*) AS n, min(p_partkey) AS first,
  CASE WHEN count(*) = 1 THEN 'redirect' ELSE 'disambiguation' END AS state FROM part GROUP BY 1""",
    "identity_pairs": _A + "SELECT name, email, count(*) AS n FROM a GROUP BY 1, 2",
    "rate_limited": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) > 3 AS limited FROM events",
    "dedup_ttl": """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
k AS (SELECT user_id, event_type, r, event_id, ts, ts AS last, true AS keep FROM o WHERE r = 1
  UNION ALL SELECT o.user_id, o.event_type, o.r, o.event_id, o.ts, CASE WHEN o.ts >= k.last + INTERVAL 7 DAY THEN o.ts ELSE k.last END, o.ts >= k.last + INTERVAL 7 DAY
  FROM k JOIN o ON o.user_id = k.user_id AND o.event_type = k.event_type AND o.r = k.r + 1)
SELECT event_id, user_id, event_type FROM k WHERE keep""",
    "late_events": "SELECT event_id, coalesce(value >= max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS applied FROM events",
    "running_cap": "SELECT event_id, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM events",
}
