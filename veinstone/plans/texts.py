"""Search, text, hash, redaction and JSON queries over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.functions import text as T
from veinstone.operators import search
from veinstone.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")


def bm25f_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's whole text searched in documents by source (as title) and text (as body)."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("body"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    out = search.search(search.index(docs, ["title", "body"]), asked, {"title": 3, "body": 1})
    return out.select("query_id", "id", "score")


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("source", F.explode(T.terms(F.col("text"))).alias("term"))
    return d.groupBy("source", "term").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.content_hash(F.col("text")).alias("h"))


def email_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    clean = T.without_tokens(T.without_emails(F.col("text")))
    return d.select("doc_id", (clean != F.col("text")).alias("changed"), F.sha2(clean, 256).alias("h"))


def link_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each page links to each path."""
    p = table(spark, sf_dir, "pages", "page_id", "html")
    hrefs = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return hrefs.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def near_cut_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines with digits, at most 120 characters of each."""
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).where(F.col("s").rlike("[0-9]"))
    return d.select("doc_id", (F.col("line") + 1).alias("line"), F.substring("s", 1, 120).alias("s"))


def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a pattern by line, at most 100 a source in order."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    hit = d.where(F.col("s").rlike("(?i)licen[cs]e"))
    return hit.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("doc_id", "line"))).where("r <= 100").select("source", "doc_id", (F.col("line") + 1).alias("line"))


def identifier_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least five letters found in one source only, the ten most frequent of each."""
    d = _docs(spark, sf_dir).select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("word"))
    n = d.groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"))
    only = n.groupBy("word").agg(F.count(F.lit(1)).alias("sources"), F.max("source").alias("source"), F.max("n").alias("n")).where("sources = 1 and n >= 2")
    return only.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy(F.col("n").desc(), "word"))).where("r <= 10").select("source", "word", "n")


def json_body_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_type", "props").select("event_type", F.from_json("props", "k bigint").getField("k").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def member_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "url")
    path = F.regexp_replace("url", "^[a-z]+://", "")
    member = T.member_id(path, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("s"), F.col("page_id").cast("string"))))
    return p.select("page_id", member.alias("member"), T.member_path(member).alias("path"), T.repo_path_ok(path).alias("ok"), T.test_file(F.concat(path, F.when(F.col("page_id") % 3 == 0, "/tests/a.py").otherwise(""))).alias("test"))


def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host and first directory."""
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    p = table(spark, sf_dir, "pages", "url").select(F.substring_index(rest, "/", 2).alias("folder"))
    return p.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


def estimated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "text")
    return c.groupBy("conv_id").agg(F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"))


def tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash over a conversation's sorted lines of turn and text hash. A conversation is one bounded group."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", F.concat_ws(":", F.col("turn").cast("string"), F.sha2("text", 256)).alias("line"))
    return c.groupBy("conv_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))


def commit_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull request numbers of subjects made from orders."""
    o = table(spark, sf_dir, "orders", "o_orderkey")
    k = F.col("o_orderkey").cast("string")
    subject = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Merge pull request #"), k, F.lit(" from a/b"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Fix it (#"), k, F.lit(")"))).otherwise(F.concat(F.lit("Fix #"), k))
    return o.select("o_orderkey", T.pr_number(subject).alias("pr"))


_D = "WITH d AS (SELECT doc_id, text, source, lang FROM documents)"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _terms(x: str) -> str:
    parted = rf"regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    kept = f"list_filter(string_split_regex(lower(strip_accents({parted})), '[^a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t))"
    return f"list_transform({kept}, lambda t: CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN t[1:length(t) - 3] || 'y' WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN t[1:length(t) - 1] ELSE t END)"


QUERIES = {
    "bm25f_search": bm25f_search,
    "tokenize_terms": tokenize_terms,
    "content_hash": content_hashes,
    "email_redaction": email_redaction,
    "link_tokens": link_tokens,
    "near_cut_lines": near_cut_lines,
    "grep_lines": grep_lines,
    "identifier_mining": identifier_mining,
    "json_body_extract": json_body_extract,
    "member_ids": member_ids,
    "directory_rollup": directory_rollup,
    "estimated_tokens": estimated_tokens,
    "tree_hash": tree_hash,
    "pr_numbers": commit_subjects,
}
ORACLES = {
    "bm25f_search": _D + rf""",
f AS (SELECT doc_id AS id, 'title' AS field, {_terms("coalesce(source, '')")} AS t FROM d UNION ALL SELECT doc_id, 'body', {_terms("coalesce(text, '')")} FROM d),
av AS (SELECT field, CASE WHEN avg(len(t)) > 0 THEN avg(len(t)) ELSE 1 END AS a FROM f GROUP BY 1),
p AS (SELECT id, field, term, count(*) AS tf FROM (SELECT id, field, unnest(t) AS term FROM f) GROUP BY 1, 2, 3),
q AS (SELECT DISTINCT query_id, unnest({_terms("q")}) AS term FROM (SELECT item_id AS query_id, text AS q FROM benchmark)),
df AS (SELECT term, count(DISTINCT id) AS df FROM p GROUP BY 1),
w AS (SELECT p.id, p.term, sum(CASE p.field WHEN 'title' THEN 3.0 ELSE 1.0 END * tf / (0.25 + 0.75 * len(f.t) / a)) AS w FROM p JOIN f ON f.id = p.id AND f.field = p.field JOIN av ON av.field = p.field GROUP BY 1, 2),
s AS (SELECT query_id, id, floor(sum(ln(1 + ((SELECT count(*) FROM d) - df + 0.5) / (df + 0.5)) * w * 2.2 / (w + 1.2)) * 1000000 + 0.5) / 1000000 AS score FROM q JOIN w USING (term) JOIN df USING (term) GROUP BY 1, 2)
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s WHERE score > 0) WHERE r <= 8""",
    "tokenize_terms": _D + f" SELECT source, term, count(*) AS n FROM (SELECT source, unnest({_terms('text')}) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 3",
    "content_hash": r"SELECT doc_id, sha256(regexp_replace(replace(text, E'\r\n', E'\n'), '\n\z', '')) AS h FROM documents",
    "email_redaction": r"""
WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', '[email removed]', 'g'),
  '\b(gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{20,})', '[token removed]', 'g'), '"[0-9a-f]{32,}"', '"[token removed]"', 'g') AS c FROM documents)
SELECT doc_id, c <> text AS changed, sha256(c) AS h FROM c""",
    "link_tokens": """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""",
    "near_cut_lines": _D + r""", l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS s, generate_subscripts(string_split(text, E'\n'), 1) AS line FROM d)
SELECT doc_id, line, substr(s, 1, 120) AS s FROM l WHERE regexp_matches(s, '[0-9]')""",
    "grep_lines": r"""
WITH l AS (SELECT source, doc_id, unnest(string_split(text, E'\n')) AS s, generate_subscripts(string_split(text, E'\n'), 1) AS line FROM documents)
SELECT source, doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, line) AS r FROM l WHERE regexp_matches(s, '(?i)licen[cs]e')) WHERE r <= 100""",
    "identifier_mining": _D + """,
n AS (SELECT source, word, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM d) GROUP BY 1, 2),
o AS (SELECT word, max(source) AS source, max(n) AS n FROM n GROUP BY 1 HAVING count(*) = 1 AND max(n) >= 2)
SELECT source, word, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS r FROM o) WHERE r <= 10""",
    "json_body_extract": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, (props->>'k')::BIGINT AS k FROM events) GROUP BY 1",
    "member_ids": r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
m AS (SELECT *, replace(replace(path, '%', '%25'), '#', '%23') || CASE WHEN page_id % 2 = 0 THEN '#s' || page_id ELSE '' END AS member FROM p)
SELECT page_id, member, replace(replace(split_part(member, '#', 1), '%23', '#'), '%25', '%') AS path,
  path IS NOT NULL AND path <> '' AND NOT regexp_matches(path, '(^/)|\\|(^|/)\.{0,2}(/|$)') AS ok,
  regexp_matches(path || CASE WHEN page_id % 3 = 0 THEN '/tests/a.py' ELSE '' END, '(^|/)(tests|__tests__|fixtures|__fixtures__)/|(^|/)(tests\.py|conftest\.py|test_[^/]*\.py|[^/]*_test\.py|[^/]*\.(test|spec)\.[^/]*)$') AS test FROM m""",
    "directory_rollup": "SELECT array_to_string(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1:2], '/') AS folder, count(*) AS n FROM pages GROUP BY 1",
    "estimated_tokens": "SELECT conv_id, sum(ceil(length(text) / 2.5)::BIGINT)::BIGINT AS tokens FROM conversations GROUP BY 1",
    "tree_hash": r"SELECT conv_id, sha256(string_agg(line, E'\n' ORDER BY line)) AS h FROM (SELECT conv_id, turn || ':' || sha256(text) AS line FROM conversations) GROUP BY 1",
    "pr_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey::INT END AS pr FROM orders",
}
