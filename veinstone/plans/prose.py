"""Names, links, sentences and numbers in texts, and paths and packages in addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions import names as N
from veinstone.functions import text as T
from veinstone.sources import manifests
from veinstone.sources.tables import table


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _text(spark, sf_dir).select("doc_id", N.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "\n"), 256).alias("h"))


def unwritten_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each document that the one numbered before it doesn't hold."""
    c = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    before = c.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("cited"))
    return c.join(before, "doc_id").select("doc_id", F.explode(N.unwritten_numbers(F.col("text"), F.col("cited"))).alias("number"))


def hook_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").where("text is not null")
    return c.select("conv_id", "turn", N.hook_text(F.col("text")).alias("hook")).where("hook is not null")


def wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in sentences made of customers' fields."""
    c, k = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment"), F.col("c_custkey")
    text = F.concat(F.lit("see [[ wp:the_"), F.lower("c_mktsegment"), F.lit("__page]] and `[[no]]`, or [["), F.col("c_name"), F.when(k % 2 == 0, F.concat(F.lit("| no "), k.cast("string"))).otherwise(""), F.lit("]]"))
    told = c.select("c_custkey", text.alias("text"))
    links = told.select("c_custkey", F.explode(N.link_tokens(F.col("text"))).alias("l"), F.element_at(N.wiki_titles(F.col("text")), 1).alias("title"), N.unlinked(F.col("text")).alias("plain"))
    return links.select("c_custkey", "l.target", "l.label", "title", "plain")


def control_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters of documents but for line feeds and tabs, by code."""
    codes = _text(spark, sf_dir).select("doc_id", F.explode(N.control_characters(F.concat("text", F.when(F.col("doc_id") % 9 == 0, "\x07‎").otherwise("")))).alias("code"))
    return codes.where("code not in ('U+000A', 'U+0009')")


def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "props")
    both = F.concat(F.lit('{"z": 1, "a": [ '), F.col("props"), F.lit(' ] }'))
    return e.select("event_id", F.sha2(N.canonical_json(both), 256).alias("request_key"))


def salted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salted keys of customers, and a fingerprint of the keys of each nation's segment."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_name")
    per = c.groupBy("c_nationkey", "c_mktsegment").agg(N.fingerprint(F.collect_set(F.concat(F.lit("name:"), F.lower("c_name")))).alias("fingerprint"))
    keyed = c.select("c_custkey", "c_nationkey", "c_mktsegment", N.salted_key(F.lit("salt"), F.concat(F.lit("name:"), F.lower("c_name"))).alias("key"))
    return keyed.join(per, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "key", "fingerprint")


def _source(page_id: Column) -> Column:
    return F.when(page_id % 3 == 0, "a.py").when(page_id % 3 == 1, "b.rs").otherwise("c.ts")


def package_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses read as import specifiers of Python, Rust and TypeScript files."""
    p = table(spark, sf_dir, "pages", "page_id", "url").where("url is not null")
    spec = F.concat(F.when(F.col("page_id") % 5 == 0, "@").otherwise(""), F.lower(F.regexp_replace("url", "^[a-z]+://", "")))
    return p.select("page_id", N.package_root(_source(F.col("page_id")), spec).alias("package"))


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock files and dependency manifests among paths made of pages' addresses."""
    p, k = table(spark, sf_dir, "pages", "page_id", "url").where("url is not null"), F.col("page_id") % 9
    name = F.element_at(F.array(*map(F.lit, ("package.json", "yarn.lock", "requirements-dev.txt", "docker-compose.prod.yml", "go.mod", "Pipfile", "notes.txt", "Cargo.lock", "xrequirements.txt"))), (k + 1).cast("int"))
    path = F.concat_ws("/", F.regexp_replace("url", "^[a-z]+://", ""), name)
    return p.select("page_id", N.is_lockfile(path).alias("lockfile"), N.manifest_kind(path).alias("kind"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned routes, and how deep in folders each page's path agrees with the next page's."""
    p, k = table(spark, sf_dir, "pages", "page_id", "url").where("url is not null"), F.col("page_id")
    p = p.groupBy("page_id").agg(F.regexp_replace(F.max("url"), "^[a-z]+://", "").alias("path"))
    route = F.concat(F.when(k % 4 == 0, "/:id/{x}").otherwise(F.concat(F.lit("/"), F.col("path"))), F.when(k % 3 == 0, "?q=1#f").otherwise(""))
    after = p.select((k - 1).alias("page_id"), F.col("path").alias("other"))
    return p.join(after, "page_id", "left").select("page_id", N.clean_route(route).alias("route"), N.shared_depth(F.col("path"), F.col("other")).alias("depth"))


def alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    aliases = F.array(F.concat(F.lit(" "), F.upper("p_brand")), F.col("p_type"), F.lower("p_type"), F.lit("  "), F.col("p_name"), F.concat("p_name", F.lit(" ")))
    return p.select("p_partkey", F.array_join(N.clean_aliases(F.col("p_brand"), aliases), "|").alias("aliases"))


def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a part's name's words and its type's: plural forms, and whether the last two words of the name stand in it as a run."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    words = F.split(F.lower("p_name"), " ")
    run = F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))
    return p.select("p_partkey", N.is_run_of(run, words).alias("in_name"), N.is_run_of(run, F.split(F.lower("p_type"), " ")).alias("in_type"), F.array_join(N.plurals(F.lower(F.element_at(words, 1))), ",").alias("plurals"))


def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey")
    return o.select("o_orderkey", N.rotation(F.sha2(F.col("o_orderkey").cast("string"), 256), F.col("o_orderkey") % 13).alias("place"), N.claim_anchor(F.concat(F.lit("c"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 10 == 0, "!").otherwise(""))).alias("anchor"))


def remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner/name of addresses made of suppliers' fields, and whether days made of them exist."""
    s, k = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), F.col("s_suppkey")
    head = F.element_at(F.array(*map(F.lit, ("https://github.com/", "git@github.com:", "ssh://git@github.com/", "https://example.org/", "HTTPS://GitHub.com/"))), (k % 5 + 1).cast("int"))
    url = F.concat(head, F.lit("own-"), F.col("s_nationkey").cast("string"), F.lit("/"), F.when(k % 11 == 0, "..").otherwise(F.concat(F.lit("re.po"), k.cast("string"))), F.when(k % 2 == 0, ".git").otherwise(""), F.when(k % 3 == 0, "/").otherwise(""))
    day = F.concat_ws("-", F.lit("1999"), F.lpad((k % 14).cast("string"), 2, "0"), F.lpad((k % 33).cast("string"), 2, "0"))
    return s.select("s_suppkey", N.remote_name(url).alias("remote"), N.is_calendar_day(day).alias("day"))


def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a tool shows them, and as one escaped line of at most 200 characters."""
    return _text(spark, sf_dir).select("doc_id", F.sha2(N.tool_text(F.col("text")), 256).alias("tool"), N.markdown_text(F.col("text"), 200).alias("line"))


def _requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as manifests: the words of a part's name are what it requires."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    path = F.concat(F.when(F.col("p_partkey") % 3 > 0, "sub/").otherwise(""), "p_brand", F.lit("/requirements.txt"))
    return manifests.declared(p.select(path.alias("path"), F.replace("p_name", F.lit(" "), F.lit(">=1\n")).alias("text")))


def declared_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requirements(spark, sf_dir)


def detected_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    words = p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("name")).distinct()
    known = words.select(F.upper("name").alias("technology"), F.lit("pypi").alias("ecosystem"), "name", F.lit(False).alias("prefix"))
    imports = p.select(F.concat_ws("/", "p_type", F.concat((F.col("p_partkey") % 50).cast("string"), F.lit(".py"))).alias("path"), F.concat(F.lower(F.substring_index("p_name", " ", 1)), F.lit(".sub")).alias("specifier"))
    return manifests.detected(_requirements(spark, sf_dir), imports, known)


def address_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared addresses, logins and bots among addresses made of customers' fields."""
    c, k = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("c_custkey")
    name = F.element_at(F.array(F.lit("Renovate"), F.col("c_mktsegment"), F.lit("x[bot]"), F.lit("Ann Lee")), (k % 4 + 1).cast("int"))
    mail = F.element_at(F.array(F.lit("noreply@github.com"), F.concat(k.cast("string"), F.lit("+al-"), k.cast("string"), F.lit("@users.noreply.github.com")), F.lit("No-Reply@x.org"), F.lit("7+codecov[bot]@users.noreply.github.com"), F.concat(F.lit("a"), k.cast("string"), F.lit("@x.org"))), (k % 5 + 1).cast("int"))
    return c.select("c_custkey", T.placeholder_email(mail).alias("shared"), T.noreply_login(mail).alias("login"), T.is_bot(name, T.noreply_login(mail)).alias("bot"), T.masked_email(mail).alias("masked"))


_A = N.ABBREVIATED
_R = """WITH r AS (SELECT DISTINCT CASE WHEN p_partkey % 3 > 0 THEN 'sub/' ELSE '' END || p_brand || '/requirements.txt' AS path, unnest(string_split(lower(p_name), ' ')) AS name FROM part)"""
_CONTROL = r"[\p{Cc}\p{Zl}\p{Zp}\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
_SPEC = "CASE WHEN page_id % 5 = 0 THEN '@' ELSE '' END || lower(regexp_replace(url, '^[a-z]+://', ''))"

QUERIES = {
    "sentence_counts": sentence_counts, "unwritten_numbers": unwritten_numbers, "hook_texts": hook_texts, "wiki_links": wiki_links, "control_codes": control_codes, "canonical_props": canonical_props,
    "salted_keys": salted_keys, "package_roots": package_roots, "file_kinds": file_kinds, "routes": routes, "alias_lists": alias_lists, "word_runs": word_runs, "rotations": rotations, "remotes": remotes, "shown_texts": shown_texts,
    "address_flags": address_flags, "declared_packages": declared_packages, "detected_technologies": detected_technologies,
}
ORACLES = {
    "address_flags": """
WITH c AS (SELECT c_custkey, ['noreply@github.com', c_custkey || '+al-' || c_custkey || '@users.noreply.github.com', 'No-Reply@x.org', '7+codecov[bot]@users.noreply.github.com', 'a' || c_custkey || '@x.org'][c_custkey % 5 + 1] AS m FROM customer)
SELECT c_custkey, c_custkey % 5 IN (0, 2) AS shared, CASE c_custkey % 5 WHEN 1 THEN 'al-' || c_custkey WHEN 3 THEN 'codecov[bot]' END AS login, c_custkey % 4 IN (0, 2) OR c_custkey % 5 = 3 AS bot,
  left(m, 1) || '***' || substr(m, instr(m, '@')) AS masked FROM c""",
    "declared_packages": _R + " SELECT path, 'requirements' AS kind, 'pypi' AS ecosystem, name FROM r",
    "detected_technologies": _R + """, e AS (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY len(string_split(path, '/')), path) AS k FROM r),
u AS (SELECT lower(split_part(p_name, ' ', 1)) AS name, count(DISTINCT p_type || '/' || (p_partkey % 50)) AS n FROM part GROUP BY 1)
SELECT upper(e.name) AS technology, path AS evidence, coalesce(n, 0) AS importers FROM e LEFT JOIN u ON u.name = e.name WHERE k = 1""",
    "sentence_counts": rf"""
WITH k AS (SELECT doc_id, regexp_replace(text, '((?:^|[\s(])(?:{_A})\.)\s+([\p{{Ll}}\d])', '\1' || chr(1) || '\2', 'g') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda p: p <> ''), lambda p: replace(p, chr(1), ' ')) AS s FROM k)
SELECT doc_id, len(s) AS n, sha256(array_to_string(s, chr(10))) AS h FROM s""",
    "unwritten_numbers": r"""
WITH n AS (SELECT DISTINCT x.doc_id, y.text AS cited, unnest(regexp_extract_all(regexp_replace(x.text, '`[^`]*`', ' ', 'g'), '\d+(?:[.,]\d+)*')) AS number FROM documents x JOIN documents y ON x.doc_id = y.doc_id + 1 WHERE y.text IS NOT NULL)
SELECT doc_id, number FROM n WHERE NOT regexp_matches(cited, '(^|[^0-9.,])' || replace(number, '.', '\.') || '($|[^0-9.,]|[.,]($|[^0-9]))')""",
    "hook_texts": r"""
WITH a AS (SELECT conv_id, turn, regexp_replace(trim(text, ' '), '[.!?:\x{2026}]+$', '') AS s FROM conversations WHERE text IS NOT NULL),
b AS (SELECT conv_id, turn, rtrim(regexp_replace(s, '[.!?:\x{2026}]+(["\x{201d}\x{2019}'')\]]+)$', '\1')) AS s FROM a)
SELECT conv_id, turn, '... that ' || CASE WHEN regexp_matches(s, '^(?:[A-Z][a-z]|A\s)') THEN lower(s[1]) || s[2:] ELSE s END || '?' AS hook FROM b
WHERE regexp_matches(s, '[\p{L}\p{N}]') AND NOT regexp_matches(s, '[.!?]\s+[A-Z]') AND NOT regexp_matches(s, '\d\.\d{5,}')""",
    "wiki_links": """
WITH c AS (SELECT c_custkey, 'wp:the_' || lower(c_mktsegment) || '__page' AS t1, c_name AS t2, CASE WHEN c_custkey % 2 = 0 THEN 'no ' || c_custkey END AS l2 FROM customer),
o AS (SELECT *, 'The ' || lower(substr(t1, 8, length(t1) - 13)) || ' page' AS title, 'see  ' || t1 || ' and `no`, or ' || coalesce(' ' || l2, t2) AS plain FROM c)
SELECT c_custkey, t1 AS target, NULL AS label, title, plain FROM o UNION ALL SELECT c_custkey, t2, l2, title, plain FROM o""",
    "control_codes": rf"""
WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text || CASE WHEN doc_id % 9 = 0 THEN chr(7) || chr(8206) ELSE '' END, '{_CONTROL}')) AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'U+' || lpad(printf('%X', unicode(c)), 4, '0') AS code FROM c WHERE c NOT IN (chr(10), chr(9))""",
    "canonical_props": """SELECT event_id, sha256('{"a":[' || json(props)::VARCHAR || '],"z":1}') AS request_key FROM events""",
    "salted_keys": """
WITH f AS (SELECT c_nationkey, c_mktsegment, sha256(string_agg(k, chr(10) ORDER BY k)) AS fingerprint FROM (SELECT DISTINCT c_nationkey, c_mktsegment, 'name:' || lower(c_name) AS k FROM customer) GROUP BY 1, 2)
SELECT c_custkey, sha256('salt' || chr(0) || 'name:' || lower(c_name)) AS key, fingerprint FROM customer JOIN f USING (c_nationkey, c_mktsegment)""",
    "package_roots": rf"""
WITH s AS (SELECT page_id, regexp_replace({_SPEC}, '[?#](.|\n)*$', '') AS s FROM pages WHERE url IS NOT NULL),
r AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN split_part(s, '.', 1) WHEN 1 THEN split_part(s, '::', 1) ELSE CASE WHEN s LIKE '@%' THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE split_part(s, '/', 1) END END AS r FROM s)
SELECT page_id, CASE WHEN length(r) <= 214 AND regexp_matches(r, CASE WHEN page_id % 3 < 2 THEN '^[A-Za-z_]\w*$' ELSE '^(?:@[a-z0-9][\w.~-]*/)?[a-z0-9][\w.~-]*$' END) THEN r END AS package FROM r""",
    "file_kinds": """SELECT page_id, page_id % 9 IN (1, 7) AS lockfile, CASE page_id % 9 WHEN 0 THEN 'package.json' WHEN 2 THEN 'requirements' WHEN 3 THEN 'compose' WHEN 4 THEN 'go.mod' WHEN 5 THEN 'pipfile' END AS kind FROM pages WHERE url IS NOT NULL""",
    "routes": r"""
WITH p AS (SELECT page_id, regexp_replace(max(url), '^[a-z]+://', '') AS path FROM pages WHERE url IS NOT NULL GROUP BY 1),
d AS (SELECT page_id, path, CASE WHEN path LIKE '%/%' THEN string_split(path, '/')[1:-2] ELSE ['.'] END AS f FROM p),
r AS (SELECT page_id, CASE WHEN page_id % 4 > 0 AND path <> '' AND regexp_replace(path, '[?#](.|\n)*$', '') <> '' THEN regexp_replace('/' || path, '[?#](.|\n)*$', '') END AS route FROM p)
SELECT x.page_id, route, len(list_filter(range(1, least(len(x.f), len(y.f)) + 1), lambda i: x.f[1:i] = y.f[1:i])) AS depth FROM d x JOIN r ON r.page_id = x.page_id LEFT JOIN d y ON y.page_id = x.page_id + 1""",
    "alias_lists": """
WITH a AS (SELECT p_partkey, list_filter(list_transform([' ' || upper(p_brand), p_type, lower(p_type), '  ', p_name, p_name || ' '], lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> lower(p_brand)) AS a FROM part)
SELECT p_partkey, array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i), '|') AS aliases FROM a""",
    "word_runs": r"""
WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w, lower(p_type) AS t, lower(p_name) AS n FROM part), r AS (SELECT *, w[1] AS a, array_to_string(w[greatest(len(w) - 1, 1):len(w)], ' ') AS run FROM w)
SELECT p_partkey, contains(' ' || n || ' ', ' ' || run || ' ') AS in_name, contains(' ' || t || ' ', ' ' || run || ' ') AS in_type, a || 's,' || a || 'es'
  || CASE WHEN regexp_matches(a, '[^aeiou]y$') THEN ',' || a[:-2] || 'ies' ELSE '' END || CASE WHEN a LIKE '%sis' AND length(a) > 4 THEN ',' || a[:-3] || 'es' ELSE '' END AS plurals FROM r""",
    "rotations": """SELECT o_orderkey, CASE WHEN o_orderkey % 13 > 0 THEN ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % (o_orderkey % 13) ELSE 0 END AS place,
  CASE WHEN o_orderkey % 10 > 0 THEN 'claim-c' || o_orderkey END AS anchor FROM orders""",
    "remotes": """
SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 3 AND s_suppkey % 11 > 0 THEN 'own-' || s_nationkey || '/re.po' || s_suppkey END AS remote,
  TRY_CAST('1999-' || lpad((s_suppkey % 14)::VARCHAR, 2, '0') || '-' || lpad((s_suppkey % 33)::VARCHAR, 2, '0') AS DATE) IS NOT NULL AS day FROM supplier""",
}
