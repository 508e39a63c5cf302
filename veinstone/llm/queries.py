"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm import ann, backoff, crosstok, cuckoo, fim, langid, mixing, partenum, pii, quality, templates, tokens, urls
from veinstone.sources.tables import table


def token_file() -> str:
    """The vocabulary of the registered token count."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by stupid backoff, orders 1 to 3, under the counts of all other texts."""
    return backoff.backoff_scores(table(spark, sf_dir, "documents", "doc_id", "text"), order=3, stable=True)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; copies is how often it is taken."""
    out = mixing.mixed(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url. The labels of a page are those of the document with its number: bad if of low quality or toxic, about a
    quarter of all; so a rule need not make most of its pages bad, but must find them 1.4 times more often than chance."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where("bad is not null")
    return urls.judged(table(spark, sf_dir, "pages", "page_id", "url"), bad, min_confidence=0.3, min_lift=1.4)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, by a network learned on documents not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return langid.predicted(docs, langid.fit(docs))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text, learned from labels of documents not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts equal but for white space, one row for each document."""
    return cuckoo.exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts with similar shingle sets, one row for each document."""
    return partenum.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base matches and added spans of personal data in every whole text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.personal_spans(docs, pii.fit(docs))


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds, reworded or not."""
    return templates.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    return tokens.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), token_file())


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut in three and rearranged, and what comes back from the output alone."""
    out = fim.transformed(table(spark, sf_dir, "documents", "doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens of two vocabularies aligned, and its links weighed by how many documents hold them."""
    import public_tokenizers

    paths = [str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return crosstok.scored(table(spark, sf_dir, "documents", "doc_id", "text"), *paths)


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, through learned partitions."""
    return ann.search(ann.build(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20))


QUERIES = {
    "op1_backoff_scores": op1_backoff_scores,
    "op2_mixing": op2_mixing,
    "op3_url_rules": op3_url_rules,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_personal_data": op8_personal_data,
    "op9_template_leaks": op9_template_leaks,
    "op10_token_counts": op10_token_counts,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_cross_tokenizer": op12_cross_tokenizer,
    "op13_nearest": op13_nearest,
}
ORACLES = {
    "op2_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS r FROM s),
l AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM o),
e AS (SELECT coalesce(min(r) FILTER (rest * w / heavy <= most), 1000000000) AS first FROM l),
t AS (SELECT source, source_size, CASE WHEN r < first THEN most ELSE least((SELECT rest / heavy FROM l WHERE r = (SELECT first FROM e)) * w, most) END AS target FROM l, e),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
b AS (SELECT *, lpad(lower(hex(floor((rate - floor(rate)) * 281474976710656.0::DOUBLE)::BIGINT)), 12, '0') AS below FROM r),
c AS (SELECT d.doc_id, d.size, b.*, sha256('20240229:' || d.doc_id) AS h FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
k AS (SELECT source, k, abs(floor(any_value(rate)) * any_value(source_size) + sum(CASE WHEN substr(h, k, 12) < below THEN size ELSE 0 END) - any_value(target)) AS off
  FROM c, range(1, 49) AS g(k) GROUP BY source, k),
p AS (SELECT source, min(struct_pack(off := off, k := k)).k AS k FROM k GROUP BY source),
f AS (SELECT doc_id, size, source_size, target, floor(rate)::BIGINT + CASE WHEN substr(h, p.k, 12) < below THEN 1 ELSE 0 END AS copies FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM f""",
    "op6_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM t""",
    "op11_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
d AS (SELECT *, len(u)::BIGINT AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT for k in [0, 1, 2, 3]] AS r FROM t),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p""",
}
