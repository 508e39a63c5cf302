"""URL filtering: association rules over URL tokens, mined by FP-growth, matched through an inverted index.

DataFrame and SQL functions only, with Spark's own FP-growth.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.operators.lineage import written

#: The item that marks a labelled-bad URL in a transaction; no token can hold a space.
BAD = "is bad"
#: Host and path prefix, with the verdict. A rule fits its host and all its subdomains.
POLICY = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host_: Column, path_: Column) -> Column:
    """Distinct tokens: h:label for each label of the host and each part of a hyphenated one, p:word for each word of the path.

    Numbers in the path, which only tell pages of a site apart, become p:#."""
    labels = F.filter(F.split(host_, r"\."), lambda x: x != "")
    parts = F.filter(F.split(host_, r"[.-]"), lambda x: x != "")
    words = F.filter(F.split(F.lower(path_), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    words = F.transform(words, lambda x: F.when(x.rlike(r"^[0-9]+$"), F.lit("#")).otherwise(x))
    return F.array_distinct(
        F.concat(
            F.transform(F.concat(labels, parts), lambda x: F.concat(F.lit("h:"), x)),
            F.transform(words, lambda x: F.concat(F.lit("p:"), x)),
        )
    )


def _merged(labelled: DataFrame, min_count: int) -> DataFrame:
    """(row, bad, token) of labelled(row, tokens, bad): tokens on at least min_count bad rows, one of those that occur on the same rows.

    Words of a fixed path, say, always come together: sets of them say no more than one does, but would double the sets to mine
    with each word. Equal rows are told by count and a sum of hashes; the first token by name stands for the others.
    """
    spread = labelled.select("row", "bad", F.explode("tokens").alias("token"))
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(38,0)"))
    told = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bad"), 1)).alias("worse"), mark(1).alias("x"), mark(2).alias("y"))
    first = told.where(F.col("worse") >= min_count).groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token")
    return spread.join(first, "token", "left_semi")


def mine_rules(labelled: DataFrame, min_count: int = 10, min_confidence: float = 0.6, min_lift: float = 1.5) -> DataFrame:
    """(rule_id, tokens array, n_tokens, key string, support, confidence, lift) from labelled(row, tokens array, bad boolean), row unique.

    Token sets that occur on at least min_count bad URLs, of which at least min_confidence are bad, min_lift times more than
    by chance. A rule goes when a rule on one of its tokens less is at least as confident; of tokens on the same labelled URLs only one is in rules. key is the token by which the
    inverted index finds the rule: its rarest one. Empty if nothing is labelled or nothing passes.
    """
    n = labelled.count()
    rows = written(_merged(labelled.where("bad is not null"), min_count))
    baskets = rows.groupBy("row", "bad").agg(F.collect_list("token").alias("items"))
    baskets = baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    # rows without such a token count too, for how often a URL is bad by chance
    bare = labelled.where("bad is not null").join(rows.select("row").distinct(), "row", "left_anti")
    baskets = baskets.union(bare.select(F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.expr("cast(array() as array<string>)"))))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_count - 0.5) / max(1, n)), minConfidence=min_confidence).fit(baskets)
    rules = (
        model.associationRules.where(F.array_contains("consequent", BAD)).where(F.col("lift") >= min_lift)
        .select(F.sort_array("antecedent").alias("tokens"), "support", "confidence", "lift")
    )
    rules = written(rules.withColumn("rule_id", F.sha2(F.array_join("tokens", " "), 256)).withColumn("n_tokens", F.size("tokens")))
    # a rule against those on one token less, through the rule without each of its tokens in turn
    shorter = rules.select("rule_id", "confidence", F.explode("tokens").alias("out"), "tokens").where(F.size("tokens") > 1)
    shorter = shorter.withColumn("smaller", F.sha2(F.array_join(F.array_remove("tokens", F.col("out")), " "), 256))
    better = rules.select(F.col("rule_id").alias("smaller"), F.col("confidence").alias("has"))
    covered = shorter.join(better, "smaller").where("has >= confidence").select("rule_id").distinct()
    rules = rules.join(covered, "rule_id", "left_anti")
    freq = rows.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    keys = rules.select("rule_id", F.explode("tokens").alias("token")).join(freq, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    return rules.join(keys, "rule_id")


def blocked_by(pages: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """(by, rule_confidence) of pages(by, tokens), by unique, on which some rule's tokens all occur.

    The inverted index is the rules by key token; a page looks up each of its tokens and checks the
    rules found there. A page meets only rules whose rarest token it has, so a frequent token brings
    few. Spark sends the index to all executors if it is below the broadcast threshold, else joins by
    shuffle and splits hot tokens.
    """
    index = rules.select(F.col("key").alias("token"), F.col("tokens").alias("needed"), "confidence")
    found = pages.select(*by, "tokens", F.explode("tokens").alias("token")).join(index, "token")
    found = found.where(F.size(F.array_except("needed", "tokens")) == 0)
    return found.groupBy(*by).agg(F.max("confidence").alias("rule_confidence"))


def policy_rule(host_: Column, path_: Column, policy=POLICY) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest policy rule that fits, nulls if none does.

    The rules are few, so they stay one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(policy, key=lambda r: len(r[0] + r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, labels: DataFrame, policy=POLICY, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_confidence for every row of pages(page_id, url); other columns are ignored.

    labels(page_id, bad boolean) are what rules are mined from, one vote for each pair of page_id and URL (bad if any label says so);
    unlabelled pages and those without page_id take no part in that. A policy rule decides first, then a mined rule blocks, else the page is allowed.
    Mined rules judge each distinct pair of host and path, so rows of one page_id with different URLs are judged apart, rows without page_id too. Null or
    odd urls have empty host and path and no tokens. Repeated rows each give a row. URLs may be of any length: tokens that are rare among labelled URLs cost nothing.
    """
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    votes = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = urls.join(votes, "page_id").select("page_id", "host", "path", "bad").distinct()
    known = known.select(F.xxhash64("page_id", "host", "path").alias("row"), url_tokens(F.col("host"), F.col("path")).alias("tokens"), "bad")
    rules = mine_rules(written(known), **mining)
    told = urls.select("host", "path").distinct().withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    hits = blocked_by(told, rules, ["host", "path"])
    rule, verdict = policy_rule(F.col("host"), F.col("path"), policy)
    out = urls.join(hits, ["host", "path"], "left").withColumn("rule", rule).withColumn("said", verdict)
    mined = F.when(F.col("rule_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", mined).alias("verdict"), F.col("rule_confidence").alias("mined_confidence"))
