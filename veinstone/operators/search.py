"""BM25F ranked search over an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.functions.numbers import rounded
from veinstone.functions.text import terms
from veinstone.operators.lineage import written
from veinstone.operators.spreading import spread

#: At most so many rows of queries' terms are sent to all executors.
BROADCAST_ASKED = 500_000


class SearchIndex:
    """analysed(id, field, terms array, len), averages(field, avg), n documents."""

    def __init__(self, analysed: DataFrame, averages: DataFrame, n: int):
        self.analysed, self.averages, self.n = analysed, averages, n


def index(docs: DataFrame, fields: list[str], analyse=terms) -> SearchIndex:
    """An index of docs(id, fields...); null fields count as empty. Average lengths are over all documents, 1 where 0.

    Texts are analysed once and written to the shared folder."""
    each = docs.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), analyse(F.coalesce(F.col(f), F.lit(""))).alias("t")) for f in fields])).alias("x"))
    each = written(each.select("id", "x.field", F.col("x.t").alias("terms"), F.size("x.t").alias("len")))
    averages = each.groupBy("field").agg(F.avg("len").alias("avg")).select("field", F.when(F.col("avg") > 0, F.col("avg")).otherwise(1.0).alias("avg"))
    return SearchIndex(each, averages, docs.count())


def search(idx: SearchIndex, queries: DataFrame, boosts: dict[str, float], limit: int = 8, k1: float = 1.2, b: float = 0.75, analyse=terms, places: int = 6) -> DataFrame:
    """(query_id, id, score, rank) of queries(query_id, query): the best by score, ties by id; scores of 0 never.

    A term's weight in a document is the sum over fields of boost * tf / (1 - b + b * length / average),
    its idf ln(1 + (n - df + 0.5) / (df + 0.5)). Scores are rounded to so many places before they are ranked, as they are
    added up in no set order. Only asked terms are shuffled, once, by document: a document's counts, weights and scores are then added up where
    they are, by tasks that hold about as many terms, or pairs of a document and a query, whatever the input. Queries' terms are sent to all executors up to BROADCAST_ASKED rows, else joined by term.
    """
    asked = written(queries.select("query_id", F.explode(F.array_distinct(analyse(F.col("query")))).alias("term")))
    near = F.broadcast if asked.count() <= BROADCAST_ASKED else (lambda x: x)
    said = idx.analysed.select("id", "field", "len", F.explode("terms").alias("term")).join(near(asked.select("term").distinct()), "term", "left_semi")
    n = idx.analysed.agg(F.sum(F.col("len").cast("long"))).first()[0] or 0
    hit = spread(said.repartition("id"), n, "id").groupBy("id", "term", "field", "len").agg(F.count(F.lit(1)).alias("tf"))
    boost: Column = F.create_map(*[x for f, v in boosts.items() for x in (F.lit(f), F.lit(float(v)))])[F.col("field")]
    norm = 1 - b + b * F.col("len") / F.col("avg")
    weights = written(hit.join(F.broadcast(idx.averages), "field").groupBy("id", "term").agg(F.sum(boost * F.col("tf") / norm).alias("w")))
    df = written(weights.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = F.log(1 + (F.lit(float(idx.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    told = asked.join(df, "term").groupBy("term").agg(F.max(idf).alias("idf"), F.collect_list("query_id").alias("query_ids"))
    # a document meets each query once at most, and as often as it has asked terms at most
    met = min(idx.n * asked.select("query_id").distinct().count(), asked.join(df, "term").agg(F.sum("df")).first()[0] or 0)
    part = spread(weights.repartition("id"), met, "id").join(near(told), "term").select("id", F.explode("query_ids").alias("query_id"), (F.col("idf") * F.col("w") * (k1 + 1) / (F.col("w") + k1)).alias("s"))
    scores = part.groupBy("id", "query_id").agg(rounded(F.sum("s"), places).alias("score")).where("score > 0")
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= limit)
