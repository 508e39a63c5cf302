"""From raw documents to a training mix: quality, exact and near duplicates, decontamination, mixing.

Each stage reads all that the one before kept and returns the columns of documents; the last adds
copy_no, one row for each time a document is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm import cuckoo, mixing, partenum, quality, templates
from veinstone.operators.lineage import written
from veinstone.sources.tables import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned on these documents' labels, accepts."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


#: A list of dropped documents of at most so many ids (8 MB) is sent to all executors; a longer one is joined by shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those whose doc_id is in ids; rows without doc_id stay."""
    gone = written(ids.select(F.col("doc_id").alias("_gone")).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the one with the smallest doc_id, or one of those without if none has one. Of repeated
    rows of one doc_id, one of each text that stays."""
    groups = written(cuckoo.exact_groups(docs))
    # rows that their doc_id does not tell apart are judged by text; the others by doc_id alone
    shared = written(groups.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_gone")))
    odd = docs.join(shared, F.col("doc_id") == F.col("_gone"), "left_semi").unionByName(docs.where("doc_id is null"))
    digest = odd.select(F.struct(*[odd[c] for c in odd.columns]).alias("row"), F.sha2(cuckoo.normalised(odd["text"]), 256).alias("digest"), odd["doc_id"].alias("id"))
    stay = groups.where("kept").select(F.col("text_sha256").alias("digest"), F.col("keep_id").alias("stays")).distinct()
    one = digest.join(stay, "digest").where(F.col("id").eqNullSafe(F.col("stays"))).dropDuplicates(["digest"]).select("row.*")
    plain = _without(docs.where("doc_id is not null"), groups.where(~F.col("kept")).select("doc_id").union(shared))
    return plain.unionByName(one)


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(docs with _key and _odd, whether any row is odd). _key tells documents apart: the doc_id, where no other row has it; else a hash of the text, 61 bits above all doc_ids, so that rows without
    doc_id and different texts under one doc_id are documents of their own, and repeated rows are one."""
    shared = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_shared")))
    n = shared.count()
    side = F.broadcast(shared) if n <= BROADCAST_IDS else shared
    marked = docs.join(side, F.col("doc_id") == F.col("_shared"), "left")
    by_text = F.lit(2**62) + F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit(2**61 - 1))
    odd = F.col("doc_id").isNull() | F.col("_shared").isNotNull()
    keyed = marked.withColumns({"_odd": odd, "_key": F.when(odd, by_text).otherwise(F.col("doc_id"))}).drop("_shared")
    return keyed, n > 0 or not docs.where("doc_id is null").isEmpty()


def _dropped(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """keyed but the rows whose _key is among ids(doc_id)."""
    gone = written(ids.select(F.col("doc_id").alias("_gone")).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return keyed.join(side, F.col("_key") == F.col("_gone"), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar shingle sets, the document with the smallest doc_id. Rows that doc_id doesn't tell apart are judged by text, and come behind; of repeated rows one stays."""
    keyed, some_odd = _keyed(docs)
    links = partenum.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    out = _dropped(keyed, links.where("component_id <> doc_id"))
    if not some_odd:
        return out.select(*docs.columns)
    return out.where("not _odd").unionByName(out.where("_odd").dropDuplicates(["_key"])).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, reworded or not. Rows that doc_id doesn't tell apart are judged by text."""
    keyed, _ = _keyed(docs)
    found = templates.contaminated(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _dropped(keyed, found).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate takes it."""
    mix = mixing.mixed(docs).where("copies > 0")
    return mix.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
]
#: The first stage's classifier and the third's and fourth's hashing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
ORACLES: dict[str, str] = {}
