"""JSON lines, read so that only a torn last line of a file is forgiven."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the schema. A bad line is an error, but for the last of a file: an append that did not end.

    Only bad lines, and the ends of the files that hold them, are looked at twice; good ones stream through."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    ok = F.try_parse_json("value").isNotNull()
    bad = raw.where(~ok).select("file", F.struct("block", "at").alias("place"))
    if not bad.isEmpty():
        ends = raw.join(bad.select("file").distinct(), "file", "left_semi").groupBy("file").agg(F.max(F.struct("block", "at")).alias("end"))
        torn = bad.join(ends, "file").where("place <> end").select("file").first()
        if torn:
            raise ValueError(f"bad line in {torn['file']}")
    return raw.where(ok).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row")).select("row.*")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
