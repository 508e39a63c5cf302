"""Roll-ups of a ledger of model calls, and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def totals(ledger: DataFrame, *keys: str) -> DataFrame:
    """keys, calls, batch_calls, tokens_in, tokens_out, micros, unpriced of ledger(batch, tin, tout, micros)."""
    return ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("batch"), 1)).alias("batch_calls"), F.sum("tin").alias("tokens_in"),
        F.sum("tout").alias("tokens_out"), F.sum("micros").alias("micros"), F.count(F.when(F.col("micros").isNull(), 1)).alias("unpriced"),
    )


def run_totals(ledger: DataFrame) -> DataFrame:
    """totals by run of ledger(run, seq, request_key, collected, ...), without rows that only collect what another, earlier run counted."""
    first = F.min_by("run", "seq").over(W.partitionBy("request_key"))
    keep = ~(F.col("collected") & F.col("request_key").isNotNull() & (F.col("_first") != F.col("run")))
    return totals(ledger.withColumn("_first", first).where(keep), "run")


def agent_summary(records: DataFrame) -> DataFrame:
    """agent, answered, judged, correct, accuracy, mean_tokens, mean_usd of records(agent, correct, tokens, usd).

    correct is null if not judged; mean_usd null as soon as one price is unknown."""
    out = records.groupBy("agent").agg(
        F.count(F.lit(1)).alias("answered"), F.count("correct").alias("judged"), F.coalesce(F.sum("correct"), F.lit(0)).cast("long").alias("correct"),
        F.avg("tokens").alias("mean_tokens"), F.when(F.count(F.when(F.col("usd").isNull(), 1)) == 0, F.avg("usd")).alias("mean_usd"), F.sum("tokens").alias("tokens"),
    )
    return out.select("agent", "answered", "judged", "correct", F.when(F.col("judged") > 0, F.col("correct") / F.col("judged")).alias("accuracy"), "mean_tokens", "mean_usd", "tokens")


def passes(summary: DataFrame, wiki: str, repo: str) -> DataFrame:
    """One row: whether agent wiki reaches 90% of repo's correct answers at 40% of its tokens, in whole numbers."""
    one = summary.agg(*[F.max(F.when(F.col("agent") == a, F.col(c))).alias(f"{c}_{n}") for a, n in ((wiki, "w"), (repo, "r")) for c in ("correct", "tokens")])
    ok = (F.col("correct_r") > 0) & (100 * F.col("correct_w") >= 90 * F.col("correct_r")) & (100 * F.col("tokens_w") <= 40 * F.col("tokens_r"))
    return one.select("correct_w", "correct_r", "tokens_w", "tokens_r", F.coalesce(ok, F.lit(False)).alias("pass"))
