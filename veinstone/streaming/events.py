"""Structured Streaming over an event stream: windows with late data, de-duplication, rate limits, job states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators.stateful import ATTEMPTS, MOVES


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """events as a stream of the parquet files in a folder."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; what comes later than `late` behind is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, key: str = "event_id", within: str = "30 days") -> DataFrame:
    """Each key's first event; its state is dropped after `within`."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def limited(events: DataFrame, window: str = "1 second", most: int = 5, late: str = "10 seconds") -> DataFrame:
    """(user_id, start, n) of windows with more than `most` events of a user."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", window)).count().where(F.col("count") > most).select("user_id", F.col("window.start").alias("start"), F.col("count").alias("n"))


def job_states(events: DataFrame) -> DataFrame:
    """(user_id, state, attempts, applied, ignored) after each micro-batch: the fold of operators.stateful.job_states as
    keyed state. Within a batch events are taken in time order; one older than the last applied is ignored."""

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, attempts, applied, ignored, last = state.get if state.exists else ("", 0, 0, 0, -1)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, ts in zip(rows["event_type"], rows["ts"]):
            at = int(ts.value // 1000)
            before, after = MOVES.get(kind, ((), None))
            fits = at >= last and (now == "" if before is None else now in before)
            if not fits:
                ignored += 1
                continue
            applied, last = applied + 1, at
            if kind == "error":
                attempts += 1
            now = "failed" if kind == "error" and attempts >= ATTEMPTS else after
        state.update((now, attempts, applied, ignored, last))
        yield pd.DataFrame({"user_id": [key[0]], "state": [now], "attempts": [attempts], "applied": [applied], "ignored": [ignored]})

    return events.groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, state string, attempts long, applied long, ignored long", "state string, attempts long, applied long, ignored long, last long", "update", "NoTimeout"
    )


def into_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts writing a stream, as fast as it comes and until its source ends, into a parquet folder; exactly once through the checkpoint."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
