"""Keyed state over ordered events, in batch: rate limits, de-duplication in time, job states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rate_limited(events: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """events with limited: whether more than `most` of the key's events fall into the `seconds` up to this one."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy(us).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("limited", F.count(F.lit(1)).over(w) > most)


def first_within(events: DataFrame, keys: list[str], ts: str, tie: str, seconds: int) -> DataFrame:
    """Events that no kept event of the same keys precedes by less than `seconds`. State is one time per key: rows arrive
    sorted and pass one by one, however many a key has."""
    sorted_ = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(*keys).sortWithinPartitions(*keys, "_us", tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for pdf in batches:
            keep = []
            for row in pdf[[*keys, "_us"]].itertuples(index=False):
                k, at = tuple(row[:-1]), row[-1]
                ok = k != key or at >= last + seconds * 1_000_000
                if ok:
                    key, last = k, at
                keep.append(ok)
            yield pdf[keep].drop(columns="_us")

    return sorted_.mapInPandas(run, events.schema)


#: What an event does to a job (fixed values): from states, to state.
MOVES = {
    "signup": (None, "queued"),
    "view": (("queued",), "running"),
    "purchase": (("running",), "done"),
    "error": (("running",), "queued"),
    "cancel": (("queued", "running"), "cancelled"),
}
ATTEMPTS = 3


def job_states(events: DataFrame) -> DataFrame:
    """(user_id, state, attempts, applied, ignored) after folding events(user_id, event_type, ts, event_id) in time order.

    An event that does not fit the state is ignored; an error requeues a running job, the third fails it. The fold holds
    one state per key while sorted rows pass.
    """
    sorted_ = events.select("user_id", "event_type", "ts", "event_id").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list | None = None
        for pdf in batches:
            out = []
            for user, kind in pdf[["user_id", "event_type"]].itertuples(index=False):
                if now is None or now[0] != user:
                    if now is not None:
                        out.append(tuple(now))
                    now = [user, None, 0, 0, 0]
                before, after = MOVES.get(kind, ((), None))
                fits = now[1] is None if before is None else now[1] in before
                now[3 if fits else 4] += 1
                if fits:
                    if kind == "error":
                        now[2] += 1
                    now[1] = "failed" if kind == "error" and now[2] >= ATTEMPTS else after
            yield pd.DataFrame(out, columns=["user_id", "state", "attempts", "applied", "ignored"])
        if now is not None:
            yield pd.DataFrame([tuple(now)], columns=["user_id", "state", "attempts", "applied", "ignored"])

    return sorted_.mapInPandas(run, "user_id long, state string, attempts long, applied long, ignored long")
