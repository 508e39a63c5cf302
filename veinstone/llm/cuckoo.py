"""Exact deduplication through a sharded cuckoo-filter index of live digests.

The index is two tables: the live keys, (shard, digest, copies), and for each shard one cuckoo
filter over them. A digest that misses the filter is certainly new; one that hits is verified
against the stored keys of its shard. A filter that overflows, or has grown half empty, is
rebuilt at another size from the stored keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.llm.hashing import mix
from veinstone.operators.lineage import written

SLOTS = 4
MAX_LOAD = 0.9
MAX_KICKS = 200
FILTER_SCHEMA = "shard int, log2_buckets int, n_keys long, resizes int, slots binary"


def _prints(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of 16 bits, never 0; 64 bits for the bucket) of 32-byte digests."""
    words = np.frombuffer(b"".join(digests), "<u8").reshape(len(digests), -1)
    return (words[:, 1] % np.uint64(65535)).astype(np.uint16) + np.uint16(1), words[:, 0] >> np.uint64(8)


class CuckooFilter:
    """2**k buckets of four 16-bit fingerprints; each fingerprint has two buckets, either of which gives the other."""

    def __init__(self, log2_buckets: int = 4, slots: bytes | None = None):
        self.k = log2_buckets
        shape = (1 << log2_buckets, SLOTS)
        self.slots = np.zeros(shape, np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(shape).copy()

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        """Room for n keys at 70% load."""
        return cls(max(4, int(np.ceil(np.log2(max(1, n) / (0.7 * SLOTS))))))

    def homes(self, prints: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.k) - 1)
        one = bits & mask
        return one, one ^ (mix(prints.astype(np.uint64)) & mask)

    def contains(self, prints: np.ndarray, bits: np.ndarray) -> np.ndarray:
        one, two = self.homes(prints, bits)
        p = prints[:, None]
        return (self.slots[one] == p).any(1) | (self.slots[two] == p).any(1)

    def insert(self, prints: np.ndarray, bits: np.ndarray) -> bool:
        """Adds every fingerprint; False (contents then undefined) if some found no room in MAX_KICKS rounds.

        All waiting fingerprints try at once: a bucket takes one a round; if it is full, the newcomer
        takes the place of one of its fingerprints, which goes on to its other bucket.
        """
        where, other = self.homes(prints, bits)
        wait, at, spare = prints, where, other
        for turn in range(MAX_KICKS + 2 * SLOTS):
            if not len(wait):
                return True
            if turn % 2 and turn < 2 * SLOTS:
                at, spare = spare, at
            _, first = np.unique(at, return_index=True)
            row = self.slots[at[first]]
            free = row == 0
            open_ = free.any(1)
            take = first[open_]
            self.slots[at[take], free[open_].argmax(1)] = wait[take]
            rest = np.ones(len(wait), bool)
            rest[take] = False
            if turn >= 2 * SLOTS:  # by now both homes were tried: move others on
                push = first[~open_]
                slot = (turn + push) % SLOTS
                out = self.slots[at[push], slot].copy()
                self.slots[at[push], slot] = wait[push]
                wait = wait.copy()
                wait[push] = out
                mask = np.uint64((1 << self.k) - 1)
                at = at.copy()
                at[push] = at[push] ^ (mix(out.astype(np.uint64)) & mask)
            wait, at, spare = wait[rest], at[rest], spare[rest]
        return not len(wait)

    def delete(self, prints: np.ndarray, bits: np.ndarray) -> None:
        """Removes one copy of each fingerprint; the keys must have been inserted."""
        one, two = self.homes(prints, bits)
        for p, a, b in zip(prints, one, two):
            for home in (a, b):
                at = np.flatnonzero(self.slots[home] == p)
                if len(at):
                    self.slots[home, at[0]] = 0
                    break


def _rebuilt(digests: list[bytes]) -> CuckooFilter:
    """A filter of the right size from stored keys, doubled until all fit."""
    fresh = CuckooFilter.sized(len(digests))
    if digests:
        prints, bits = _prints(digests)
        while not fresh.insert(prints, bits):
            fresh = CuckooFilter(fresh.k + 1)
    return fresh


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class CuckooIndex:
    """Live digests in two tables. Every change returns a new index; the tables are written to the shared folder.

    keys: (shard int, digest binary of 32 bytes, copies long), one row per live digest.
    filters: one row per shard that holds keys. shards fixes the memory of a task: at about 100,000 keys a shard, a
    filter takes under 1 MB and the keys with it some 20 MB.
    """

    def __init__(self, keys: DataFrame, filters: DataFrame, shards: int):
        self.keys, self.filters, self.shards = keys, filters, shards

    @classmethod
    def empty(cls, spark, shards: int = 16) -> CuckooIndex:
        keys = spark.createDataFrame([], "shard int, digest binary, copies long")
        return cls(keys, spark.createDataFrame([], FILTER_SCHEMA), shards)

    def _changed(self, keys: DataFrame, delta: DataFrame) -> CuckooIndex:
        """delta: (shard, digest, gone boolean), the digests that become live or cease to be."""

        def turn(left: pd.DataFrame, right: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            shard = int(next(x["shard"].iloc[0] for x in (left, right, stored) if len(x)))
            resizes = int(left["resizes"].iloc[0]) if len(left) else 0
            live = list(stored["digest"])
            filt = CuckooFilter(int(left["log2_buckets"].iloc[0]), left["slots"].iloc[0]) if len(left) else CuckooFilter()
            gone, new = list(right["digest"][right["gone"]]), list(right["digest"][~right["gone"]])
            if gone:
                filt.delete(*_prints(gone))
            room = filt.slots.size
            fits = MAX_LOAD * room >= len(live) and (len(live) * 8 >= room or filt.k <= 4)
            if not fits or (new and not filt.insert(*_prints(new))):
                filt, resizes = _rebuilt(live), resizes + 1
            return pd.DataFrame([(shard, filt.k, len(live), resizes, filt.slots.tobytes())], columns=["shard", "log2_buckets", "n_keys", "resizes", "slots"])

        def both(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            stored = right[right["gone"].isna()]
            return turn(left, right[right["gone"].notna()].astype({"gone": bool}), stored)

        told = keys.select("shard", "digest", F.lit(None).cast("boolean").alias("gone")).unionByName(delta.select("shard", "digest", "gone"))
        filters = self.filters.groupBy("shard").cogroup(told.groupBy("shard")).applyInPandas(both, FILTER_SCHEMA)
        return CuckooIndex(keys, written(filters), self.shards)

    def probe(self, digests: DataFrame) -> DataFrame:
        """digests(digest, ...) with maybe boolean: False is certainly not live. One shuffle of the digests by shard."""
        cols = digests.columns

        def run(key, filt: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return rows.assign(maybe=pd.Series([], dtype=bool))
            if not len(filt):
                return rows.assign(maybe=False)
            f = CuckooFilter(int(filt["log2_buckets"].iloc[0]), filt["slots"].iloc[0])
            return rows.assign(maybe=f.contains(*_prints(list(rows["digest"]))))

        keyed = digests.withColumn("shard", shard_of(F.col("digest"), self.shards))
        kinds = ", ".join(f"`{c}` {t}" for c, t in keyed.dtypes)
        out = self.filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(run, f"{kinds}, maybe boolean")
        return out.select(*cols, "maybe")

    def live(self, digests: DataFrame) -> DataFrame:
        """The rows of digests(digest, ...) that are live: filter hits, verified against the stored keys."""
        return self.probe(digests).where("maybe").drop("maybe").join(self.keys.select("digest"), "digest", "left_semi")

    def insert(self, digests: DataFrame) -> CuckooIndex:
        """Adds digests(digest); repeats raise the number of copies. Nulls are left out."""
        more = digests.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", shard_of(F.col("digest"), self.shards))
        merged = (
            self.keys.join(more, ["shard", "digest"], "full_outer")
            .select("shard", "digest", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("copies"), F.col("copies").isNull().alias("new"))
        )
        merged = written(merged)
        return self._changed(merged.drop("new"), merged.where("new").select("shard", "digest", F.lit(False).alias("gone")))

    def delete(self, digests: DataFrame) -> CuckooIndex:
        """Takes away one copy for each row of digests(digest); those without copies left cease to be live."""
        less = digests.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", shard_of(F.col("digest"), self.shards))
        kept = written(self.keys.join(less, ["shard", "digest"], "left").select("shard", "digest", (F.col("copies") - F.coalesce("n", F.lit(0))).alias("copies")))
        gone = kept.where("copies <= 0").select("shard", "digest", F.lit(True).alias("gone"))
        return self._changed(kept.where("copies > 0"), gone)


def repeated_digests(rows: DataFrame, shards: int) -> DataFrame:
    """Of rows(doc_id, digest), those digests that may occur more than once: (digest, n, least), partly summed.

    Each task first adds up its own repeats, batch by batch, so that however many copies a text
    has, a batch sends one row for it. A shard's rows then enter a cuckoo filter: only those whose
    fingerprint is met again (and what shares it) are passed on; all others occur once.
    """

    def pre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = pdf.groupby(["shard", "digest"], sort=False)["doc_id"]
            yield g.agg(n="size", least="min").reset_index()

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        prints, bits = _prints(list(pdf["digest"]))
        filt = CuckooFilter.sized(len(pdf))
        one, two = filt.homes(prints, bits)
        place = np.minimum(one, two) * np.uint64(65536) + prints.astype(np.uint64)
        hot = (pdf["n"] > 1).to_numpy()
        step = max(1, len(pdf) // 8)
        for at in range(0, len(pdf), step):  # rows come in blocks; a block first asks, then enters
            part = slice(at, at + step)
            hit = filt.contains(prints[part], bits[part])
            _, first = np.unique(place[part], return_index=True)
            repeat = np.ones(len(hit), bool)
            repeat[first] = False
            hot[part] |= hit | repeat
            new = first[~hit[first]]
            while not filt.insert(prints[part][new], bits[part][new]):  # overflow: again from all stored so far, at twice the size
                filt = CuckooFilter(filt.k + 1)
                _, kept = np.unique(place[: at + step], return_index=True)
                new, part = kept, slice(0, at + step)
                one, two = filt.homes(prints, bits)
        met = np.isin(place, place[hot])
        return pdf.loc[met, ["digest", "n", "least"]]

    keyed = rows.select("doc_id", "digest", shard_of(F.col("digest"), shards).alias("shard"))
    summed = keyed.mapInPandas(pre, "shard int, digest binary, n long, least long")
    return summed.groupBy("shard").applyInPandas(again, "digest binary, n long, least long")


def exact_groups(docs: DataFrame, per_shard: int = 100_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text).

    Texts are equal when identical after each run of white space became one space (null: empty);
    their SHA-256 stands for them. The row with the smallest doc_id stays. Repeated rows of one
    doc_id count each. Rows without doc_id keep null there and never are the row that stays, unless
    all of a group are such. Digests that the filter lets pass as repeated are verified by adding
    them up exactly; the other rows are alone in their group.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
    slim = written(slim)
    shards = max(8, -(-slim.count() // per_shard))
    groups = (
        repeated_digests(slim, shards)
        .groupBy("digest").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
        .where("n > 1")
    )
    out = slim.join(groups, "digest", "left")
    return out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("n").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("least"), F.col("least").isNull())).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
