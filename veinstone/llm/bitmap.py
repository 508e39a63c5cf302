"""A bitmap of hashed keys with a fixed bound on its size, to drop most rows before a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.hashing import mix

#: Bits at most (16 MB). Beyond some 30 million keys it lets more rows pass, never fewer.
MAX_LOG2_BITS = 27


class KeyBitmap:
    """One bit for the hash of each key; holds() may be wrong only in saying yes."""

    def __init__(self, words: np.ndarray, log2_bits: int):
        self.words, self.k = words, log2_bits

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> KeyBitmap:
        """From a column of longs. The bits are gathered on executors; the driver gets the words, bounded in number."""
        n = keys.count()
        k = int(min(MAX_LOG2_BITS, max(16, np.ceil(np.log2(max(1, n) * 16)))))

        def bits(batches):
            for pdf in batches:
                at = _place(pdf["key"].to_numpy(), k)
                words = np.zeros(1 << (k - 6), np.uint64)
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
                used = np.flatnonzero(words)
                yield type(pdf)({"word": used, "bits": words[used].view(np.int64)})

        found = keys.select(F.col(column).cast("long").alias("key")).where("key is not null").mapInPandas(bits, "word long, bits long")
        rows = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        words = np.zeros(1 << (k - 6), np.uint64)
        words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
        return cls(words, k)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = _place(keys, self.k)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _place(keys: np.ndarray, k: int) -> np.ndarray:
    return mix(np.asarray(keys).astype(np.int64, copy=False).view(np.uint64)) >> np.uint64(64 - k)
