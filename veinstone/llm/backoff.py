"""Stupid-backoff scores of documents under the counts of all other documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.hashing import U64, batch_words, grouped, mix
from veinstone.llm.mixing import n_words
from veinstone.operators.lineage import written

_RNG = np.random.default_rng(99)
_ROLL = _RNG.integers(1, 2**63, 8, dtype=np.int64).astype(U64) | U64(1)
#: An n-gram's key is its hash but for the lowest byte, which is 1 where there is an n-gram.
_KEY = ~U64(255)


def grams(words: np.ndarray, owner: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order, the key of the n words that end at each word, plus 1; 0 where the text has not that many before."""
    out = []
    for n in range(1, order + 1):
        h = np.zeros(len(words), U64)
        m = len(words) - n + 1
        if m > 0:
            x = np.full(m, U64(n))
            for k in range(n):
                x = x + words[k : k + m] * _ROLL[k]
            h[n - 1 :] = np.where(owner[:m] == owner[n - 1 :], mix(x) & _KEY | U64(1), U64(0))
        out.append(h)
    return out


def counted(g: list[np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """From grams: (distinct keys, how often each occurs, for each order where the n-gram at each word stands among
    the keys, and how often it occurs in its own text). Where there is no n-gram both are of no meaning.

    One stable sort by key brings equal n-grams together, those of one text next to each other, as texts come in order."""
    every = np.concatenate(g)
    if not len(every):
        return every, np.zeros(0, np.int64), g, g
    order = np.argsort(every, kind="stable")
    k = every[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    at, own = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    group = np.cumsum(first) - 1
    at[order] = group
    keys, n = k[first], np.bincount(group)
    who = np.tile(owner, len(g))[order]
    first[1:] |= who[1:] != who[:-1]
    begin = np.flatnonzero(first)
    size = np.diff(begin, append=len(k))
    own[order] = np.repeat(size, size)
    if not keys[0]:  # no n-gram
        keys, n, at = keys[1:], n[1:], np.maximum(at - 1, 0)
    split = lambda x: np.split(x, len(g))
    return keys & _KEY, n, split(at), split(own)


def _words(texts) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() if t else b"" for t in texts]
    parts = [batch_words(raw[i:j]) for i, j in grouped(raw)]
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, int)
    words = np.concatenate([w for w, _ in parts]) if parts else np.zeros(0, U64)
    return words, np.repeat(np.arange(len(counts)), counts)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lower `width` bytes of each number, all lowest bytes first."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = data[: n * width].reshape(width, n).T
    return out.view("<u8").ravel()


def _pack(keys: np.ndarray, base: int) -> bytes:
    """The upper seven bytes of sorted keys from base on, as steps: their lower bits as they are, the rest of each step as so
    many zeros before a one, near the fewest bits that random keys can be told in."""
    step = np.diff(keys >> U64(8), prepend=U64(base))
    n = len(step)
    low = max(0, int(np.log2(max(1.0, float(step.sum()) / n))))
    whole, rest = divmod(low, 8)
    bits = [np.packbits((step >> U64(b) & U64(1)).astype(np.uint8)).tobytes() for b in range(8 * whole, low)]
    ends = np.cumsum((step >> U64(low)).astype(np.int64)) + np.arange(n)
    ones = np.zeros(int(ends[-1]) + 1, np.uint8)
    ones[ends] = 1
    return b"".join([n.to_bytes(4, "little"), bytes([low]), _planes(step, whole), *bits, np.packbits(ones).tobytes()])


def _unpack(data: bytes, base: int) -> np.ndarray:
    n, low = int.from_bytes(data[:4], "little"), data[4]
    whole, rest = divmod(low, 8)
    raw, each = np.frombuffer(data, np.uint8)[5:], -(-n // 8)
    step = _unplanes(raw, n, whole)
    at = n * whole
    for b in range(8 * whole, low):
        step |= np.unpackbits(raw[at : at + each], count=n).astype(U64) << U64(b)
        at += each
    ends = np.flatnonzero(np.unpackbits(raw[at:]))
    step |= (np.diff(ends, prepend=-1) - 1).astype(U64) << U64(low)
    return (np.cumsum(step, dtype=U64) + U64(base)) << U64(8)


def _pack_small(x: np.ndarray, usual: int) -> bytes:
    """Numbers most of which are `usual`: a bit for each that isn't, and those, as wide as the largest."""
    odd = x != usual
    width = (int(x.max()).bit_length() + 7) // 8
    return b"".join([len(x).to_bytes(4, "little"), bytes([width]), np.packbits(odd).tobytes(), _planes(x[odd], width)])


def _unpack_small(data: bytes, usual: int) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    raw, each = np.frombuffer(data, np.uint8)[5:], -(-n // 8)
    odd = np.unpackbits(raw[:each], count=n).astype(bool)
    out = np.full(n, usual, np.int64)
    out[odd] = _unplanes(raw[each:], int(odd.sum()), width)
    return out


def backoff_scores(docs: DataFrame, order: int = 2, discount: float = 0.4, block_bytes: int = 8 << 20, shard_words: int = 2_000_000, stable: bool = False) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score, n_backed_off for every row of docs(doc_id, text).

    A word scores, from the longest context of up to order - 1 words down, the count of context and
    word over that of the context, at the first length at which it was seen, times discount for
    each step down; at the last, its count over all words; a word never seen discount more steps down, over one
    more than all words. Counts are of all documents but the row itself, so that no text vouches for itself. Words
    [^\\x20\\x09-\\x0D]+, A-Z lower-cased. log_score is the sum of natural logarithms; null and
    empty texts have 0 words, 0 and no mean. Repeated rows are documents of their own.

    Texts are dealt out by block, some 8 MB each, by hash of doc_id, length and input partition, so that copies of one row, or rows
    without doc_id, spread too. A block's distinct n-grams with their counts go to
    the count tables' partitions by hash, one entry however often a block has an n-gram, so that none is hot; each
    partition adds up and answers every block in the order of its n-grams; blocks join the answers
    to their documents' n-grams. As both ends have to find the same rows in a block, the dealt rows are written first; stable says that docs comes
    out in the same partitions whenever it is read, as files do, so that this can be left out. Tasks hold one block, or one partition of the tables, whose number grows with the input.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(n_words(F.col("text"))), F.lit(0)).alias("words")).first()
    blocks = max(1, -(-total["bytes"] // block_bytes))
    bits = max(2, int(np.ceil(np.log2(max(1, total["words"] * order / shard_words)))))
    everything = float(total["words"])
    block = F.pmod(F.xxhash64("doc_id", F.length("text"), F.spark_partition_id()), F.lit(blocks)).cast("int")
    dealt = slim.select(block.alias("block"), "doc_id", "text")
    dealt = dealt if stable else written(dealt)

    def base(shard: int) -> int:
        return shard << (56 - bits)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        words, owner = _words(pdf["text"])
        every = np.concatenate(grams(words, owner, order))
        keys, n = np.unique(every[every != 0] & _KEY, return_counts=True)
        edges = np.searchsorted(keys >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64))
        rows = [(s, int(pdf["block"].iloc[0]), _pack(keys[a:b], base(s)), _pack_small(n[a:b], 1)) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        return pd.DataFrame(rows, columns=["shard", "block", "keys", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpack(k, base(int(pdf["shard"].iloc[0]))) for k in pdf["keys"]]
        counts = np.concatenate([_unpack_small(c, 1) for c in pdf["counts"]])
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(back, weights=counts).astype(np.int64)[back] - counts  # in other blocks
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "sums": [_pack_small(sums[e - len(k) : e], 0) for e, k in zip(ends, keys)]})

    def score(mine: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        words, owner = _words(mine["text"])
        g = grams(words, owner, order)
        keys, n_here, places, own = counted(g, owner)
        back = back.sort_values("shard")
        sums = np.concatenate([_unpack_small(b, 0) for b in back["sums"]]) + n_here if len(back) else np.zeros(1)
        rows = len(mine)
        size = np.bincount(owner, minlength=rows)
        elsewhere = everything - size[owner]
        seen = []  # of each order: the count in all other documents of the n-gram that ends at each word
        for h, at, same in zip(g, places, own):
            seen.append(np.where(h != 0, sums[at] - same, 0.0) if len(h) else np.zeros(0))
        value = np.where(seen[0] > 0, np.log(np.maximum(seen[0], 1)) - np.log(np.maximum(elsewhere, 1)), np.log(discount) - np.log(elsewhere + 1))
        # steps down from the longest context that the text has there to the one used
        for n in range(1, order):
            has, context = g[n] != 0, np.concatenate([[0.0], seen[n - 1][:-1]])
            hit = has & (seen[n] > 0) & (context > 0)
            value = np.where(hit, np.log(np.maximum(seen[n], 1)) - np.log(np.maximum(context, 1)), np.where(has, value + np.log(discount), value))
        down = (g[order - 1] != 0) & ~(seen[order - 1] > 0)
        log = np.bincount(owner, weights=value, minlength=rows)
        return pd.DataFrame({"doc_id": mine["doc_id"], "n_words": size, "log_score": log, "mean_log_score": [x / n if n else None for x, n in zip(log, size)], "n_backed_off": np.bincount(owner[down], minlength=rows)})

    sent = dealt.groupBy("block").applyInPandas(send, "shard int, block int, keys binary, counts binary")
    back = sent.groupBy("shard").applyInPandas(answer, "block int, shard int, sums binary")
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(score, "doc_id long, n_words long, log_score double, mean_log_score double, n_backed_off long")
