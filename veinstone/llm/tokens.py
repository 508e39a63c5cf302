"""Token counts: byte-pair merges over ragged arrays, a rank at a time for all sequences together."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split of a byte-level vocabulary of this kind (fixed value: the library's own pattern).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker remembers the counts of at most so many different pre-tokens, and forgets all beyond.
REMEMBERED = 400_000
#: Pre-tokens longer than this are counted but not remembered.
LONG = 64
_NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such vocabularies: itself where it is printable and no
    space, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class Merges:
    """A vocabulary's merge ranks as sorted arrays of symbol pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, inside = spec.get("pre_tokenizer") or {}, spec["model"]
        if inside.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or any(inside.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"{path}: not a plain byte-level vocabulary with this module's split")
        vocab = inside["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.bytes = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.made = made
        #: Two tables of slots by multiplicative hash; what finds its slot in the first taken goes to the second.
        self.tables = []
        ranks = np.arange(len(keys), dtype=np.int32)
        for bits, factor in ((20, 0x9E3779B97F4A7C15), (18, 0xC2B2AE3D27D4EB4F), (18, 0x165667B19E3779F9)):
            table = (bits, np.uint64(factor), np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32))
            slot = self._slot(keys, table)
            _, first = np.unique(slot, return_index=True)
            table[2][slot[first]], table[3][slot[first]] = keys[first], ranks[first]
            self.tables.append(table)
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]
        if len(keys):
            raise ValueError("the merges don't fit the lookup tables")
        #: Special strings are cut out of a text first and count one each.
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    @staticmethod
    def _slot(keys: np.ndarray, table: tuple) -> np.ndarray:
        return ((keys.astype(np.uint64) * table[1]) >> np.uint64(64 - table[0])).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, _NONE for those that don't merge."""
        key = left * self.width + right
        slot = self._slot(key, self.tables[0])
        out = np.where(self.tables[0][2][slot] == key, self.tables[0][3][slot], _NONE)
        for table in self.tables[1:]:
            at = np.flatnonzero(out == _NONE)
            slot = self._slot(key[at], table)
            out[at] = np.where(table[2][slot] == key[at], table[3][slot], _NONE)
        return out

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols each sequence (none empty) keeps when no pair in it can be merged any more.

        Every round finds the lowest-ranked pair of each sequence and merges all its occurrences,
        left to right without overlap, in all sequences at once; sequences without a pair leave.
        """
        out = np.zeros(len(sequences), np.int64)
        lengths = np.array([len(s) for s in sequences], np.int64)
        flat = self.bytes[np.frombuffer(b"".join(sequences), np.uint8)]
        ids = np.arange(len(sequences))
        while len(ids):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            rank = np.full(len(flat), _NONE, np.int32)
            rank[:-1] = self.rank(flat[:-1], flat[1:])
            rank[ends - 1] = _NONE
            low = np.minimum.reduceat(rank, starts)
            done = low == _NONE
            out[ids[done]] = lengths[done]
            hit = (rank == np.repeat(low, lengths)) & (rank != _NONE)
            # of neighbouring hits (a run of one symbol) every second one counts
            at = np.flatnonzero(hit)
            if len(at) > 1:
                fresh = np.ones(len(at), bool)
                fresh[1:] = np.diff(at) != 1
                head = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
                at = at[(at - head) % 2 == 0]
            flat[at] = self.made[rank[at]]
            keep = np.repeat(~done, lengths)
            gone = np.zeros(len(flat), bool)
            gone[at + 1] = True
            lengths = (lengths - np.add.reduceat(gone.astype(np.int64), starts))[~done]
            flat = flat[keep & ~gone]
            ids = ids[~done]
        return out


@functools.lru_cache(maxsize=2)
def _worker(path: str) -> tuple[Merges, dict[str, int]]:
    return Merges(path), {}


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the vocabulary's library counts them without added begin or end."""
    merges, known = _worker(path)
    split = regex.compile(SPLIT)
    counts, at, size = [0] * len(texts), 0, 0

    def settle(group: list[tuple[int, list[str]]]) -> None:
        every = {t for _, tokens in group for t in tokens}
        fresh = list(every.difference(known))
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list(every)
        if fresh:
            known.update(zip(fresh, merges.count([t.encode("utf-8", "surrogatepass") for t in fresh]).tolist()))
        for i, tokens in group:
            counts[i] += sum(map(known.__getitem__, tokens))
        for t in fresh:
            if len(t) > LONG:
                del known[t]

    group: list[tuple[int, list[str]]] = []
    for at, text in enumerate(texts):
        parts = [text]
        if merges.cut is not None and any(s in text for s in merges.specials):
            parts = merges.cut.split(text)
            counts[at] += len(parts) - 1
        for part in parts:
            if part:
                group.append((at, split.findall(part)))
                size += len(part)
        if size > 1_000_000:
            settle(group)
            group, size = [], 0
    settle(group)
    return counts


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs(doc_id, text); other columns are ignored.

    path: the vocabulary's file, readable on every executor. A null text counts as empty: 0 bytes, 0 tokens. Repeated
    rows each give a row. There is no shuffle: each task counts its own rows, about a million characters at a time, and
    a lost task is simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_tokens(batch.column(2).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
