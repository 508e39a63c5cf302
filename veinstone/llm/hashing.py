"""Vectorised word and shingle hashing over batches of texts (numpy, used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random value for each byte; white space counts as nothing, A-Z as a-z.
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE[_SPACE] = 0
_VALUE[65:91] = _VALUE[97:123]
_BASE = U64(0x9E3779B97F4A7C15)
_ROLL = _RNG.integers(1, 2**63, 16, dtype=np.int64).astype(U64) | U64(1)
#: Texts are hashed in pieces of about so many bytes, cut at white space, to bound memory.
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _piece_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of one piece, A-Z lower-cased."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U64)
    begin = int(starts[0])
    raw = raw[begin:]
    starts = starts - begin
    lengths = np.diff(starts, append=len(raw))
    at = np.arange(len(raw)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(_VALUE[raw] * _powers(int(lengths.max()))[at], starts))


def word_hashes(data: bytes) -> np.ndarray:
    """The hashes of a text's words in order; long texts go piece by piece."""
    if len(data) <= 2 * PIECE:
        return _piece_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_piece_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def grouped(texts: list[bytes], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts of about `size` bytes together, at least one text each."""
    i, total = 0, 0
    for j, text in enumerate(texts):
        if j > i and total + len(text) > size:
            yield i, j
            i, total = j, 0
        total += len(text)
    if i < len(texts):
        yield i, len(texts)


def slices(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, list[bytes]]]:
    """(i, j, texts i to j - 1 in UTF-8) of a column of strings, about `size` bytes at a time, at least one text; null is empty.

    Only one slice of the batch exists as Python objects at a time."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    i, total = 0, 0
    for j, n in enumerate([*lengths.tolist(), None]):
        if j > i and (n is None or total + n > size):
            yield i, j, [t or b"" for t in column.slice(i, j - i).cast(kind).to_pylist()]
            i, total = j, 0
        total += n or 0


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, how many each text has)."""
    if len(texts) == 1:
        words = word_hashes(texts[0])
        return words, np.array([len(words)])
    data = b" ".join(texts)
    words = _piece_hashes(data)
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.cumsum(first)[np.maximum(ends - 2, 0)] if len(raw) else np.zeros(len(texts), int)
    counts = np.where(ends - 2 < 0, 0, counts)
    return words, np.diff(counts, prepend=0)


def shingles(words: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): every n-word window of each text, in order; a text of 1 to n-1 words gives its whole sequence
    as one; owner is the text's position in the batch. Repeats stay."""
    owner = np.repeat(np.arange(len(counts)), counts)
    m = len(words) - n + 1
    if m > 0:
        whole = owner[:m] == owner[n - 1 :]
        h = words[:m] * _ROLL[0]
        for k in range(1, n):
            h = h + words[k : k + m] * _ROLL[k]
        h, own = mix(h[whole]), owner[:m][whole]
    else:
        h, own = np.zeros(0, U64), np.zeros(0, owner.dtype)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        begin = np.cumsum(counts) - counts
        extra = np.zeros(len(short), U64)
        for k in range(n - 1):
            has = counts[short] > k
            extra[has] += words[begin[short[has]] + k] * _ROLL[k]
        extra = mix(extra ^ (counts[short].astype(U64) * _BASE))
        h, own = np.concatenate([h, extra]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        h, own = h[order], own[order]
    return h, own


def distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without repeats within a text; sorted by text, then hash."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[keep], owner[keep]
    return h, owner
