"""Fill-in-middle: texts are cut in three at unit borders, found by arithmetic on 64-bit words of their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone.llm.hashing import slices

U = np.uint64
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Words worked on at a time, so that what is held beside a long text is a small part of it.
BLOCK = 1 << 16


def _all(byte: int) -> np.uint64:
    """One byte value in all eight places of a word."""
    return U(byte * 0x0101010101010101)


_HIGH, _LOW = _all(0x80), _all(0x7F)


def _spaces(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is one of 0x20 and 0x09 to 0x0D. Sums of seven-bit values never carry into the next byte."""
    low = words & _LOW
    other = (low ^ _all(0x20)) + _LOW
    from_9, from_14 = low + _all(0x80 - 0x09), low + _all(0x80 - 0x0E)
    return ((from_9 & ~from_14) | ~other) & ~words & _HIGH


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, first): all texts as little-endian words, each from a word of its own (first[i]; one more entry at the end) and followed
    by one to eight spaces."""
    first = np.cumsum([0, *[len(t) // 8 + 1 for t in texts]])
    raw = np.full(int(first[-1]) * 8, 0x20, np.uint8)
    for at, text in zip((first[:-1] * 8).tolist(), texts):
        raw[at : at + len(text)] = np.frombuffer(text, np.uint8)
    return raw.view("<u8"), first


def unit_ends(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The high bit of each byte that ends a unit: a byte that is no space before one that is, and a text's last byte anyway (its place in bytes: last)."""
    out = np.empty_like(words)
    for i in range(0, len(words), BLOCK):
        space = _spaces(words[i : i + BLOCK + 1])
        after = space >> U(8)
        after[:-1] |= (space[1:] & U(0x80)) << U(56)
        out[i : i + BLOCK] = (~space & after & _HIGH)[:BLOCK]
    np.bitwise_or.at(out, last >> 3, U(0x80) << ((last & 7) * 8).astype(U))
    return out


def select(marks: np.ndarray, upto: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place in bytes of the k-th mark (from 1). upto: marks up to and with each word. The word is searched for, then its lower
    marks are cleared one by one."""
    word = np.searchsorted(upto, k, "left")
    inside = marks[word]
    skip = k - (upto[word] - np.bitwise_count(inside)) - 1
    for step in range(7):
        inside = np.where(skip > step, inside & (inside - U(1)), inside)
    return word * 8 + (np.bitwise_count((inside & (~inside + U(1))) - U(1)) >> 3)


def code_points(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that begins a code point: all but 10xxxxxx."""
    return (~words | (words << U(1))) & _HIGH


def rank(words: np.ndarray, begins: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points that begin before byte `at`; begins: how many begin before each word, and one entry more."""
    word, byte = at >> 3, (at & 7).astype(U)
    # at may be the end of the last word
    inside = code_points(words[np.minimum(word, len(words) - 1)]) & ((U(1) << (byte * U(8))) - U(1))
    return begins[word] + np.bitwise_count(np.where(byte > 0, inside, U(0)))


def arranged(texts: list[bytes], draws: np.ndarray, percent: int, spm_percent: int) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, list[bytes]]:
    """(units, form, prefix's and middle's code points, output) of each text; draws holds four integers a text."""
    words, first = packed(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = first[:-1] * 8
    marks = unit_ends(words, (begin + sizes - 1)[sizes > 0])
    upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)
    before = np.concatenate([[0], upto])[first]
    n = np.diff(before)
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    ends = np.repeat(begin[:, None], 2, 1)
    some = cuts > 0
    ends[some] = select(marks, upto, (before[:-1, None] + cuts)[some]) + 1
    begins = np.concatenate([[0], np.cumsum(np.bitwise_count(code_points(words)), dtype=np.int64)])
    chars = rank(words, begins, ends)
    prefix = chars[:, 0] - rank(words, begins, begin)
    middle = chars[:, 1] - chars[:, 0]
    forms, outputs = [], []
    for text, (a, b), draw in zip(texts, (ends - begin[:, None]).tolist(), draws.tolist()):
        if not text or draw[2] % 100 >= percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
            forms.append("plain")
            outputs.append(text)
        elif draw[3] % 100 < spm_percent:
            forms.append("spm")
            outputs.append(b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])))
        else:
            forms.append("psm")
            outputs.append(b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])))
    return n, forms, prefix, middle, outputs


def transformed(docs: DataFrame, percent: int = 50, spm_percent: int = 80, seed: int = 42) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output added (columns of these names are replaced).

    A unit is a word with the white space before it; white space at the end is a unit of its own. The first four groups of eight hex digits of
    the SHA-256 of seed:doc_id are four draws: the first two, modulo n + 1, are the cuts; the third, modulo 100, leaves a text plain from `percent` on; the
    fourth makes the others spm below `spm_percent`, else psm. Empty and null texts (output is then empty), and texts that hold a mark, stay plain: n counts their
    units, prefix_chars and middle_chars are null. Rows without doc_id are drawn as if it were empty; repeated rows come out alike. Nothing is shuffled;
    a task holds one text, or half a megabyte of them, and its words.
    """
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = docs.drop(*[c for c in docs.columns if c in new])
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    tag = "_h"
    while any(c.startswith(tag) for c in kept.columns):
        tag = "_" + tag
    draws = [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"{tag}{k}") for k in range(4)]
    given = kept.select("*", *draws)
    names, width = kept.columns, len(kept.columns)
    of = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.stack([batch.column(width + k).to_numpy() for k in range(4)], axis=1)
            for i, j, texts in slices(batch.column(of)):
                n, forms, prefix, middle, outputs = arranged(texts, drawn[i:j], percent, spm_percent)
                plain = np.array([f == "plain" for f in forms])
                strings = batch.column(of).type
                more = [pa.array(n), pa.array(forms, strings), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain)]
                raw = pa.array(outputs, pa.large_binary() if pa.types.is_large_string(strings) else pa.binary())
                columns = [batch.column(k).slice(i, j - i) for k in range(width)]
                yield pa.RecordBatch.from_arrays([*columns, *more, raw.cast(strings)], [*names, *new])

    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    return given.mapInArrow(run, T.StructType([*kept.schema.fields, *[T.StructField(c, k) for c, k in zip(new, kinds)]]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    middle = F.substring_index(output, m, -1)
    psm = F.concat(F.substring(F.substring_index(output, s, 1), len(p) + 1, 2**31 - 1), middle, F.substring_index(F.substring_index(output, s, -1), m, 1))
    spm = F.concat(F.substring_index(F.substring_index(output, p, -1), m, 1), middle, F.substring(F.substring_index(output, p, 1), len(s) + 1, 2**31 - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
