"""Alignment of two vocabularies' tokens: byte ranges of a text yield fragments, which are composed by an associative operation."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.llm.tokens import byte_symbols
from veinstone.operators.lineage import written

#: Texts of more bytes are cut into ranges of about so many, which any tasks may work on.
RANGE = 1 << 16
#: So many neighbouring fragments are composed in one task of a round.
FAN = 16
#: A worker remembers the fragments of at most so many different words, of so many characters together.
REMEMBERED, REMEMBERED_CHARS = 300_000, 8_000_000
#: Texts are worked on in slices of about so many characters.
SLICE = 1 << 19
#: A table of at most so many pairs of ids is sent to all executors; a larger one is joined by shuffle.
BROADCAST_PAIRS = 1_500_000
#: A pair of ids as one number: a * WIDTH + b.
WIDTH = 1 << 20

#: Groups of more links are counted by distinct ids.
LARGE_GROUP = 1 << 12

_NONE = np.zeros(0, np.int64)


class Open(NamedTuple):
    """Tokens of both kinds in order, with the byte offsets of their ends: a group that isn't known to begin or end here."""

    a: np.ndarray = _NONE
    a_end: np.ndarray = _NONE
    b: np.ndarray = _NONE
    b_end: np.ndarray = _NONE

    def __add__(self, other: Open) -> Open:
        return Open(*[np.concatenate([x, y]) for x, y in zip(self, other)])

    def upto(self, ends: np.ndarray) -> list[Open]:
        """Cut behind each of these offsets; the last piece is what remains."""
        i, j = np.searchsorted(self.a_end, ends, "right"), np.searchsorted(self.b_end, ends, "right")
        parts = zip(np.split(self.a, i), np.split(self.a_end, i), np.split(self.b, j), np.split(self.b_end, j))
        return [Open(*p) for p in parts]


class Fragment(NamedTuple):
    """An open prefix, closed groups and an open suffix. Without an offset at which both kinds end, tail is None and all is in head;
    else head ends at the first such offset and tail begins behind the last. An empty head and no tail is the neutral element."""

    head: Open = Open()
    groups: tuple = ()
    tail: Open | None = None


def fragment(tokens: Open) -> Fragment:
    ends = np.intersect1d(tokens.a_end, tokens.b_end, assume_unique=False)
    if not len(ends):
        return Fragment(tokens)
    head, *groups, tail = tokens.upto(ends)
    return Fragment(head, tuple(groups), tail)


def composed(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges. Associative: what lies between the last common end on the left and the first on the right is looked at anew."""
    middle = fragment((left.tail if left.tail is not None else left.head) + right.head)
    inner = () if middle.tail is None else middle.groups
    first = middle.head  # up to the first common end in the middle, if there is one
    if left.tail is None:
        if right.tail is None:
            return middle
        # the middle ends at right's first common end
        return Fragment(first, (*inner, *right.groups), right.tail)
    if middle.tail is None:
        return Fragment(left.head, left.groups, middle.head)
    return Fragment(left.head, (*left.groups, first, *inner, *(right.groups if right.tail is not None else ())), right.tail if right.tail is not None else middle.tail)


def shown(groups) -> str:
    """a1,a2|b1;a3|b2,b3"""
    return ";".join(",".join(map(str, g.a.tolist())) + "|" + ",".join(map(str, g.b.tolist())) for g in groups)


def linked(groups) -> tuple[np.ndarray, np.ndarray]:
    """(pair, times) of all links: each a of a group with each b of it. A group's repeated ids are counted before they meet."""
    pairs, times = [_NONE], [_NONE]
    for g in groups:
        (a, m), (b, n) = (np.unique(x, return_counts=True) for x in (g.a, g.b))
        pairs.append((a[:, None] * WIDTH + b).ravel())
        times.append((m[:, None] * n).ravel())
    return summed(np.concatenate(pairs), np.concatenate(times))


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(pairs, return_inverse=True)
    return keys, np.bincount(at, times, len(keys)).astype(np.int64)


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and where a text may be cut for each without a change of its tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.one = tokenizers.Tokenizer.from_file(a_path)
        self.one.encode_special_tokens = True
        self.one.no_truncation()
        self.one.no_padding()
        self.two = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: i for i, c in enumerate(byte_symbols())}
        added = {i: t.content.encode() for i, t in self.one.get_added_tokens_decoder().items()}
        vocab = {i: t for t, i in self.one.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [added.get(i) or bytes(byte_of[c] for c in vocab.get(i, "")) for i in range(max([*vocab, *added]) + 1)]
        pieces = [self.two.id_to_piece(i) for i in range(self.two.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.two.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        if max(len(self.a_bytes), len(self.b_bytes)) > WIDTH:
            raise ValueError("a vocabulary has too many ids")
        #: What stands for each token in the text of groups: a's within and at the end of a side, then b's.
        self.shown = np.array([f"{i}{mark}" for n, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for mark in marks], object)
        #: Characters that stand side by side in some piece: only between those can pieces join.
        self.joined = {p[k : k + 2].replace("▁", " ") for p in pieces for k in range(len(p) - 1)}
        if any(x[0] != " " and x[1] == " " for x in self.joined) or any("\n" in p for p in pieces):
            raise ValueError(f"{b_path}: pieces go on over the end of a word")

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.one.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """The library puts a space before each text but the empty one. Where more follows a first space, that one is left out; else a line feed, which joins
        with nothing, parts the library's space from the text, and both are dropped."""
        given = [t[1:] if t[:1] == " " and len(t) > 1 else "\n" + t for t in texts]
        found = self.two.encode(given, num_threads=1) if given else []
        return [ids[2:] if g[:1] == "\n" and g[1:] == t else ids for t, g, ids in zip(texts, given, found)]

    def tokens(self, a_text: str, b_text: str, a_at: int, b_at: int) -> tuple[Open, bool]:
        """The tokens of ranges that begin at these byte offsets, and whether their bytes are the texts'."""
        a, b = (np.array(x[0], np.int64) for x in (self.encode_a([a_text]), self.encode_b([b_text])))
        same = b"".join(map(self.a_bytes.__getitem__, a)) == a_text.encode() and b"".join(map(self.b_bytes.__getitem__, b)) == b_text.encode()
        return Open(a, a_at + np.cumsum(self.a_size[a]), b, b_at + np.cumsum(self.b_size[b])), same

    _A_CUT = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")

    def cut_a(self, text: str, at: int) -> int:
        """The first place from `at` on where pre-tokens part whatever stands before: behind a run of letters or digits."""
        found = self._A_CUT.search(text, at)
        return found.start() if found else len(text)

    def cut_b(self, text: str, at: int) -> int:
        """The first place from `at` on between characters that no piece holds side by side."""
        for i in range(max(at, 1), len(text)):
            if text[i - 1 : i + 1] not in self.joined:
                return i
        return len(text)


@functools.lru_cache(maxsize=2)
def _vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


#: White space and what follows up to the next space or line feed that stands behind something else.
_WORD = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*)?|\s+")


def words(text: str) -> list[str]:
    """A space and the text, cut before each space or line feed that follows no white space: there tokens of both kinds end, and what follows is
    tokenised as if it stood alone."""
    return _WORD.findall(" " + text)


def _by_owner(owner: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by owner (below 2^23) and pair, an owner's repeated pairs added up."""
    key = (owner << 40) | pairs
    order = np.argsort(key)
    key, times = key[order], times[order]
    if len(key):
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, times = key[new], np.add.reduceat(times, new)
    return key >> 40, key & ((1 << 40) - 1), times


def _pieces(items: list, sizes: np.ndarray) -> Iterator[list]:
    at = 0
    for n in sizes.tolist():
        yield items[at : at + n]
        at += n


class Words:
    """The closed fragments of words met, as numbers, texts and links in flat arrays."""

    def __init__(self, v: Vocabularies):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.texts: list[str] = []
        self.numbers = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whether the bytes are the word's
        self.first = np.zeros(1, np.int64)
        self.pairs, self.times = _NONE, _NONE

    def learn(self, fresh: list[str]) -> None:
        """All words at once: as each word has as many bytes in both vocabularies, offsets over all of them are comparable."""
        a_ids, b_ids = self.v.encode_a(fresh), self.v.encode_b(fresh)
        raw = [w.encode() for w in fresh]
        a_of, b_of = self.v.a_bytes.__getitem__, self.v.b_bytes.__getitem__
        same = np.array([b"".join(map(a_of, a)) == r and b"".join(map(b_of, b)) == r for a, b, r in zip(a_ids, b_ids, raw)])
        if not same.all():
            none: list[int] = []
            a_ids, b_ids = ([x if ok else none for x, ok in zip(ids, same.tolist())] for ids in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.v.a_size[a]), np.cumsum(self.v.b_size[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        in_a, in_b = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        n_a, n_b = np.bincount(in_a, minlength=len(ends)), np.bincount(in_b, minlength=len(ends))
        word_end = np.cumsum([len(r) if ok else 0 for r, ok in zip(raw, same)])
        of = np.searchsorted(word_end, ends)  # a group's word
        # each a with each b of its group; of large groups repeated ids are counted first
        large = n_a * n_b > LARGE_GROUP
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        many = np.where(large[in_a], 0, n_b[in_a])
        other = np.repeat(first_b[in_a], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        words_, pairs, times = [np.repeat(of[in_a], many)], [np.repeat(a, many) * WIDTH + b[other]], [np.ones(int(many.sum()), np.int64)]
        for g in np.flatnonzero(large).tolist():
            p, t = linked([Open(a[first_a[g] : first_a[g] + n_a[g]], _NONE, b[first_b[g] : first_b[g] + n_b[g]], _NONE)])
            words_.append(np.full(len(p), of[g]))
            pairs.append(p)
            times.append(t)
        word, pair, time = _by_owner(np.concatenate(words_), np.concatenate(pairs), np.concatenate(times))
        n = len(fresh)
        per = lambda x: np.bincount(of, x, n).astype(np.int64)
        numbers = np.stack([[len(x) for x in a_ids], [len(x) for x in b_ids], np.bincount(of, minlength=n), per(n_a * n_b), same], axis=1).astype(np.int64)
        at = len(self.texts)
        self.numbers = np.concatenate([self.numbers, numbers])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(word, minlength=n))])
        self.pairs, self.times = np.concatenate([self.pairs, pair]), np.concatenate([self.times, time])
        # each token's text with what follows it: a comma within its side of a group, | behind the a side, ; behind the b side
        last_a, last_b = (np.append(x[1:] != x[:-1], True) if len(x) else np.zeros(0, bool) for x in (in_a, in_b))
        codes = np.zeros(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + first_b[in_a]] = 2 * a + last_a
        codes[np.arange(len(b)) + (first_a + n_a)[in_b]] = 2 * len(self.v.a_bytes) + 2 * b + last_b
        self.texts += ["".join(x)[:-1] for x in _pieces(self.v.shown[codes].tolist(), numbers[:, 0] + numbers[:, 1])]
        self.known.update(zip(fresh, range(at, at + n)))
        self.chars += sum(map(len, fresh))

    def aligned(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """(numbers, groups as text, pairs, times) of each text, composed of its words."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        cut = [words(t) if t else [] for t in texts]
        fresh = {w for ws in cut for w in ws}.difference(self.known)
        if fresh:
            self.learn(list(fresh))
        at = [[self.known[w] for w in ws] for ws in cut]
        sizes = np.array([len(ids) for ids in at])
        flat = np.fromiter(chain.from_iterable(at), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.numbers[flat], axis=0)])
        ends = np.cumsum(sizes)
        numbers = sums[ends] - sums[ends - sizes]
        fine = numbers[:, 4] == sizes
        numbers[~fine] = 0
        shows = [";".join([self.texts[i] for i in ids]) if ok else "" for ids, ok in zip(at, fine.tolist())]
        # links: of each text's distinct words, as often as the word occurs
        keep = fine[owner]
        key, n = np.unique(owner[keep] * len(self.texts) + flat[keep], return_counts=True)
        owner, word = np.divmod(key, max(1, len(self.texts)))
        many = self.first[word + 1] - self.first[word]
        place = np.repeat(self.first[word], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        owner, pairs, times = _by_owner(np.repeat(owner, many), self.pairs[place], self.times[place] * np.repeat(n, many))
        ends = np.searchsorted(owner, np.arange(1, len(texts)))
        return numbers, shows, np.split(pairs, ends), np.split(times, ends)


@functools.lru_cache(maxsize=1)
def _words(a_path: str, b_path: str) -> Words:
    return Words(_vocabularies(a_path, b_path))


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > SLICE:
            yield i, j
            i = j
            size = 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, times array<long>"
_NODE = "row long, doc_id long, node long, start long, fine boolean, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>, open array<long>"


def _flat(f: Fragment) -> np.ndarray:
    """A fragment's open ends as one array of numbers."""
    sides = [f.head] if f.tail is None else [f.head, f.tail]
    return np.concatenate([[len(sides)], *[x for s in sides for x in ([len(s.a), len(s.b)], *s)]]).astype(np.int64)


def _unflat(x: np.ndarray) -> Fragment:
    sides, at = [], 1
    for _ in range(int(x[0])):
        n, m = int(x[at]), int(x[at + 1])
        sides.append(Open(*np.split(x[at + 2 : at + 2 + 2 * (n + m)], [n, 2 * n, 2 * n + m])))
        at += 2 + 2 * (n + m)
    return Fragment(sides[0], (), sides[1] if len(sides) > 1 else None)


def _node(row, doc_id, node, f: Fragment, groups, fine: bool, n_a: int, n_b: int) -> dict:
    """One node of a text's tree: the groups closed in it, and its open ends."""
    pairs, times = linked(groups)
    start = int(groups[0].a_end[0]) if groups else 0
    return {"row": row, "doc_id": doc_id, "node": node, "start": start, "fine": fine, "n_a": n_a, "n_b": n_b, "n_groups": len(groups), "n_links": int(times.sum()), "groups": shown(groups), "pairs": pairs, "times": times, "open": _flat(f)}


def _long_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The rows of _ALIGNED of docs(doc_id, text), one text a row, by ranges of the texts and rounds of composition."""
    import pandas as pd

    size = RANGE

    def ranges(batches):
        v = _vocabularies(a_path, b_path)
        for pdf in batches:
            for row, doc_id, text in zip(pdf["row"], pdf["doc_id"], pdf["text"]):
                text = " " + text
                # about as many characters as give the wanted bytes
                step = max(1, size * len(text) // len(text.encode()))
                bounds = [(0, 0)] + [(v.cut_a(text, k), v.cut_b(text, k)) for k in range(step, len(text), step)] + [(len(text), len(text))]
                at = [0, 0]
                for node, ((a0, b0), (a1, b1)) in enumerate(zip(bounds, bounds[1:])):
                    one, two = text[a0:a1], text[b0:b1]
                    yield pd.DataFrame({"row": [row], "doc_id": [doc_id], "node": [node], "a_at": [at[0]], "b_at": [at[1]], "a_text": [one], "b_text": [two]})
                    at = [at[0] + len(one.encode()), at[1] + len(two.encode())]

    def leaves(batches):
        v = _vocabularies(a_path, b_path)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                tokens, same = v.tokens(r.a_text, r.b_text, r.a_at, r.b_at)
                f = fragment(tokens)
                yield pd.DataFrame([_node(r.row, r.doc_id, r.node, f, f.groups if same else (), same, len(tokens.a), len(tokens.b))])

    def compose(pdf):
        pdf = pdf.sort_values("node")
        f, groups = Fragment(), []
        for x in pdf["open"]:
            f = composed(f, _unflat(np.asarray(x)))
            groups += f.groups
            f = f._replace(groups=())
        fine = bool(pdf["fine"].all())
        return pd.DataFrame([_node(pdf["row"].iloc[0], pdf["doc_id"].iloc[0], int(pdf["node"].iloc[0]) // FAN, f, groups if fine else (), fine, 0, 0)])

    def close(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                f = _unflat(np.asarray(r.open))
                # the start of a text closes its prefix; nothing may be open at its end
                whole = r.fine and f.tail is not None and not len(f.tail.a) and not len(f.tail.b)
                yield pd.DataFrame([_node(r.row, r.doc_id, 0, Fragment(), (f.head,) if whole else (), whole, 0, 0)])

    given = docs.withColumn("row", -1 - F.monotonically_increasing_id()).select("row", "doc_id", "text")
    parts = written(given.mapInPandas(ranges, "row long, doc_id long, node long, a_at long, b_at long, a_text string, b_text string"))
    most = parts.agg(F.max("node")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], _ALIGNED)
    n = int(min(10_000, max(8, parts.count())))
    level = written(parts.repartition(n, "row", "node").mapInPandas(leaves, _NODE))
    levels = [level]
    while most > 0:
        level = written(level.select("row", "doc_id", "node", "fine", "open").groupBy("row", F.floor(F.col("node") / FAN)).applyInPandas(compose, _NODE))
        levels.append(level)
        most //= FAN
    levels.append(written(level.mapInPandas(close, _NODE)))
    every = functools.reduce(DataFrame.union, levels)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("n_groups") > 0, F.struct("start", "groups")))), lambda x: x["groups"]), ";")
    one = every.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.min("fine").alias("fine"), *[F.sum(c).alias(c) for c in _COUNTS], text.alias("groups"))
    links = every.select("row", F.inline(F.arrays_zip("pairs", "times"))).groupBy("row", "pairs").agg(F.sum("times").alias("times"))
    links = links.groupBy("row").agg(F.collect_list("pairs").alias("pairs"), F.collect_list("times").alias("times"))
    out = one.join(links, "row", "left")
    fine = lambda c, other: F.when(F.col("fine"), F.coalesce(c, other)).otherwise(other).alias(c)
    none = F.array().cast("array<long>")
    digest = F.when(F.col("fine"), F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return out.select("row", "doc_id", *[fine(c, F.lit(0).cast("long")) for c in _COUNTS], fine("groups", F.lit("")), digest, fine("pairs", none), fine("times", none))


def aligned(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = True) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups, groups_sha256, pairs and times of every row of docs(doc_id, text); other columns are ignored.

    a_path: a byte-level vocabulary (tokenizers), b_path: one of pieces (sentencepiece), both readable on every executor. A space and the text are
    tokenised; where both kinds of tokens end, groups part: groups shows them as a1,a2|b1;a3|b2,b3 (null with keep_groups False; the digest is
    there anyway). pairs are the ids linked in the text, as a * WIDTH + b, with how often. row tells documents apart, repeated rows too. Texts null or empty, and those
    whose tokens' bytes are not theirs, have no tokens: zeros, no links, and '' for groups and digest.

    A text is a sequence of words whose fragments are closed; a task makes each word's once. Texts of more than RANGE bytes are cut into ranges, wherever
    each vocabulary allows it; any tasks turn them into fragments, and rounds of composition, FAN to one, close what was open between them.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    large = F.octet_length("text") > RANGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _words(a_path, b_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _slices(texts):
                numbers, shows, pairs, times = w.aligned(texts[i:j])
                digests = [hashlib.sha256(s.encode()).hexdigest() if n else "" for s, n in zip(shows, numbers[:, 0].tolist())]
                lists = lambda x: pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), pa.array(np.concatenate(x)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(i, j - i) for k in range(2)] + [pa.array(numbers[:, k]) for k in range(4)]
                    + [pa.array(shows if keep_groups else [None] * (j - i), pa.string()), pa.array(digests, pa.string()), lists(pairs), lists(times)],
                    ["row", "doc_id", *_COUNTS, "groups", "groups_sha256", "pairs", "times"],
                )

    short = slim.where(~large).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(run, _ALIGNED)
    rest = _long_texts(slim.where(large), a_path, b_path)
    return short.unionByName(rest if keep_groups else rest.withColumn("groups", F.lit(None).cast("string")))


def link_counts(texts: DataFrame) -> DataFrame:
    """(pair, count, best) of aligned rows: how many of them hold a pair of ids, and whether no pair of its a is in more."""
    n = texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    # an a has no more partners than the other vocabulary has ids
    return n.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy(F.floor(F.col("pair") / WIDTH))))


def scored(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs(doc_id, text): count_sum adds up, over a row's links, how
    many rows hold that pair of ids; n_best counts the links whose pair is in as many rows as any of its a. Rows and texts as in aligned()."""
    texts = written(aligned(docs, a_path, b_path, keep_groups=False).drop("groups"))
    counts = written(link_counts(texts))
    side = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    links = texts.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))).alias("pair", "times")).join(side, "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = texts.select("row", "doc_id", *_COUNTS, "groups_sha256").join(sums, "row", "left")
    return out.select("doc_id", *_COUNTS, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
