"""Jaccard joins of shingle sets through PartEnum signatures.

Sets fall into bands of about equal size. Two sets of one band or of neighbouring bands with
Jaccard similarity of at least 0.8 differ in at most k elements, k fixed for the pair of bands. The
hashed feature domain is cut into n1 groups of n2 parts; of more than k / (k2 + 1) groups, at least
one holds at most k2 of the differences, so the two sets agree on some n2 - k2 of its parts. A
signature is the hash of all of a set's elements in such a choice of parts, and every choice is
enumerated; similar sets share a signature.

With t groups more than needed, similar sets share signatures in at least t + 1 groups. So a set
may leave out up to t signatures that tell little: empty ones, and those of crowds, sets by the
dozen that share a passage. Two sets that both would have to leave out more meet in another exact
way: by the rarest fifth of their shingles, of which similar sets share one.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.llm.bitmap import KeyBitmap
from veinstone.operators.graph import components
from veinstone.llm.hashing import U64, batch_words, distinct, mix, shingles, slices
from veinstone.operators.lineage import written

#: Similarity as a fraction: 80 / 100.
NUM, DEN = 80, 100
#: Signatures that more sets share are crowded.
CROWD = 16
#: A crowd whose pairs are compared is dealt out in shares of about so many members.
SHARE = 256
_LOW = U64(127)


@functools.lru_cache(maxsize=None)
def bands() -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper sizes of each band: up to size / 0.8. Sets of fewer than four elements have no other similar set."""
    low, high = [4], [5]
    while high[-1] < 1 << 34:
        low.append(high[-1] + 1)
        high.append(low[-1] * DEN // NUM)
    return np.array(low), np.array(high)


@functools.lru_cache(maxsize=None)
def plan(band: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, t) for pairs whose smaller set is in the band, with the fewest signatures that still hold enough elements."""
    low, high = int(bands()[0][band]), int(bands()[1][band])
    k = (high + high * DEN // NUM) * (DEN - NUM) // (DEN + NUM)
    best = None
    for k2 in range(0, min(k, 7) + 1):
        for n2 in range(k2 + 1, k2 + 6):
            for t in [*range(0, 24), *(int(24 * 1.1**i) for i in range(1, 120))]:
                n1 = k // (k2 + 1) + 1 + t
                each = math.comb(n2, k2)
                held = low * (n2 - k2) / (n1 * n2)
                empty = n1 * each * math.exp(-held)
                if held < 1.8 or t > k + 8:
                    break
                if empty > 0.15 if t == 0 else t < empty + 2.5 * math.sqrt(empty) + 2:
                    continue
                if best is None or n1 * each < best[0]:
                    best = n1 * each, (n1, n2, k2, t)
                break
    # the smallest sets: one group, all choices of so many of its parts as no difference can reach
    return best[1] if best else (1, k + 3, k, 0)


def signatures(h: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, owner, spare) of sets given as distinct hashes by owner; the lowest 7 bits of a signature are its band.

    spare: how many more signatures of that band the set may leave out, after its empty ones. A set with too many empty
    ones leaves out none of these, and must not leave out any other: its spare is -1."""
    low, high = bands()
    own = np.searchsorted(low, sizes, side="right") - 1
    out_s, out_o, out_k = [], [], []
    start = np.concatenate([[0], np.cumsum(sizes)])
    for back in (0, 1):
        band_of = np.where(sizes >= 4, own - back, -1)
        if back:  # as the larger set of a pair with the band below
            reach = high[np.maximum(band_of, 0)] * DEN // NUM
            band_of = np.where((band_of >= 0) & (sizes <= reach), band_of, -1)
        for band in np.unique(band_of[band_of >= 0]):
            n1, n2, k2, t = plan(int(band))
            sets = np.flatnonzero(band_of == band)
            pos = np.concatenate([np.arange(start[s], start[s + 1]) for s in sets])
            row = np.repeat(np.arange(len(sets)), sizes[sets])
            seed = mix(np.array([band + 1], U64) * U64(0xD1342543DE82EF95))
            x = mix(h[pos] ^ seed)
            group = ((x >> U64(32)) * U64(n1)) >> U64(32)
            part = ((x & U64(0xFFFFFFFF)) * U64(n2)) >> U64(32)
            cell = (row * n1 + group.astype(np.int64)) * n2 + part.astype(np.int64)
            total = np.zeros(len(sets) * n1 * n2, U64)
            np.add.at(total, cell, mix(x))
            count = np.bincount(cell, minlength=len(total)).reshape(-1, n2)
            total = total.reshape(-1, n2)
            where = np.tile(np.arange(n1, dtype=np.int64), len(sets))
            whose = np.repeat(np.arange(len(sets)), n1)
            sigs, empties = [], []
            for c, kept in enumerate(combinations(range(n2), n2 - k2)):
                s = total[:, kept].sum(1)
                s = mix(s + mix((where * 1024 + c).astype(U64) ^ seed))
                sigs.append((s & ~_LOW) | U64(band))
                empties.append(count[:, kept].sum(1) == 0)
            sig, empty = np.stack(sigs, 1), np.stack(empties, 1)
            hollow = np.bincount(whose, weights=empty.sum(1), minlength=len(sets))
            keep = ~empty | (hollow > t)[whose][:, None]
            rows = np.repeat(whose, keep.sum(1))
            out_s.append(sig[keep])
            out_o.append(sets[rows])
            out_k.append(np.where(hollow > t, -1, t - hollow).astype(np.int32)[rows])
    if not out_s:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(out_s), np.concatenate(out_o), np.concatenate(out_k)


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: (first, last, hashes, owner, sizes, class), class the hash of the whole set, 0 if empty."""
    for i, j, raw in slices(texts):
        h, owner = distinct(*shingles(*batch_words(raw)))
        sizes = np.bincount(owner, minlength=j - i)
        total = np.zeros(j - i, U64)
        np.add.at(total, owner, mix(h))
        cls = np.where(sizes > 0, mix(total ^ (sizes.astype(U64) * U64(0x9E3779B97F4A7C15))), U64(0))
        yield i, j, h, owner, sizes, cls


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def parity_sketches(h: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set, whether an even or odd number of its hashes falls on each of 64 places or more, about as many as it
    has hashes. Two sketches differ in at most as many places as the sets in elements."""
    bits = np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(1 << bits)])
    place = begin[owner] + (h & ((U64(1) << bits[owner].astype(U64)) - U64(1))).astype(np.int64)
    odd = (np.bincount(place, minlength=int(begin[-1])) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little")
    return [packed[a >> 3 : b >> 3].tobytes() for a, b in zip(begin[:-1], begin[1:])]


def _apart(x: bytes, y: bytes) -> int:
    """In how many places two sketches differ, the longer one folded."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) for z in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), cls (hash of the set, null if it is empty), sketch, for every row."""

    def run(batches):
        for batch in batches:
            n, c, k = [np.zeros(0, np.int64)], [np.zeros(0, U64)], []
            for _, _, h, owner, sizes, cls in _sets(batch.column(1)):
                n.append(sizes)
                c.append(cls)
                k += parity_sketches(h, owner, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n).astype(np.int64)), _long(np.concatenate(c)), pa.array(k, pa.binary())], ["doc_id", "n", "cls", "sketch"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, cls long, sketch binary")
    return out.withColumn("cls", F.when(F.col("n") > 0, F.col("cls")))


def signature_rows(docs: DataFrame) -> DataFrame:
    """(sig, cls, spare) of every set, once for each batch in which it occurs, however many copies the batch holds."""

    def run(batches):
        for batch in batches:
            seen = np.zeros(0, U64)
            for _, _, h, owner, sizes, cls in _sets(batch.column(0)):
                _, first = np.unique(cls, return_index=True)
                fresh = np.zeros(len(cls), bool)
                fresh[first] = True
                fresh &= (sizes >= 4) & ~np.isin(cls, seen)
                seen = np.concatenate([seen, cls[fresh]])
                renamed = np.cumsum(fresh) - 1
                mine = fresh[owner]
                sig, own, spare = signatures(h[mine], renamed[owner[mine]], sizes[fresh])
                if len(sig):
                    yield pa.RecordBatch.from_arrays([_long(sig), _long(cls[fresh][own]), pa.array(spare)], ["sig", "cls", "spare"])

    return docs.select("text").where("text is not null").mapInArrow(run, "sig long, cls long, spare int")


def _matches(batches: Iterator[pa.RecordBatch], chain: bool = False) -> Iterator[pa.RecordBatch]:
    """From (sig, cls, spare) sorted by sig and cls: rows (a, b) of candidate pairs, and (a, sig, spare) for each member
    a of a crowd; what a row hasn't is null.

    Up to CROWD sets that share a signature give all their pairs; with chain, in a crowd each member is
    paired with the first and with the one before. Memory holds one batch and one run of CROWD rows.
    """
    head = last = None  # of a crowd that goes on from the batch before
    none = np.zeros(0, np.int64)
    carry = (none, none, np.zeros(0, np.int32))

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((hi, lo))
        lo, hi = lo[order], hi[order]
        keep = np.ones(len(lo), bool)
        keep[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        n = int(keep.sum())
        return pa.RecordBatch.from_arrays([pa.array(lo[keep]), pa.array(hi[keep]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], ["a", "b", "sig", "spare"])

    def crowd(s: np.ndarray, c: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c), pa.nulls(len(c), pa.int64()), pa.array(s), pa.array(k)], ["a", "b", "sig", "spare"])

    def settle(s: np.ndarray, c: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs, or the first part of one crowd."""
        if not len(s):
            return
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        n = np.diff(first, append=len(s))
        many = np.repeat(n > 1, n)
        s, c, k, n = s[many], c[many], k[many], n[n > 1]
        if not len(n):
            return
        begin = np.repeat(np.cumsum(n) - n, n)
        small = np.repeat(n <= CROWD, n)
        a, b = [], []
        for o in range(1, min(CROWD, int(n.max()))):
            ok = small[o:] & (begin[o:] == begin[:-o])
            a.append(c[:-o][ok])
            b.append(c[o:][ok])
        at = np.flatnonzero(~small & (np.arange(len(s)) > begin)) if chain else np.zeros(0, np.int64)
        yield pairs(np.concatenate([*a, c[begin[at]], c[at - 1]]), np.concatenate([*b, c[at], c[at]]))
        if not small.all():
            yield crowd(s[~small], c[~small], k[~small])

    for batch in batches:
        s, c, k = (np.concatenate([x, y.to_numpy()]) for x, y in zip(carry, batch.columns))
        if not len(s):
            continue
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        if head is not None and s[0] == head[0] and c[0] == last:
            new[0] = False
        s, c, k = s[new], c[new], k[new]
        if head is not None:
            apart = np.flatnonzero(s != head[0])
            more = int(apart[0]) if len(apart) else len(s)
            if more and chain:
                yield pairs(np.concatenate([np.full(more, head[1]), [last], c[: more - 1]]), np.concatenate([c[:more], c[:more]]))
            if more:
                yield crowd(s[:more], c[:more], k[:more])
                last = c[more - 1]
            s, c, k = s[more:], c[more:], k[more:]
            if not len(s):
                carry = (s, c, k)
                continue
            head = None
        apart = np.flatnonzero(s != s[-1])
        tail = int(apart[-1]) + 1 if len(apart) else 0
        yield from settle(s[:tail], c[:tail], k[:tail])
        carry = (s[tail:], c[tail:], k[tail:])
        if len(carry[0]) > CROWD:
            yield from settle(*carry)
            head, last = (carry[0][0], carry[1][0]), carry[1][-1]
            carry = tuple(x[:0] for x in carry)
    yield from settle(*carry)


def _elements(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, elements): the sets of the documents in ids(doc_id), as packed hashes. Other texts leave the scan at a
    bitmap of the ids, of at most 16 MB."""
    known = docs.sparkSession.sparkContext.broadcast(KeyBitmap.of(ids, "doc_id"))

    def sets(batches):
        for batch in batches:
            doc, text = batch.column(0), batch.column(1)
            keep = np.flatnonzero(known.value.holds(doc.to_numpy()))
            if not len(keep):
                continue
            doc, text = doc.take(pa.array(keep)), text.take(pa.array(keep))
            blobs = []
            for _, _, h, owner, sizes, _ in _sets(text):
                ends = np.cumsum(sizes)
                blobs += [h[e - z : e].tobytes() for e, z in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays([doc, pa.array(blobs, pa.binary())], ["doc_id", "elements"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").mapInArrow(sets, "doc_id long, elements binary")
    return held.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def possible(pairs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) of keys as pairs of documents, without those whose sizes or sketches rule them out. known(key, rep, n, sketch)."""
    side = lambda x: known.select(F.col(key).alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    fit = F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM

    def run(batches):
        for batch in batches:
            n = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (DEN - NUM) // (DEN + NUM)
            near = [_apart(x, y) <= k for x, y, k in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    full = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").where(fit).where("rep_a <> rep_b")
    return full.select("rep_a", "rep_b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of doc_ids, those whose texts' sets are similar. Only the sets of documents in pairs are shuffled."""
    held = written(_elements(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a").join(held.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def rare_prefixes(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(sig, cls, spare): for each document in ids(doc_id) its rarest shingles among them, one more than a similar set can
    lack; spare is the shingle's place in the order of rarity, from 1."""

    def spread(batches):
        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(blob, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), doc)), pa.array(np.full(len(x), len(x)))], ["sig", "cls", "n"])

    rows = written(_elements(docs, ids).mapInArrow(spread, "sig long, cls long, n long"))
    common = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(W.partitionBy("cls").orderBy("df", "sig"))
    ranked = rows.join(common.where("df > 1"), "sig", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("place", place)
    least = F.ceil(F.col("n") * NUM / DEN)
    return ranked.where((F.col("place") <= F.col("n") - least + 1) & (F.col("df") > 1)).select("sig", "cls", F.col("place").alias("spare"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    A text's set are its distinct shingles of five words (A-Z lower-cased); of fewer words the
    sequence is the one shingle; of none, or for a null text, the set is empty and linked with
    nothing. Texts link when 100 * intersection >= 80 * union. component_id is the smallest doc_id
    reachable. Repeated rows each give a row; rows without doc_id take no part in links.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = written(classes(slim))
    reps = written(told.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    found = signature_rows(slim.where("doc_id is not null")).repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(_matches, "a long, b long, sig long, spare int")
    found = written(found)

    # sets that share too many signatures with crowds to leave those out
    members = found.where("sig is not null").select("sig", F.col("a").alias("cls"), F.col("sig").bitwiseAND(127).cast("int").alias("band"), "spare").distinct()
    heavy = members.groupBy("cls", "band").agg(F.count(F.lit(1)).alias("n"), F.min("spare").alias("spare")).where("n > spare").select("cls").distinct()
    heavy = written(heavy.join(reps, "cls").select(F.col("rep").alias("doc_id"), "rep", "n", "sketch"))
    rare = rare_prefixes(slim, heavy.select("doc_id")).repartition("sig").sortWithinPartitions("sig", "cls")
    more = written(rare.mapInArrow(lambda batches: _matches(batches, chain=True), "a long, b long, sig long, spare int"))
    again = possible(more.where("b is not null"), heavy, "doc_id")
    links = written(verified(written(possible(found.where("b is not null"), reps, "cls").union(again).distinct()), slim))
    part = written(components(links))
    # rare shingles that a crowd shares which is not yet one component: its pairs across components, as far as their
    # places leave it possible: similar sets share at least `both` shingles, so one is among each's rarest n - both + 1
    crowds = more.where("sig is not null").select("sig", F.col("a").alias("rep"), F.col("spare").alias("place")).distinct().join(heavy.select("rep", "n"), "rep")
    crowds = written(crowds.join(part, F.col("rep") == F.col("node"), "left").select("sig", "rep", "n", "place", F.coalesce("component", "rep").alias("part")))
    # a large crowd is dealt over many tasks: each member once on the left, on the right once for each share of the left
    split = crowds.groupBy("sig").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")).where("lo < hi").select("sig", "shares")
    open_ = crowds.join(split, "sig")
    left = open_.withColumn("share", F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int")).select("sig", "share", "rep", "n", "place", "part").toDF("sig", "share", "a", "n_a", "place_a", "part_a")
    right = open_.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("sig", "share", "rep", "n", "place", "part").toDF("sig", "share", "b", "n_b", "place_b", "part_b")
    fit = F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM
    both = F.ceil((F.col("n_a") + F.col("n_b")) * NUM / (NUM + DEN))
    early = (F.col("place_a") <= F.col("n_a") - both + 1) & (F.col("place_b") <= F.col("n_b") - both + 1)
    rest = written(left.join(right, (left["sig"] == right["sig"]) & (left["share"] == right["share"]) & fit & early & (F.col("part_a") < F.col("part_b"))).select("a", "b"))
    rest = written(possible(rest, heavy, "doc_id").distinct())
    if not rest.isEmpty():
        part = written(components(links.union(verified(rest, slim))))
    named_cls = reps.select("cls", "rep").join(part, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component"))
    out = told.select("doc_id", "n", "cls").join(named_cls, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
