"""Benchmark decontamination through templates: numbers, names and units become typed slots.

Words lose their punctuation and case; windows of the words and slots are hash-joined with the
benchmark's; where they line up, a benchmark's slot value must always stand for the same value of
the document. So a question is found again with other numbers or names in it, also where a value has
more or fewer words than before, or a word was put in or left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.bitmap import KeyBitmap
from veinstone.llm.hashing import U64, grouped, mix, slices, word_hashes

#: Texts are read about so many bytes at a time; a word takes some thirty numbers of eight bytes on the way.
PIECE = 1 << 18
WINDOW = 8
#: A window must have so many plain words.
PLAIN = 4
#: So many consecutive windows of an item at one alignment (20 words) tell by themselves, however long the item is.
RUN = 13
#: Units (fixed values).
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "l ml liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit mph kmh watt watts volt volts"
).split()
#: Numbers in words (fixed values).
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half"
).split()
#: First names that count as names at the start of a sentence too (fixed values).
NAMES = (
    "alice bob carol dave david emma frank george helen henry jack james jane john julia kate laura lisa maria mark mary michael "
    "nina oliver paul peter robert sam sarah sophie susan thomas tim tom william"
).split()
_NUMBER, _NAME, _UNIT = (U64(x) for x in (0xA5A5A5A5A5A5A5A1, 0xA5A5A5A5A5A5A5A2, 0xA5A5A5A5A5A5A5A3))
#: Sets the value of a slot at an item's edge apart: in a document, a slot next to the item may have run into it.
_EDGE = 0x2545F4914F6CDD1D
_RNG = np.random.default_rng(77)
_ROLL = _RNG.integers(1, 2**63, WINDOW, dtype=np.int64).astype(U64) | U64(1)
_UNIT_HASHES = np.sort(np.concatenate([word_hashes(w.encode()) for w in UNITS]))
_NUMBER_HASHES = np.sort(np.concatenate([word_hashes(w.encode()) for w in NUMBERS]))
_NAME_HASHES = np.sort(np.concatenate([word_hashes(w.encode()) for w in NAMES]))
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _WORDLIKE[_a:_b] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 58, 63]] = True


def canonical(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hashes, value hashes, words of each text), pieces of punctuation alone left out.

    A run of slots of one kind (Anna Maria, 1 000) is one word, whose value is that of the whole run.
    Both hashes are the same for plain words. A word that begins with a digit, or is a number in words, is a number. A
    capitalised, not all-capital word is a name if no sentence begins with it, or it is a known first name."""
    templates, values, counts = [], [], []
    for i, j in grouped(texts, PIECE):
        if len(texts[i]) > 2 * PIECE:  # one long text, piece by piece
            data, at, fresh, n = texts[i], 0, True, 0
            while at < len(data):
                end = min(at + PIECE, len(data))
                while end < len(data) and not _SPACE[data[end]]:
                    end += 1
                t, v, _, fresh = _piece(data[at:end], fresh)
                templates.append(t)
                values.append(v)
                n, at = n + len(t), end
            counts.append(np.array([n]))
            continue
        # a stop between texts: none of them goes on with the sentence of the one before
        t, v, starts, _ = _piece(b" . ".join(texts[i:j]), True)
        begins = np.cumsum([0, *(len(x) + 3 for x in texts[i : j - 1])])
        templates.append(t)
        values.append(v)
        counts.append(np.bincount(np.searchsorted(begins, starts, side="right") - 1, minlength=j - i))
    if not counts:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64)
    return _collapsed(np.concatenate(templates), np.concatenate(values), np.concatenate(counts))


def _is_slot(templates: np.ndarray) -> np.ndarray:
    return (templates == _NUMBER) | (templates == _NAME) | (templates == _UNIT)


def _collapsed(templates: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each run of slots of one kind within a text becomes one word."""
    if not len(templates):
        return templates, values, counts
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.ones(len(templates), bool)
    first[1:] = ~((templates[1:] == templates[:-1]) & _is_slot(templates[1:]) & (owner[1:] == owner[:-1]))
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, len(templates)))
    place = np.arange(len(templates)) - np.repeat(at, length)
    whole = np.add.reduceat(mix(values + place.astype(U64) * _ROLL[0]), at)
    return templates[at], np.where(length > 1, whole, values[at]), np.bincount(owner[at], minlength=len(counts))


def _piece(data: bytes, fresh: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(templates, values, where each word starts, whether a sentence ends here)."""
    raw = np.frombuffer(data, np.uint8).copy()
    nothing = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), fresh
    if not len(raw):
        return nothing
    upper = (raw >= 65) & (raw <= 90)
    wide = np.zeros(len(raw), bool)
    wide[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)  # capitals with accents
    raw[wide] += 0x20
    capital = upper.copy()
    capital[:-1] |= wide[1:]
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return nothing
    n = len(starts)
    wordlike = _WORDLIKE[raw]
    token = np.cumsum(first) - 1
    token[space] = n  # of none
    inside = np.flatnonzero(wordlike)
    own = token[inside]
    letters = np.bincount(own, minlength=n + 1)[:n]
    has = letters > 0
    lead = np.zeros(n, np.int64)  # where each word's first letter or digit is
    head = np.ones(len(own), bool)
    head[1:] = own[1:] != own[:-1]
    lead[own[head]] = inside[head]
    caps = np.bincount(token[upper], minlength=n + 1)[:n]
    ends_sentence = np.bincount(token[_STOP[raw]], minlength=n + 1)[:n] > 0
    values = word_hashes(raw[wordlike | space].tobytes())  # words without letters or digits are gone
    begins = np.concatenate([[fresh], ends_sentence[:-1]])[has]
    lead, caps, letters = lead[has], caps[has], letters[has]
    digit = (raw[lead] >= 48) & (raw[lead] <= 57) | np.isin(values, _NUMBER_HASHES)
    name = capital[lead] & (caps < np.maximum(2, letters)) & (letters > 1) & (~begins | np.isin(values, _NAME_HASHES))
    unit = np.isin(values, _UNIT_HASHES)
    templates = np.where(digit, _NUMBER, np.where(name, _NAME, np.where(unit, _UNIT, values)))
    return templates, values, starts[has], bool(ends_sentence[-1])


def windows(templates: np.ndarray, counts: np.ndarray, size: int, plain: int = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of the windows of `size` words within a text with enough plain ones."""
    m = len(templates) - size + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.full(m, U64(size))
    for k in range(size):
        h = h + templates[k : k + m] * _ROLL[k]
    held = np.concatenate([[0], np.cumsum(~_is_slot(templates))])
    owner = np.repeat(np.arange(len(counts)), counts)
    ok = (held[size:] - held[:m] >= plain) & (owner[:m] == owner[size - 1 :])
    return mix(h)[ok], np.flatnonzero(ok)


def _verbatim(values: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of windows of values. Shorter ones than WINDOW must be the whole text."""
    h, at = windows(values, counts, size, 0)
    if size < WINDOW:
        whole = np.repeat(counts, counts)[at] == size
        h, at = h[whole], at[whole]
    return mix(h ^ _NAME), at


def _sizes(words: np.ndarray) -> np.ndarray:
    """The size of the smaller windows of items of so many words, 0 for none. An extra word spoils size - 1 windows of an item:
    with fewer than 3 * WINDOW - 3 words too few would be left, with smaller windows half of them are."""
    return np.where((words >= 12) & (words < 3 * WINDOW - 3), words // 3 + 1, 0)


def _found(ids: list[int], texts: list[bytes], sizes: list[int] | None, known: KeyBitmap | None) -> Iterator[tuple]:
    """(id, pos, hash, values of slots, windows of the text, rank among them, size) of the windows that known may hold. sizes
    None: the texts are benchmark items, with windows as long as the text where that is short, smaller ones too
    where it is middling, and, without a usable window, windows of values, whose size is given as negative."""
    templates, values, counts = canonical(texts)
    begin = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    usable = np.zeros(len(counts), bool)
    shown = values
    if sizes is None:
        edge = np.concatenate([begin[counts > 0], (begin + counts - 1)[counts > 0]])
        shown = values.copy()
        shown[edge] = values[edge] ^ U64(_EDGE)
    for size in [*range(PLAIN, WINDOW + 1), *range(-WINDOW, 0)] if sizes is None else sizes:
        h, at = windows(templates, counts, size) if size > 0 else _verbatim(values, counts, -size)
        if sizes is None:
            mine = np.minimum(counts, WINDOW) == abs(size)
            if size > 0:
                mine |= _sizes(counts) == size
            else:
                mine &= ~usable
            mine = mine[owner[at]]
            h, at = h[mine], at[mine]
            usable[owner[at]] |= size > 0
        n = np.bincount(owner[at], minlength=len(counts)) if len(at) else counts
        rank = np.arange(len(at)) - (np.cumsum(n) - n)[owner[at]] if len(at) else at
        if known is not None:
            hit = known.holds(h.view(np.int64))
            h, at, rank = h[hit], at[hit], rank[hit]
        for x, p, r in zip(h.view(np.int64).tolist(), at.tolist(), rank.tolist()):
            t, v = templates[p : p + abs(size)], values[p : p + abs(size)]
            who = owner[p]
            yield ids[who], p - int(begin[who]), x, shown[p : p + abs(size)][t != v].view(np.int64).tolist(), int(n[who]), r, size


def _table(frame: DataFrame, id_: str, sizes: list[int] | None, known) -> DataFrame:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32()]
    names = [id_, "pos", "hash", "vals", "n", "rank", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in slices(batch.column(1), PIECE):
                out = list(_found(batch.column(0).slice(i, j - i).to_pylist(), texts, sizes, None if known is None else known.value))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    slim = frame.select(F.col(id_).cast("long").alias(id_), "text").where(f"{id_} is not null and text is not null")
    return slim.mapInArrow(run, f"{id_} long, pos long, hash long, vals array<long>, n long, rank long, size int")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage, reworded) for each document that holds a benchmark item.

    docs(doc_id, text), benchmark(item_id, text). An alignment counts if in it each slot value of the item always meets
    the same value; two values of an item may meet one, as new numbers are equal by chance often enough. An item is held if at least the share `least` of its windows match, over all alignments that
    count, or RUN consecutive ones at one of them. reworded: some matched window is in no alignment without a differing
    slot value. Items without a usable window are held word for word: from WINDOW words on anywhere in the document, shorter ones
    if they are all of it. Rows without id or text, and empty tables give no rows; repeated rows of one id count as one. Only document windows that pass a bitmap (at most 16 MB, whatever the
    benchmark's size) of the benchmark's hashes are shuffled.
    """
    items = _table(benchmark, "item_id", None, None).dropDuplicates(["item_id", "pos", "hash"]).persist()
    try:
        sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
        if not sizes:
            return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched long, windows long, coverage double, reworded boolean")
        known = docs.sparkSession.sparkContext.broadcast(KeyBitmap.of(items, "hash"))
    finally:
        items.unpersist()
    found = _table(docs, "doc_id", sizes, known).select("doc_id", F.col("pos").alias("at"), "hash", F.col("vals").alias("here"))
    joined = found.join(items.select("item_id", "pos", "hash", "vals", "n", "rank", "size"), "hash")
    # of an item with one window many times over, a document's window meets each of its places: once per alignment
    pairs = F.zip_with("vals", "here", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    aligned = joined.groupBy("doc_id", "item_id", "size", (F.col("at") - F.col("pos")).alias("shift")).agg(
        F.array_sort(F.collect_set("rank")).alias("ranks"), F.max("n").alias("windows"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    steady = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs")
    whole = (F.col("size") > 0) | (F.size("ranks") == F.col("windows"))
    in_a_row = F.exists(F.transform("ranks", lambda r, i: F.get("ranks", i + (RUN - 1)) - r == RUN - 1), lambda b: F.coalesce(b, F.lit(False)))
    aligned = aligned.where(steady & whole).select(
        "doc_id", "item_id", "size", "windows", (in_a_row & (F.col("size") == WINDOW)).alias("run"),
        F.exists("pairs", lambda p: (p["a"] != p["b"]) & (p["a"].bitwiseXOR(F.lit(_EDGE)) != p["b"])).alias("differs"), F.explode("ranks").alias("rank"),
    )
    # each window once, whatever the number of alignments it matches in
    once = aligned.groupBy("doc_id", "item_id", "size", "rank").agg(F.max("windows").alias("windows"), F.max("run").alias("run"), F.min("differs").alias("differs"))
    held = once.groupBy("doc_id", "item_id", "size").agg(F.count(F.lit(1)).alias("matched"), F.max("windows").alias("windows"), F.max("run").alias("run"), F.max("differs").alias("reworded"))
    held = held.withColumn("coverage", F.col("matched") / F.col("windows")).where(F.col("run") | (F.col("coverage") >= least))
    best = held.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "matched", "windows", "reworded")).alias("b"))
    return best.select("doc_id", "item_id", "b.matched", "b.windows", "b.coverage", "b.reworded")
