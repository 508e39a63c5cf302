"""Alignment of two vocabularies against a plain version that tokenises whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone.llm import crosstok
from veinstone.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers as P

    return str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))


def plain(rows, paths):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) by tokenising whole texts at once."""
    import sentencepiece
    import tokenizers

    one = tokenizers.Tokenizer.from_file(paths[0])
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    from veinstone.llm.tokens import byte_symbols

    byte = {c: i for i, c in enumerate(byte_symbols())}
    links, shows = [], []
    for _, text in rows:
        n, show = Counter(), None
        if text:
            a = [(i, len(bytes(byte[c] for c in one.id_to_token(i))), bytes(byte[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
            raw = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
            b = [(i, len(raw(i)), raw(i)) for i in two.encode(text)]
            whole = (" " + text).encode()
            if b"".join(x[2] for x in a) == whole == b"".join(x[2] for x in b):
                groups, i, j, at = [], 0, 0, [0, 0]
                left, right = [], []
                while i < len(a) or j < len(b):
                    if at[0] <= at[1]:
                        left.append(a[i][0])
                        at[0] += a[i][1]
                        i += 1
                    else:
                        right.append(b[j][0])
                        at[1] += b[j][1]
                        j += 1
                    if at[0] == at[1]:
                        groups.append((left, right))
                        left, right = [], []
                for x, y in groups:
                    for p in x:
                        for q in y:
                            n[p, q] += 1
                show = (len(a), len(b), len(groups), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups))
        links.append(n)
        shows.append(show)
    count = Counter(k for n in links for k in n)
    top = defaultdict(int)
    for (p, _), c in count.items():
        top[p] = max(top[p], c)
    out = []
    for (i, _), n, s in zip(rows, links, shows):
        best = sum(t for (p, q), t in n.items() if count[p, q] == top[p])
        out.append((i, *(s[:3] if s else (0, 0, 0)), sum(n.values()), best, sum(t * count[k] for k, t in n.items()), hashlib.sha256(s[3].encode()).hexdigest() if s else ""))
    return out


def texts():
    rng = random.Random(5)
    pieces = ["the", "Quality", " ", "  ", "\n", "\t", "é", "日本語", "\U0001f600", "'s", "'", "123", "!?", "<|endoftext|>", "<s>", "<0x41>", " ", "x" * 30, "aaa", "\x1c", "\x00", "ﬁ", "é", "，。", "don't", "\r\n"]
    out = [None, "", " ", "   ", "a", "▁", "with ▁ mark", "\n", "end ", "end  ", "end\n", "tab\t x", "word " * 500, "日" * 300 + "。" + "本" * 50, "ab1!" * 200, "x" * 2000]
    return out + ["".join(rng.choices(pieces, k=rng.randrange(1, 30))) for _ in range(150)]


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("size,fan,most", [(1 << 16, 16, 10**6), (40, 2, 0)])
def test_same_as_plain_version(spark, paths, monkeypatch, size, fan, most):
    """Also with texts cut into ranges of 40 bytes that are composed two by two, and counts joined by shuffle."""
    monkeypatch.setattr(crosstok, "RANGE", size)
    monkeypatch.setattr(crosstok, "FAN", fan)
    monkeypatch.setattr(crosstok, "BROADCAST_PAIRS", most)
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts())] + [(7, "twice twice"), (7, "twice twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("?"), "pairs": F.lit(1), "n_a": F.lit(None).cast("int")})
    got = [tuple(r) for r in crosstok.scored(df, *paths).collect()]
    assert sorted(got, key=key) == sorted(plain(rows, paths), key=key)


def test_groups_as_text(spark, paths):
    got = crosstok.aligned(spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string"), *paths).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].groups.count(";") == by[1].n_groups - 1 and hashlib.sha256(by[1].groups.encode()).hexdigest() == by[1].groups_sha256
    assert (by[2].groups, by[2].groups_sha256, by[2].pairs) == ("", "", [])


def test_composition_is_associative():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        ends = [np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(0, n))), n)) for _ in range(2)]
        whole = crosstok.Open(np.arange(len(ends[0])), ends[0], np.arange(len(ends[1])), ends[1])
        # cut each kind on its own, not at the same place
        cuts = [np.sort(rng.integers(0, len(e) + 1, 3)) for e in ends]
        parts = [crosstok.Open(a, x, b, y) for a, x, b, y in zip(np.split(whole.a, cuts[0]), np.split(whole.a_end, cuts[0]), np.split(whole.b, cuts[1]), np.split(whole.b_end, cuts[1]))]
        f = [crosstok.fragment(p) for p in parts]
        c = crosstok.composed
        told = lambda x: (crosstok.shown([x.head]), crosstok.shown(x.groups), x.tail is not None and crosstok.shown([x.tail]))
        want = told(crosstok.fragment(whole))
        assert told(c(c(c(f[0], f[1]), f[2]), f[3])) == told(c(f[0], c(f[1], c(f[2], f[3])))) == told(c(c(f[0], f[1]), c(f[2], f[3]))) == want
        assert told(c(crosstok.Fragment(), f[0])) == told(f[0]) == told(c(f[0], crosstok.Fragment()))
        back = crosstok._unflat(crosstok._flat(f[1]))
        assert told(back._replace(groups=f[1].groups)) == told(f[1])


def test_query_same_as_plain_version(spark, paths):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in Q.op12_cross_tokenizer(spark, DATA).collect()]
    assert sorted(got) == sorted(plain(rows, paths))
    assert crosstok.scored(spark.createDataFrame([], "doc_id long, text string"), *paths).count() == 0


def test_words_of_large_groups_and_a_small_memory(paths, monkeypatch):
    v = crosstok.Vocabularies(*paths)
    some = [t or "" for t in texts()]
    want = crosstok.Words(v).aligned(some)
    monkeypatch.setattr(crosstok, "LARGE_GROUP", 0)
    monkeypatch.setattr(crosstok, "REMEMBERED", 10)
    w = crosstok.Words(v)
    for i, t in enumerate(some):
        numbers, shows, pairs, times = w.aligned([t])
        assert numbers[0].tolist()[:4] == want[0][i].tolist()[:4] and shows == [want[1][i]]
        assert pairs[0].tolist() == want[2][i].tolist() and times[0].tolist() == want[3][i].tolist()
