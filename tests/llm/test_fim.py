"""Fill-in-middle against a plain version that matches units by a regular expression."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from veinstone.llm import fim
from veinstone.llm import queries as Q

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, percent=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    pieces = ["a", "bc", " ", "  ", "\t", "\n", "\x0b", "\x1f", "\x08", "\x0e", "é", "日本", "\U0001f600", " ", "　", "!", "\x00", "\x7f", "<", "P>", "\x85"]
    out = [None, "", " ", "\n\n", "x", " x ", "<P>x y", "a<S>", "<M>", "<S", "<P <S <M", "ab>" * 9, "eightby8", "sevenby", "word " * 40_000, "x" * 600_000, " " * 9000, "日" * 70_000 + " b"]
    return out + ["".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(400)]


@pytest.mark.parametrize("percent,spm", [(50, 80), (100, 50), (0, 80)])
def test_same_as_plain_version(spark, percent, spm):
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts())]
    # extra columns, some by the names that are added
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("?"), "output": F.lit(1), "_h0": F.lit(0.5), "kept": F.array(F.lit(1))})
    out = fim.transformed(df, percent, spm)
    assert set(out.columns) == {"doc_id", "text", "_h0", "kept", "n", "form", "prefix_chars", "middle_chars", "output"}
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    told = lambda r: tuple((x is None, x) for x in r)
    have = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=told)
    assert have == sorted(((i, *plain(i, t, percent, spm)) for i, t in rows), key=told)
    assert all(r.back == (r.text or "") and r.kept == [1] for r in got)
    assert {r.form for r in got} >= ({"psm", "spm"} if percent else {"plain"})


def test_repeats_and_empty_tables(spark):
    rows = [(7, "a b c d e f")] * 3
    got = fim.transformed(spark.createDataFrame(rows, "doc_id long, text string"), percent=100).collect()
    assert len(got) == 3 and len({tuple(r) for r in got}) == 1
    assert fim.transformed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_marks_over_block_borders(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 2)
    some = [t.encode() for t in texts() if t and len(t) < 1000]
    words, first = fim.packed(some)
    last = first[:-1] * 8 + np.array([len(t) for t in some]) - 1
    marks = fim.unit_ends(words, last)
    bits = (marks.view(np.uint8) >> 7).reshape(-1)
    for t, f in zip(some, first[:-1] * 8):
        ends = [len(t.decode()[: m.end()].encode()) - 1 for m in UNIT.finditer(t.decode())]
        assert np.flatnonzero(bits[f : f + len(t)]).tolist() == ends


def test_query_same_as_sql(spark):
    assert_same(spark, "op11_fill_in_middle", Q.QUERIES["op11_fill_in_middle"], Q.ORACLES["op11_fill_in_middle"])
