"""Dates and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinstone.functions import checks as C
from veinstone.functions import dates as D


def test_dates(spark):
    rows = ["2026-01-02T03:04:05+01:00", "2026-01-02T03:04:05Z", "2026-01-02T03:04:05+25:00", "1960-01-02T03:04:05Z", "2026-13-02T03:04:05Z", "x", None]
    d = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in d.select(D.iso_or_null(F.col("t"))).collect()] == [rows[0], rows[1], "2026-01-02T03:04:05+00:00", None, None, None, None]
    two = d.limit(2).agg(D.earliest(F.col("t")), D.latest(F.col("t"))).first()
    assert tuple(two) == (rows[0], rows[1])
    day = F.lit("2026-01-01").cast("date")
    assert tuple(map(str, spark.range(1).select(D.label(day, "quarter"), D.last_day(day, "quarter"), D.last_day(day, "year"), D.long_form(F.lit("2026-03-10T23:00:00-11:00"))).first())) == ("Q1 2026", "2026-03-31", "2026-12-31", "10 March 2026")


def test_constraints(spark):
    one = spark.range(1)
    assert one.select(C.claim_text(F.lit("fine words"))).first()[0] == []
    assert one.select(C.claim_text(F.lit("see a/b.py:3-4 <b>"))).first()[0] == ["markup", "citation in the text"]
    assert one.select(C.citation(F.lit("../a"), F.lit(3), F.lit(200), F.lit("0" * 64))).first()[0] == ["bad path", "too many lines"]
    claims = spark.createDataFrame([(1, "lead", 0, "c1", ["c2"]), (1, "body", 1, "c2", []), (2, "body", 0, "c1", []), (2, "lead", 1, "c1", ["c9"])], "revision int, section string, pos int, id string, supports array<string>")
    assert {tuple(r) for r in C.document(claims).collect()} == {(2, "lead is not first"), (2, "id twice: c1"), (2, "unknown support: c9")}
    f = spark.createDataFrame([("a", "active", None), ("b", "redirect", "a"), ("c", "redirect", "d"), ("d", "redirect", "c"), ("e", "redirect", "gone")], "id string, status string, target string")
    m = spark.createDataFrame([("p", "a"), ("q", "b")], "path string, feature string")
    assert {tuple(r) for r in C.manifest(f, m).collect()} == {("c", "redirect cycle"), ("d", "redirect cycle"), ("e", "redirect to nothing"), ("b", "members of an inactive feature")}


def test_stated_dates(spark):
    from veinstone.functions.dates import stated_dates

    said = {
        "on 0 March 2026 and 31 April 2026, then 29 February 2024": [("0 March 2026", "", ""), ("31 April 2026", "", ""), ("29 February 2024", "2024-02-29", "2024-02-29")],
        "2026-13 2026-00-01 2026-02-30 2026-1": [("2026-13", "", ""), ("2026-00-01", "", ""), ("2026-02-30", "", ""), ("2026", "2026-01-01", "2026-12-31")],
        "From Jan. until SEPT 2020; Sept. 5, 2021 it ended": [("Jan.", "2020-01-01", "2020-01-31"), ("SEPT 2020", "2020-09-01", "2020-09-30"), ("Sept. 5, 2021", "2021-09-05", "2021-09-05")],
        "May be, march on; 1850 or 20260 or v2026": [],
        "3rd may 1999, 2024-02-01T01:02:03.5+01:00": [("3rd may 1999", "1999-05-03", "1999-05-03"), ("2024-02-01T01:02:03.5+01:00", "2024-02-01", "2024-02-01")],
        "": [],
    }
    d = spark.createDataFrame([(t,) for t in said] + [(None,)], "t string").select("t", stated_dates(F.col("t")).alias("d"))
    got = {r["t"]: r["d"] and [tuple(x) for x in r["d"]] for r in d.collect()}
    assert got.pop(None) is None and {t: x or [] for t, x in got.items()} == said
