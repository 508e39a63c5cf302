"""The git source on a small repository, JSON lines, and streams."""

from __future__ import annotations

import os
import subprocess

import pytest
from compare import DATA
from pyspark.sql import functions as F

from veinstone.sources.git import GitSource
from veinstone.sources.jsonl import append_jsonl, read_jsonl
from veinstone.streaming import events as S


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    d = tmp_path_factory.mktemp("repo")
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "GIT_AUTHOR_NAME": "Ann Lee", "GIT_AUTHOR_EMAIL": "ann@example.com", "GIT_COMMITTER_NAME": "Ann Lee", "GIT_COMMITTER_EMAIL": "ann@example.com"}

    def run(*a, day=1):
        when = f"2026-01-{day:02d}T10:00:00+01:00"
        subprocess.run(["git", "-C", str(d), *a], check=True, capture_output=True, env=env | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when})

    run("init", "-q", "-b", "main")
    (d / "a.py").write_text("one\ntwo\nthree\n")
    (d / "b.bin").write_bytes(b"\0\1\2")
    run("add", ".")
    run("commit", "-qm", "First")
    (d / "a.py").write_text("one\nTWO\nthree\nfour\n")
    (d / "c.py").write_text("x\n")
    run("add", ".", day=2)
    run("commit", "-qm", "Second (#7)\n\nCo-authored-by: Bo <bo@example.com>", day=2)
    return str(d)


def read(spark, repo, kind, **options):
    spark.dataSource.register(GitSource)
    return spark.read.format("git").options(repo=repo, kind=kind, **options).load()


def test_git_tables(spark, repo):
    assert [r["path"] for r in read(spark, repo, "tree").orderBy("path").collect()] == ["a.py", "b.bin", "c.py"]
    blobs = {r["path"]: (r["binary"], r["lines"]) for r in read(spark, repo, "blobs").collect()}
    assert blobs == {"a.py": (False, 4), "b.bin": (True, 1), "c.py": (False, 1)}
    commits = read(spark, repo, "commits").orderBy(F.col("date").desc()).collect()
    assert [(r["subject"], r["pr"], sorted(r["files"]), r["date_text"][-6:]) for r in commits] == [("Second (#7)", 7, ["a.py", "c.py"], "+01:00"), ("First", None, ["a.py", "b.bin"], "+01:00")]
    who = read(spark, repo, "authorship").where("subject like 'Second%'").first()
    assert [tuple(f) for f in who["files"]] == [("a.py", 2, 1, None), ("c.py", 1, 0, None)] and [tuple(c) for c in who["co_authors"]] == [("Bo", "bo@example.com")]


def test_git_diff_and_blame(spark, repo):
    diff = {r["new_path"]: (r["status"], [tuple(h) for h in r["hunks"]]) for r in read(spark, repo, "diff", **{"from": "HEAD~1", "to": "HEAD"}).collect()}
    assert diff == {"a.py": ("modified", [(2, 1, 2, 1), (3, 0, 4, 1)]), "c.py": ("added", [(0, 0, 1, 1)])}
    runs = read(spark, repo, "blame").where("path = 'a.py'").orderBy("run").collect()
    assert [r["lines"] for r in runs] == [1, 1, 1, 1] and runs[1]["sha"] == runs[3]["sha"] != runs[0]["sha"]


def test_git_renames_mailmap_and_large_files(spark, tmp_path):
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "GIT_AUTHOR_NAME": "al", "GIT_AUTHOR_EMAIL": "al@old.org", "GIT_COMMITTER_NAME": "al", "GIT_COMMITTER_EMAIL": "al@old.org"}
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, env=env)
    run("init", "-q", "-b", "main")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "old.txt").write_text("".join(f"line {i} of the text\n" for i in range(40)))
    (tmp_path / "big.txt").write_text("x\n" * 4000 + "end")
    (tmp_path / ".mailmap").write_text("Al Lee <al@new.org> <al@old.org>\n")
    run("add", ".")
    run("commit", "-qm", "First")
    run("mv", "d/old.txt", "d/new.txt")
    (tmp_path / "d" / "new.txt").write_text("".join(f"line {i} of the text\n" for i in range(41)))
    run("add", ".")
    run("commit", "-qm", "Second")
    repo = str(tmp_path)
    who = {r["subject"]: r for r in read(spark, repo, "authorship").collect()}
    assert (who["Second"]["mapped_name"], who["Second"]["mapped_email"], who["Second"]["author_name"]) == ("Al Lee", "al@new.org", "al")
    assert [tuple(f) for f in who["Second"]["files"]] == [("d/new.txt", 1, 0, "d/old.txt")]
    ends = {"from": "HEAD~1", "to": "HEAD"}
    assert [tuple(r) for r in read(spark, repo, "numstat", **ends).collect()] == [("d/new.txt", 1, 0, "d/old.txt")]
    diff = read(spark, repo, "diff", **ends).first()
    assert (diff["status"], diff["old_path"], diff["new_path"], [tuple(h) for h in diff["hunks"]]) == ("renamed", "d/old.txt", "d/new.txt", [(40, 0, 41, 1)])
    big = read(spark, repo, "blob", path="big.txt", max_bytes="100").first()
    assert (big["size"], big["lines"], big["text"], bytes(big["head"][:2])) == (8003, 4001, None, b"x\n")
    assert read(spark, repo, "blob", path="none.txt").count() == 0
    assert [r["path"] for r in read(spark, repo, "tree", under="d").collect()] == ["d/new.txt"]
    assert [r["lines"] for r in read(spark, repo, "blame", under="d").orderBy("run").collect()] == [40, 1]


def test_jsonl_forgives_only_the_last_line(spark, tmp_path):
    good = str(tmp_path / "good")
    append_jsonl(spark.createDataFrame([(1, "a")], "i int, s string").coalesce(1), good)
    part = next(p for p in (tmp_path / "good").iterdir() if p.suffix == ".json")
    (tmp_path / "t.json").write_text(part.read_text() + '{"i": 2, "s": "b"}\n{"i": 3, "s"')
    assert {tuple(r) for r in read_jsonl(spark, str(tmp_path / "t.json"), "i int, s string").collect()} == {(1, "a"), (2, "b")}
    (tmp_path / "bad.json").write_text('{"i"\n{"i": 2, "s": "b"}\n')
    with pytest.raises(Exception, match="bad line"):
        read_jsonl(spark, str(tmp_path / "bad.json"), "i int, s string").collect()


@pytest.fixture
def folder(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    e.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_streams(spark, folder, tmp_path):
    def done(df, name, mode="append"):
        q = S.into_table(df, str(tmp_path / name), str(tmp_path / f"{name}-cp"), mode)
        q.awaitTermination(240)
        return spark.read.parquet(str(tmp_path / name))

    stream = S.read_events(spark, folder, 10)
    all_ = spark.read.parquet(folder)
    got = done(S.windowed_counts(stream, "1 day", "1 hour"), "w")
    whole = all_.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    assert got.count() > 0 and got.select("start", "event_type", "n").exceptAll(whole).isEmpty()
    assert done(S.once(stream), "o").count() == all_.count()


def test_stream_job_states(spark, folder):
    from veinstone.operators.stateful import job_states

    q = S.job_states(S.read_events(spark, folder, 10)).writeStream.format("memory").queryName("jobs").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {r["user_id"]: (r["state"] or None, r["attempts"], r["applied"], r["ignored"]) for r in spark.sql("select * from jobs").collect()}
    want = {r["user_id"]: (r["state"], r["attempts"], r["applied"], r["ignored"]) for r in job_states(spark.read.parquet(folder)).collect()}
    assert got == want


def test_git_names_and_messages_with_odd_characters(spark, tmp_path):
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "GIT_AUTHOR_NAME": "al", "GIT_AUTHOR_EMAIL": "al@old.org", "GIT_COMMITTER_NAME": "al", "GIT_COMMITTER_EMAIL": "al@old.org"}
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, env=env)
    run("init", "-q", "-b", "main")
    names = ["a => b.txt", 'a"b.txt', "t\tab.txt", "é ü.txt", "{x => y}/z.txt", "0" * 40, "back\\slash", "two b/words"]
    (tmp_path / "{x => y}").mkdir()
    (tmp_path / "two b").mkdir()
    for n in [*names, "m"]:
        (tmp_path / n).write_text("".join(f"{n} {i}\n" for i in range(9)))
    run("add", ".")
    run("commit", "-qm", "First\x01here", "-m", "1\t2\tno file\n\x02")
    run("commit", "-q", "--allow-empty", "-m", "Empty")
    for n in names:
        (tmp_path / n).write_text("".join(f"{n} {i}\n" for i in range(9)) + "more\n")
    run("mv", "m", 'n"q\tt')
    run("add", ".")
    run("commit", "-qm", "Third")
    repo, ends = str(tmp_path), {"from": "HEAD~2", "to": "HEAD"}
    commits = {r["subject"]: sorted(r["files"]) for r in read(spark, repo, "commits").collect()}
    assert commits == {"First\x01here": sorted([*names, "m"]), "Empty": [], "Third": sorted([*names, "m", 'n"q\tt'])}
    who = {r["subject"]: sorted(map(tuple, r["files"]), key=str) for r in read(spark, repo, "authorship").collect()}
    third = sorted([*((n, 1, 0, None) for n in names), ('n"q\tt', 0, 0, "m")], key=str)
    assert who["Third"] == third and who["Empty"] == [] and len(who["First\x01here"]) == 9
    assert sorted((tuple(r) for r in read(spark, repo, "numstat", **ends).collect()), key=str) == third
    diff = {r["new_path"]: (r["status"], r["old_path"], [tuple(h) for h in r["hunks"]]) for r in read(spark, repo, "diff", **ends).collect()}
    assert diff == {n: ("modified", n, [(9, 0, 10, 1)]) for n in names} | {'n"q\tt': ("renamed", "m", [])}
