"""The ten operators and the pipeline against plain versions, on the small tables and on odd rows."""

from __future__ import annotations

import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from veinstone.llm import backoff, cuckoo, langid, mixing, partenum, pii, quality, samples, templates, tokens, urls
from veinstone.llm import queries as Q

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "one two three four"), (6, "ONE two\tthree four"), (7, "a b c d e f"), (8, "a b c d e f"), (9, "a  b c d e f "),
    (10, "x" * 70_000), (11, "long words here " * 6000), (12, "é ü 日本 \U0001f600 ok"), (13, "\u00a0nbsp stays\u00a0in words"), (14, "a b c d e"), (15, "a b c d e f g h i j k l m"), (16, "a b c d e f g h i j k l n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    # more columns, some with the names that operators use
    return d.withColumns({c: F.lit(1) for c in ("size", "n", "cls", "digest", "sig", "lang_pred", "score", "copies")}).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 2)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(docs, odd, none, order):
    for df in (docs, odd):
        want = brute.backoff(pairs(df), order)
        got = {r["doc_id"]: r for r in backoff.backoff_scores(df, order, block_bytes=50_000, shard_words=20_000).collect()}
        assert set(got) == set(want)
        for i, (n, s, down) in want.items():
            assert got[i]["n_words"] == n and math.isclose(got[i]["log_score"], s, rel_tol=1e-9, abs_tol=1e-6)
            assert got[i]["n_backed_off"] == down
            assert (got[i]["mean_log_score"] is None) == (n == 0)
    assert backoff.backoff_scores(none).count() == 0


def test_packed_keys_and_counts_come_back():
    import numpy as np

    rng = np.random.default_rng(8)
    for shard, n in ((0, 1), (0, 1000), (3, 1), (3, 9), (3, 50_000)):
        keys = np.unique(rng.integers(0, 2**54, n).astype(np.uint64) + np.uint64(shard << 54)) << np.uint64(8)
        assert np.array_equal(backoff._unpack(backoff._pack(keys, shard << 54), shard << 54), keys)
    for x in (np.zeros(5, np.int64), np.array([1]), rng.integers(0, 3, 1001), rng.integers(0, 2**40, 77)):
        for usual in (0, 1):
            assert np.array_equal(backoff._unpack_small(backoff._pack_small(x, usual), usual), x)


def test_backoff_of_repeated_rows_and_rows_without_doc_id(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b d"), (None, "a b d"), (2, "b c")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.backoff(list(enumerate(t for _, t in rows)), 3)
    got = sorted((r["doc_id"] or 0, r["n_words"], round(r["log_score"], 9)) for r in backoff.backoff_scores(d.withColumns({"block": F.lit(1), "shard": F.lit(2)}), 3).collect())
    assert got == sorted((i or 0, want[k][0], round(want[k][1], 9)) for k, (i, _) in enumerate(rows))


def test_registered_backoff_uses_trigrams(spark, docs):
    want = brute.backoff(pairs(docs), 3)
    got = {r["doc_id"]: r for r in Q.op1_backoff_scores(spark, DATA).collect()}
    assert set(got) == set(want)
    for i, (n, s, down) in want.items():
        assert (got[i]["n_words"], got[i]["n_backed_off"]) == (n, down) and math.isclose(got[i]["log_score"], s, rel_tol=1e-9, abs_tol=1e-6)


def test_mixing(docs, odd, none):
    for df in (docs, odd):
        got = mixing.mixed(df).select("doc_id", "source", "size", "source_size", "target", "copies", "text").collect()
        sizes, by = {}, {}
        for r in got:
            assert r["size"] == len(brute.words(r["text"]))
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
            by[r["source"]] = r
            assert 0 <= r["copies"] <= 2
        for s, t in brute.targets(sizes).items():
            assert by[s]["source_size"] == sizes[s] and math.isclose(by[s]["target"], t, rel_tol=1e-9, abs_tol=1e-6)
        again = {r["doc_id"]: r["copies"] for r in mixing.mixed(df.repartition(3)).collect()}
        assert again == {r["doc_id"]: r["copies"] for r in got}
    assert mixing.mixed(none).count() == 0


def test_mixed_words_come_near_targets(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 40 as int))").alias("text"), F.expr("case when id % 3 = 0 then 'a' else concat('b', id % 5) end").alias("source"))
    rows = mixing.mixed(d).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.06 for r in rows)


def test_taken_words_come_near_targets_of_small_heavy_tailed_sources(spark):
    rows = Q.op2_mixing(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    rows = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(rows) == 20 and all(abs(r["taken"] / r["target"] - 1) < 0.03 for r in rows)


def test_mixing_draws_for_rows_without_doc_id(spark):
    d = spark.createDataFrame([(None, f"w{i} " * 10, "a") for i in range(400)] + [(i, "x " * 10, "b") for i in range(100)] + [(7, None, None)], "doc_id long, text string, source string")
    d = d.withColumns({c: F.lit("z") for c in ("below", "source_of", "rate", "draw")})
    got = mixing.mixed(d).where("source = 'a'").select("copies").collect()
    assert len(got) == 400 and len({r["copies"] for r in got}) == 2
    assert mixing.mixed(d).count() == 501


def test_samples_are_bounded_and_never_empty(spark):
    d = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 29_990, "a").otherwise("b").alias("lang"))
    got = samples.sampled(d, 40, ["doc_id", "text"], F.col("lang")).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("k")).collect()
    assert {(r["lang"], r["n"], r["k"]) for r in got} >= {("a", 40, 40)} and all(r["n"] == r["k"] > 0 for r in got)
    one = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit("t").alias("text"))
    assert samples.sampled(one, 3, ["doc_id", "text"]).count() == 1
    assert samples.sampled(one.limit(0), 3, ["doc_id"]).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")
    assert samples.sampled(nulls, 5, ["doc_id", "text"]).count() == 2


def mined(rows, min_count, min_confidence, min_lift):
    """Token sets to confidence, by trying all sets of up to all tokens; rows of (tokens, bad)."""
    from itertools import combinations

    on = {}
    for k, (tokens, _) in enumerate(rows):
        for t in tokens:
            on.setdefault(t, set()).add(k)
    first = {}
    for t in sorted(on):
        first.setdefault(frozenset(on[t]), t)
    bad = {k for k, (_, b) in enumerate(rows) if b}
    rules = {}
    for n in range(1, len(first) + 1):
        for some in combinations(sorted(first.values()), n):
            held = set.intersection(*(on[t] for t in some))
            if len(held & bad) >= min_count and len(held & bad) >= min_confidence * len(held) and len(held & bad) / len(held) >= min_lift * len(bad) / len(rows):
                rules[some] = len(held & bad) / len(held)
    return {s: c for s, c in rules.items() if not any(rules.get(s[:i] + s[i + 1 :], -1) >= c for i in range(len(s)))}


def test_rules_like_a_plain_miner(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        tokens = [t for t in "abcdefgh" if rng.random() < 0.45]
        tokens += ["x", "y", "z"] if "a" in tokens else []
        rows.append((tokens, rng.random() < (0.8 if {"a", "c"} <= set(tokens) else 0.6 if {"b", "d", "e"} <= set(tokens) else 0.2)))
    d = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(rows)], "row long, tokens array<string>, bad boolean")
    got = {tuple(r["tokens"]): r["confidence"] for r in urls.mine_rules(d, 8, 0.4, 1.3).collect()}
    want = mined(rows, 8, 0.4, 1.3)
    assert len(want) > 5 and set(got) == set(want) and all(math.isclose(got[k], want[k]) for k in want)


def test_url_rules_judge_rows_not_ids(spark):
    rows = [(i, f"http://{'spam' if i % 2 else 'good'}.xx/{'win' if i % 2 else 'news'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows + [(1, "http://good.xx/news/x"), (None, "http://spam.xx/win/9"), (None, None), (900, "http://spam.xx/" + "w/" * 200_000)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(100)] + [(1, True), (None, True)], "page_id long, bad boolean")
    got = {(r["page_id"], r["path"][:8]): r["verdict"] for r in urls.judged(pages.withColumn("rule", F.lit(1)).withColumn("tokens", F.lit(2)), labels, policy=()).collect()}
    assert got[1, "/news/x"] == "allow" and got[1, "/win/1"] == "block" and got[None, "/win/9"] == "block" and got[None, ""] == "allow"
    assert got[900, "/w/w/w/w"] == "block"


def test_long_fixed_paths_are_mined_quickly(spark):
    words = "/".join("abcdefghijklmnopqrst")
    pages = spark.createDataFrame([(i, f"http://site{i % 3}.net/{words}/{i}") for i in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 3 == 1) for i in range(150)], "page_id long, bad boolean")
    out = urls.judged(pages, labels, policy=()).groupBy("host").agg(F.min("verdict"), F.max("verdict")).collect()
    assert {tuple(r) for r in out} == {("site0.net", "allow", "allow"), ("site1.net", "block", "block"), ("site2.net", "allow", "allow")}


def test_url_rules(spark):
    odd = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.COM/en/7x?q#f"), (4, "x://net/de/"), (5, "x://example.net/de/88"), (6, "a://org://es/"), (7, "x://b.org/es/?"), (8, "x://notcom/en/"), (9, "x://com/en"), (10, "://com/en/1")]
    rows = odd + [(r["page_id"] + 100, r["url"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i + 100, i % 2 == 0) for i in range(50)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in urls.judged(pages, labels).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        host, path, rule, verdict = brute.judged(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["mined_confidence"] is not None else "allow"))
    nothing = spark.createDataFrame([], "page_id long, bad boolean")
    assert urls.judged(pages, nothing).where("mined_confidence is not null").count() == 0
    assert urls.judged(pages.limit(0), nothing).count() == 0


def test_mined_rules_find_the_combination(spark):
    # spam.net is bad only under /win/
    rows = [(i, f"http://{'spam' if i % 2 else 'good'}.net/{'win' if i % 4 < 2 else 'news'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 1) for i in range(200)], "page_id long, bad boolean")
    got = {r["page_id"] for r in urls.judged(pages, labels, policy=()).where("verdict = 'block'").collect()}
    assert got == {i for i in range(400) if i % 4 == 1}


def test_language(spark, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(d, steps=150)
    out = langid.predicted(d, net).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97 and out["score"].between(0, 1).all()
    odd = spark.createDataFrame([*ODD, (17, "123 !?")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predicted(odd, net).collect()}
    assert len(got) == len(ODD) + 1 and {i for i, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 3, 17}
    assert langid.fit(none) is None and langid.predicted(odd, None).where("lang_pred <> 'und'").count() == 0 and langid.predicted(none, net).count() == 0


def test_network_gradients():
    import numpy as np

    net = langid.ByteGru(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    data, y = rng.integers(97, 100, (6, 4)).astype(np.uint8), rng.integers(0, 3, 4)
    _, g = net.gradients(data, y)
    for k in net.p:
        at = (98, 4) if k[0] == "x" else tuple(0 for _ in net.p[k].shape)
        old, step = net.p[k][at], 1e-2
        net.p[k][at] = old + step
        up = net.gradients(data, y)[0]
        net.p[k][at] = old - step
        low = net.gradients(data, y)[0]
        net.p[k][at] = old
        assert abs((up - low) / (2 * step) - g[k][at]) < 1e-4 + 1e-2 * abs(g[k][at])


def test_long_text_is_read_to_its_end():
    import numpy as np

    net = langid.ByteGru(["a", "b"])
    net.train([b"aaaa " * 20, b"zzzz " * 20], np.array([0, 1]), steps=120)
    prob = net.documents([b"aaaa " * 3000 + b"zzzz " * 9000, b"zzzz"])
    assert 0.15 < prob[0, 0] < 0.35 and prob[1, 1] > 0.5


def test_quality(spark, odd, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scorer = quality.fit(d, lab)
    out = quality.scored(d, scorer).join(lab, "doc_id").where("held_out").toPandas()
    good, bad = out[out["quality"] == 1]["score"], out[out["quality"] == 0]["score"]
    assert sum((good > b).mean() for b in bad) / len(bad) > 0.95
    assert (out["predicted"] == (out["score"] >= 0.3)).all() and (good >= 0.3).mean() > 0.95
    assert quality.scored(odd, scorer).where("score between 0 and 1").count() == len(ODD)
    assert quality.fit(none, lab) is None and quality.fit(d, lab.limit(0)) is None
    kept = quality.kept(odd, scorer)
    assert kept.columns == odd.columns and kept.count() == quality.scored(odd, scorer).where("predicted = 1").count()


def test_class_prior_is_the_share_of_positives():
    import numpy as np

    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.9):
        good, bad = rng.beta(5, 2, 4000), rng.beta(2, 6, 4000)
        k = int(4000 * share)
        assert abs(quality.class_prior(rng.beta(5, 2, 4000), np.concatenate([good[:k], bad[k:]])) - share) < 0.08


def test_quality_of_repeated_and_odd_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    # labels without documents, one document many times over, rows without doc_id
    lab = lab.union(spark.range(10**6, 10**6 + 5000).select("id", F.lit(1)))
    more = d.union(d.where("doc_id = 3").crossJoin(spark.range(500)).select("doc_id", "text")).union(spark.createDataFrame([(None, "x"), (None, None)], "doc_id long, text string"))
    scorer = quality.fit(more, lab, max_rows=100)
    out = quality.scored(more, scorer)
    assert scorer is not None and out.count() == 1502 and out.where("score between 0 and 1").count() == 1502 and out.where("doc_id is null and not held_out").count() == 2


def test_language_of_repeated_rows_and_rare_languages(spark):
    d = spark.createDataFrame([(1, "aaa aaa", "xx")] * 300 + [(i, "bcd bcd", "yy") for i in range(2, 60)] + [(None, "zzz", "zz")], "doc_id long, text string, lang string")
    net = langid.fit(d, max_docs=10, steps=30)
    assert net.labels == ["xx", "yy"]
    out = langid.predicted(d, net)
    assert out.count() == 359 and out.where("doc_id is null and not held_out").count() == 1


def test_exact_dedup(docs, odd, none):
    for df in (docs, odd, docs.union(docs.limit(0))):
        got = {r["doc_id"]: tuple(r)[1:] for r in cuckoo.exact_groups(df, per_shard=50).collect()}
        assert got == brute.exact(pairs(df))
    assert cuckoo.exact_groups(none).count() == 0


def test_exact_dedup_counts_repeated_rows(spark):
    d = spark.createDataFrame([(5, "x y"), (5, "x y"), (None, "x  y"), (7, "z")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in cuckoo.exact_groups(d).collect()), key=str)
    assert got == sorted([(5, 5, 3, True), (5, 5, 3, True), (None, 5, 3, False), (7, 7, 1, True)], key=str)


def test_cuckoo_filter():
    import hashlib

    digests = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(4000)]
    f = cuckoo.CuckooFilter.sized(3000)
    p, b = cuckoo._prints(digests[:3000])
    assert f.insert(p, b) and f.contains(p, b).all()
    q = cuckoo._prints(digests[3000:])
    assert f.contains(*q).mean() < 0.01
    f.delete(p[:1500], b[:1500])
    assert f.contains(p[1500:], b[1500:]).all() and f.contains(p[:1500], b[:1500]).mean() < 0.01
    small = cuckoo.CuckooFilter(4)
    assert not small.insert(p, b) and cuckoo._rebuilt(digests).contains(*cuckoo._prints(digests)).all()


def test_cuckoo_index_inserts_deletes_and_resizes(spark):
    d = spark.range(3000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
    index = cuckoo.CuckooIndex.empty(spark, 4).insert(d.where("id < 300"))
    small = {r["shard"]: r["log2_buckets"] for r in index.filters.collect()}
    index = index.insert(d.where("id < 2500")).delete(d.where("id < 100"))
    assert all(r["log2_buckets"] > small[r["shard"]] and r["resizes"] > 0 for r in index.filters.collect())
    assert index.live(d).count() == 2500  # the first 100 have a copy left
    index = index.delete(d.where("id < 100 or id >= 2000"))
    assert {r["id"] for r in index.live(d).collect()} == set(range(100, 2000))
    missed = index.probe(d.where("id >= 2500")).where("maybe").count()
    assert missed < 25


@pytest.mark.parametrize("crowd", [16, 2])
def test_near_duplicates(docs, odd, none, crowd, monkeypatch):
    monkeypatch.setattr(partenum, "CROWD", crowd)
    for df in (docs, odd):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.near_duplicates(df).collect()}
        assert got == brute.near(pairs(df))
    assert partenum.near_duplicates(none).count() == 0


def test_near_duplicates_in_crowds(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, passage = [word() for _ in range(80)], [word() for _ in range(60)]
    rows = []
    for i in range(120):  # near copies, some linked only through others
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(80)] = word()
        rows.append((i, " ".join(t)))
    for i in range(120, 220):  # one passage in texts of their own
        rows.append((i, " ".join([word() for _ in range(rng.randrange(60))] + passage)))
    monkeypatch.setattr(partenum, "CROWD", 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)


def test_signatures_meet_at_the_limit():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (4, 5, 8, 13, 20, 40, 90, 250, 1200):
        for _ in range(40):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            while True:
                d, e = rng.integers(0, n // 5 + 2), rng.integers(0, n // 4 + 2)
                if 100 * (n - d) >= 80 * (n + e):
                    break
            y = np.concatenate([x[d:], rng.integers(0, 2**63, e).astype(np.uint64)])
            s, o, _ = partenum.signatures(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), np.array([len(x), len(y)]))
            assert set(s[o == 0]) & set(s[o == 1])


PRIVATE = ["a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8 999.1.1.1 007.1.1.1", "+1 (974) 555-3436 +123456789", "4111 1111 1111 1111 41111111111111112", "é\U0001f600a@b.co x", "1" * 300, "..%+-a@-.-", "+1-2-3-4-5-6-7-8-9 ) +", "a@b@c.d", None, "", "x" * 30_000 + "@a.b", "1-" * 9000 + "1", "a.b@" + "c." * 3000 + "d"]


def test_personal_data(spark, docs):
    odd = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    for df, model in ((odd, pii.SpanModel()), (docs, pii.fit(docs, trees=3))):
        for (i, t), r in zip(sorted(pairs(df)), sorted(pii.personal_spans(df, model).collect(), key=lambda r: r["doc_id"])):
            want = brute.personal(t)
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(want[k]) for k in want], t
            listed = [f"{k}:{a}:{b}" for k in want for a, b in want[k]]
            import hashlib

            assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
            assert set(listed) <= set(filter(None, r["spans"].split(",")))


def test_model_adds_spans_and_redacts(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        digits = "".join(rng.choice("0123456789") for _ in range(7))
        rows.append((i, f"call {'+1 ' if i % 10 else ''}(555) {digits[:3]}-{digits[3:]} now, in {rng.randrange(10**5, 10**6)} days" if i % 2 else f"in {rng.randrange(1000, 99999)} days"))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(d)
    out = pii.personal_spans(d, model)
    assert model.model is not None and out.count() == 600
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("stop"), F.lit("ip").alias("kind")))
    assert spark.range(1).select(pii.redacted(F.lit("é\U0001f600abc"), spans)).first()[0] == "é\U0001f600[ip]c"


def test_personal_data_of_odd_tables(spark, none):
    assert pii.fit(none).model is None and pii.personal_spans(none, pii.SpanModel()).count() == 0
    d = spark.createDataFrame([(None, "a@b.co"), (1, "a@b.co"), (1, "a@b.co")], "doc_id long, text string")
    d = d.withColumns({c: F.lit(1) for c in ("raw", "met", "all_base", "proposed", "base_email", "added", "n_spans")})
    assert pii.fit(d).model is None
    got = pii.personal_spans(d, pii.SpanModel()).collect()
    assert [(r["n_email"], r["spans"], r["n_spans"]) for r in got] == [(1, "email:0:6", 1)] * 3


def test_personal_data_of_a_text_of_megabytes(spark):
    n = 60_000
    d = spark.createDataFrame([(1, " ".join(f"u{i}@ex.com (555) {i:07d} +1 555 {i:07d} " + "word " * 8 for i in range(n)))], "doc_id long, text string")
    r = pii.personal_spans(d, pii.SpanModel()).first()
    assert (r["n_email"], r["n_phone"], r["n_added"]) == (n, n, 0) and r["spans"].startswith("email:0:9,email:")


def test_candidates_that_meet_base_matches(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["1.2.3.4", "+1 555 123 4567", " 555-1234 ", " a@b.co ", " x (at) y (dot) z ", " 4111 1111 1111 1111 ", ". "]) for _ in range(rng.choice([3, 30, 700])))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.spans_table(d).collect():
        base = [(b["start"], b["stop"]) for k in pii.KINDS for b in r[f"base_{k}"]]
        for c in r["proposed"]:
            assert c["met"] == any(a < c["stop"] and c["start"] < b for a, b in base)
        assert all(x["stop"] <= y["start"] for x, y in zip(r["proposed"], r["proposed"][1:]))


def test_model_finds_planted_obfuscated_spans(spark):
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, planted = [], {}
    for i in range(1200):
        noise = f" Order {digits(5)} of 20{digits(2)}-0{digits(1)}-1{digits(1)} came, we met at {name()}.com."
        rows.append((i, f"Write a mail to {name()}@{name()}.com soon." + noise if i % 2 else f"Please call +1 ({digits(3)}) {digits(3)}-{digits(4)} now." + noise))
    for i in range(1200, 1240):
        kind, head, span = ("email", "Write a mail to ", f"{name()} (at) {name()} (dot) com") if i % 2 else ("phone", "Please call ", f"({digits(3)}) {digits(3)}-{digits(4)}")
        if i % 4 == 1:  # spelled as no altered copy is
            span = span.replace("(at)", rng.choice(["AT", "[ AT ]".replace(" ", ""), "<at>"])).replace("(dot)", rng.choice(["DOT", "[Dot]", "<dot>"]))
        if i % 4 == 2:
            span = span.replace("(", "").replace(") ", "/")
        planted[i] = f"{kind}:{len(head)}:{len(head + span)}"
        rows.append((i, f"{head}{span} now, in {digits(5)} days"))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.personal_spans(d, pii.fit(d)).collect()}
    assert {i: out[i]["spans"] for i in planted} == planted
    assert all(out[i]["n_added"] == (i in planted) for i in out)


def test_templates(spark):
    bench = spark.createDataFrame([(1, "Yesterday Alice bought 12 apples and 30 pears at the market near the old river for 5 dollars"), (2, "short one here"), (3, None), (4, "")], "item_id long, text string")
    rows = [
        (1, "Intro text. yesterday Bob bought 17 apples and 44 pears at the market near the old river for 9 euros. More."),
        (2, "Yesterday Alice bought 12 apples and 30 pears at the market near the old river for 5 dollars"),
        (3, "Nothing of the kind is here at all, only 12 apples and 30 pears"),
        (4, None), (5, ""), (6, "a short one here indeed"),
        (7, "yesterday | Alice | bought | 12 apples### and 30 pears!! at the market near the old river for 5 dollars"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["reworded"] for r in templates.contaminated(d, bench).collect()}
    assert got == {(1, 1): True, (2, 1): False, (7, 1): False}
    assert templates.contaminated(d.limit(0), bench).count() == 0 and templates.contaminated(d, bench.limit(0)).count() == 0


def test_slots_must_stay_consistent(spark):
    bench = spark.createDataFrame([(1, "the train with 40 seats carries 40 people from the north to the far south every day of spring")], "item_id long, text string")
    t = "the train with {} seats carries {} people from the north to the far south every day of spring"
    d = spark.createDataFrame([(1, t.format(50, 50)), (2, t.format(50, 60)), (3, t.format(40, 40))], "doc_id long, text string")
    assert {(r["doc_id"], r["reworded"]) for r in templates.contaminated(d, bench).collect()} == {(1, True), (3, False)}


def test_leaks_with_more_or_fewer_words(spark):
    long = "the old miller of our valley keeps three grey horses and walks them each morning over the narrow bridge to drink from cold clear water"
    half = " ".join(f"plain{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100))
    short = "every cook in this kitchen must learn how to bake bread from coarse flour"
    slots = "when Anna walks to the market she always buys 5 loaves of fresh bread"
    few = "Anna 5 and Maria 6 or Paul 7 yet John 8"
    bench = spark.createDataFrame([(1, long), (2, half), (3, short), (4, slots), (5, few), (6, "ten 12")], "item_id long, text string")
    put = lambda text, k: " ".join([*text.split()[:k], "really", *text.split()[k:]])
    words = half.split()
    rows = [(100 + k, put(long, k)) for k in range(8, 18)] + [(300 + k, put(short, k)) for k in range(3, 12)]
    rows += [(200, "before it " + " ".join(words[30:52]) + " behind it"), (201, " ".join(words[30:40]) + " behind it")]
    rows += [(400, slots.replace("Anna", "Anna Maria").replace("5", "1 000")), (500, "so: " + few + " indeed"), (501, few.replace("8", "9")), (600, "Ten 12."), (601, "ten 12 more")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["reworded"] for r in templates.contaminated(d, bench).collect()}
    want = {(i, i // 100): i == 400 for i, _ in rows if i not in (201, 501, 601)}
    assert got == want


def test_reworded_items_are_found(spark):
    """Items with other numbers (in digits or words), names and a few words put in, among texts that hold none."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    number = lambda: rng.choice([str(rng.randrange(2, 5000)), "twelve", "thirty", "five", "twenty five", "3.50"])
    person = lambda: rng.choice(["Alice", "Bob Marley", "Maria", "Paul"])
    items, docs, want = [], [], set()
    for i in range(60):
        shape = [rng.choice(["#", "@", *["w"] * 7]) for _ in range(rng.randrange(16, 50))]
        plain = [word() if x == "w" else number() if x == "#" else person() for x in shape]
        items.append((i, " ".join(plain)))
        for j in range(3):
            new = {}  # a value stands for the same one throughout
            t = [v if x == "w" else new.setdefault(v, number() if x == "#" else person()) for x, v in zip(shape, plain)]
            for _ in range(j):
                t.insert(rng.randrange(len(t)), word())
            docs.append((100 * i + j, " ".join([word() for _ in range(40)] + t + [word() for _ in range(40)])))
            want.add((100 * i + j, i))
    docs += [(10**6 + k, " ".join(rng.choice([word(), number(), person()]) for _ in range(120))) for k in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in templates.contaminated(d, b).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_a_slot_beside_the_item_does_not_hide_it(spark):
    item = "5 apples lie in the old basket by the door and another 5 hang on the tree"
    d = spark.createDataFrame([(1, "In the year 1999 " + item), (2, "so: " + item)], "doc_id long, text string")
    got = templates.contaminated(d, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 1), (2, 1)}


def test_leaks_like_a_plain_search(spark):
    d, b = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    flat = lambda t: " ".join(brute.words(t))
    items = {r["item_id"]: flat(r["text"]) for r in b.collect()}
    want = {(r["doc_id"], i) for r in d.collect() for i, x in items.items() if x in flat(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in templates.contaminated(d, b).collect()}
    assert want and want <= got and len(got) <= len(want) * 1.2 + 2


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer

    path = Q.token_file()
    lib = Tokenizer.from_file(path)
    extra = [(i, t) for i, t in enumerate(["", None, "<|endoftext|>", "a<|endoftext|> b", "a" * 5000, "ab" * 3000 + " " * 400, "\n\n \t x", "é" * 99, "I'll don't", "日本語 テスト", "\x00\x01"])]
    for df in (docs, spark.createDataFrame(extra, "doc_id long, text string")):
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(df, path).collect()}
        want = {}
        for i, t in pairs(df):
            n = len(lib.encode(t or "", add_special_tokens=False).ids)
            want[i] = (len((t or "").encode()), n, n > 512)
        assert got == want
    assert tokens.token_counts(none, path).count() == 0


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    import json

    spec = json.load(open(Q.token_file(), encoding="utf-8"))
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        tokens.Merges(str(path))


def test_forgotten_counts_are_counted_again(docs, monkeypatch):
    texts = [t or "" for _, t in pairs(docs)]
    want = tokens.count_tokens(texts, Q.token_file())
    tokens._worker(Q.token_file())[1].clear()
    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    assert tokens.count_tokens(texts, Q.token_file()) == want


def test_hashing_of_long_texts():
    import numpy as np

    from veinstone.llm import hashing

    text = ("Some WORDS and more\tof them " * 200_000).encode()
    whole = hashing._piece_hashes(text)
    assert np.array_equal(hashing.word_hashes(text), whole) and len(set(whole.tolist())) == 6
    w, n = hashing.batch_words([b"", b"a b", b"  ", b"A  b ", b"c"])
    assert n.tolist() == [0, 2, 0, 2, 1] and w[0] == w[2] and w[1] == w[3]


def test_sql_counterparts(spark):
    import sys

    sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[1]))
    from compare import assert_same

    for name, sql in Q.ORACLES.items():
        assert_same(spark, name, Q.QUERIES[name], sql)


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        after = P.written(stage(spark, docs, DATA))
        assert after.columns == docs.columns, name
        gone = {r[0] for r in docs.select("doc_id").subtract(after.select("doc_id")).collect()}
        if name == "exact_dedup":
            assert gone == {i for i, r in brute.exact(pairs(docs)).items() if not r[2]}
        if name == "near_dedup":
            assert gone == {i for i, r in brute.near(pairs(docs)).items() if r[1] != i}
        docs = after
    out = P.run(spark, DATA)
    assert "copy_no" in out.columns and {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as P

    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, "a  b c d e f"), (1, "a b c d e f"), (1, "other text"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "z z"), (None, "z  z"), (3, None), (4, ""), (5, text), (6, text + " fifteen"), (7, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.lit(1), "gone": F.lit(2), "digest": F.lit(3), "stays": F.lit(4)})
    one = P.drop_copies(spark, d, DATA)
    assert one.columns == d.columns
    got = sorted(((r["doc_id"], " ".join((r["text"] or "").split())) for r in one.collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (1, "other text"), (None, "z z"), (3, ""), (5, text), (6, text + " fifteen"), (7, "x")], key=str)
    two = P.drop_near_copies(spark, one, DATA)
    assert two.columns == d.columns and {r["doc_id"] for r in two.collect()} == {1, None, 3, 5, 7}
    assert P.drop_leaks(spark, two, DATA).count() == two.count()
    # under one doc_id, and without any, each text is judged for itself
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    rows = [(1, text), (2, text + " fifteen"), (2, "quite another text"), (2, "quite another text"), (None, text + " sixteen"), (None, "a text of its own"), (3, item + " " + item), (3, "no item here")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.lit(1)})
    near = P.drop_near_copies(spark, d, DATA)
    assert sorted((tuple(r)[:2] for r in near.collect()), key=str) == sorted([rows[0], rows[2], rows[5], rows[6], rows[7]], key=str)
    assert sorted((tuple(r)[:2] for r in P.drop_leaks(spark, near, DATA).collect()), key=str) == sorted([rows[0], rows[2], rows[5], rows[7]], key=str)
    none = d.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, none, DATA).count() == 0, name


def test_personal_data_is_learned_from_every_document(spark, monkeypatch):
    class Told(Exception):
        pass

    def stop(df):
        raise Told(df.where("label = 1").count(), df.where("label = 0").count())

    monkeypatch.setattr(pii, "written", stop)
    d = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("call +49 30 1234567 or 99 12 "), F.col("id").cast("string")).alias("text"))
    with pytest.raises(Told) as one:
        pii.fit(d)
    with pytest.raises(Told) as two:
        pii.fit(d.union(d.limit(500)))
    assert one.value.args == two.value.args and one.value.args[0] > 20_000
