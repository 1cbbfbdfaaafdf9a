"""Fingerprints against the rule for closed syncmers, word by word."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from plumbline.llm import syncmers

from .test_simple import docs_of


def test_anchors_are_the_closed_syncmers(spark):
    words = [f"w{random.Random(i).randrange(30)}" for i in range(40)]
    df = docs_of(spark, [" ".join(words), "a b", "", None, " One\n", "x y z", " \t "]).selectExpr("doc_id", "coalesce(text, '') text")
    rows = {r.doc_id: r.anchors for r in df.select("doc_id", syncmers.anchors(F.col("text")).alias("anchors")).collect()}
    h = [r.h for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").selectExpr("i", "xxhash64(w) h").orderBy("i").collect()]
    want = [i < 38 and min(h[i : i + 3]) in (h[i], h[i + 2]) for i in range(40)]
    assert [x is not None for x in rows[0]] == want and 0.5 < sum(want) / 38 < 0.9
    assert [any(x is not None for x in rows[i]) for i in range(1, 7)] == [True, False, False, True, True, False]


def test_short_and_unspaced_texts_have_fingerprints_of_their_own(spark):
    texts = ["delta zeta omega", "red green blue", "sun moon star", "x", "é", "深層学習は機械学習の一分野である。多層のネットワークを使う。" * 3, "0123456789abcdef" * 30, "", " \n"]
    rows = syncmers.fingerprints(docs_of(spark, texts))
    assert rows.where("fingerprint = '' and n_chars > 0").count() == 1 and rows.where("near_next = 1 and doc_id < 6").count() == 0
    got = {r.doc_id: r for r in rows.collect()}
    assert len({got[i].fingerprint for i in range(7)}) == 7 and got[5].near_edited > 0.2 and got[6].near_edited > 0.2 and got[7].near_next == 1
    assert all(len(r.positions) * 16 == len(r.fingerprint) and r.positions == sorted(r.positions) for r in got.values())


def test_anchors_tell_where_a_text_stands_in_another(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(5000)}" for _ in range(400)]
    df = spark.createDataFrame([(" ".join(words[100:]), " ".join(words)), ("a b c", "d e f")], "a string, b string")
    assert [x[0] for x in df.select(syncmers.shift(syncmers.sketch(F.col("a")), syncmers.sketch(F.col("b")))).collect()] == [100, None]


def test_filters_on_the_result_cost_no_more_than_the_result(spark):
    rows = syncmers.fingerprints(docs_of(spark, [" ".join(f"w{i * j % 977}" for j in range(3000)) for i in range(1, 21)]))
    began = time.time()
    assert rows.where("near_edited > 0.1 and fingerprint <> '' and n_chars > 0").count() == 20
    assert time.time() - began < 30


def test_fingerprints_follow_the_next_document_and_the_edit(spark):
    r = random.Random(5)
    texts = [" ".join(f"é{r.randrange(4000)}" for _ in range(r.choice([0, 1, 50, 400]))) for _ in range(90)] + [None, "same text here", "same text here"]
    ids = r.sample(range(10**6), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    for per_bucket, level in ((7, 1_000), (3, 4), (5_000, 1_000)):
        rows = {x.doc_id: x for x in syncmers.fingerprints(df, per_bucket=per_bucket, level=level).collect()}
        assert len(rows) == len(ids)
        for at, i in enumerate(order):
            text, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
            half = len(text) // 2
            row = rows[ids[i]]
            assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
            assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
            if len(text.split()) >= 50 and len(following) > half:
                assert row.near_next < 0.2 < row.near_edited < 0.6
    assert rows[ids[-1]].fingerprint == rows[ids[-2]].fingerprint and rows[ids[90]].fingerprint == ""
    one = syncmers.fingerprints(docs_of(spark, ["only one here"])).collect()[0]
    assert one.near_next == 1 and syncmers.fingerprints(docs_of(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (2, "b c d"), (2, "b c d"), (None, "c")], "doc_id long, text string")
    got = syncmers.fingerprints(odd, per_bucket=1).collect()
    assert len(got) == 4 and sorted(x.near_next for x in got) == [0, 0, 1, 1]
    nulls = spark.createDataFrame([(None, f"t{i} of many words") for i in range(400)], "doc_id long, text string")
    dealt = syncmers.in_order(nulls, per_bucket=10).groupBy("first", "bucket").count().collect()
    assert sum(x["count"] for x in dealt) == 400 and max(x["count"] for x in dealt) < 30
