"""Substring and suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import repeats, substrings, suffixes

from .test_simple import docs_of


def texts(seed, n=40, letters="ab ", passages=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 3)))
    shared = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(passages)]
    out = [None, "", "a" * 300, "ab " * 150, "x", "x y"]
    for _ in range(n):
        parts = [r.choice(shared) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 5))]
        out.append((" " if r.random() < 0.5 else "\n").join(parts))
    return out + out[8:14] + [out[9]] * 5


def brute_words(items, width):
    split = [t.encode().split() if t else [] for t in items]
    seen, res = set(), []
    for words in split:
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        kept = [w for w, g in zip(words, gone) if not g]
        res.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return res


def brute_bytes(items, length, keep_first):
    data = [(t or "").encode() for t in items]
    count, first = {}, {}
    for d, t in enumerate(data):
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
            first.setdefault(t[i : i + length], (d, i))
    res = []
    for d, t in enumerate(data):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if (first[w] != (d, i)) if keep_first else count[w] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        res.append((len(t), len(t) - len(kept), sum(g and not p for g, p in zip(gone, [False, *gone])), hashlib.sha256(kept).hexdigest()))
    return res


@pytest.mark.parametrize("seed,batches,width", [(1, 1, 20), (2, 3, 20), (3, 2, 6)])
def test_substrings_against_brute_force(spark, seed, batches, width):
    items = texts(seed)
    rows = substrings.dedup(docs_of(spark, items).repartition(3), width, 4, batches).collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in sorted(rows)] == brute_words(items, width)


def test_index_is_incremental_and_compacts(spark, tmp_path):
    items = texts(4)
    docs = docs_of(spark, items)
    got, runs = {}, []
    for lo in range(0, len(items), 14):
        index = substrings.FingerprintIndex(spark, docs, max_runs=2, path=str(tmp_path / "index"))  # reopened from its folder
        for r in index.add(docs.where(f"doc_id >= {lo} and doc_id < {lo + 14}")).collect():
            got[r.doc_id] = r.runs
        runs.append(len(index.runs))
        for name in index.runs:
            spark.sql(f"drop table `{name}`")  # another session knows no table
    assert runs == [1, 2, 2, 2, 2] and len(list((tmp_path / "index").iterdir())) <= 2 + 2  # runs, the manifest and its sum
    split = [t.encode().split() if t else [] for t in items]
    for i, (n, gone, _) in enumerate(brute_words(items, 20)):
        assert int(repeats.covered(len(split[i]), got.get(i), 20).sum()) == gone
    cut = {r.doc_id: r for r in substrings.cut(docs, batches=2).collect()}
    for i, (n, gone, sha) in enumerate(brute_words(items, 20)):
        if gone:
            assert hashlib.sha256(cut[i].text.encode()).hexdigest() == sha and cut[i].n_chars == len(cut[i].text)
        else:
            assert cut[i].text == items[i]
    assert substrings.dedup(docs_of(spark, [])).count() == 0


def test_old_runs_are_merged_where_they_lie(spark, tmp_path):
    docs = docs_of(spark, texts(4))
    index = substrings.FingerprintIndex(spark, docs, path=str(tmp_path / "index"))
    index.add(docs.where("doc_id < 20"))
    index.add(docs.where("doc_id >= 20"))
    with substrings.configured(spark, substrings.SORTED):
        old, own = map(index.run, index.runs)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (index.merged(old, own), index.united(old, own))]
    assert all("SortMergeJoin" in plan and "Exchange" not in plan for plan in plans) and "Sort [" not in plans[0], plans
    index.compact()
    files = [p.name for p in (tmp_path / "index" / index.runs[0]).iterdir() if p.name.startswith("part-")]
    assert len(index.runs) == 1 and len(files) <= index.state["buckets"]  # one file a bucket


def test_colliding_anchors_cost_no_words(spark, tmp_path):
    items = texts(6)
    docs = docs_of(spark, items)
    got = {}
    for lo, hi in ((0, 30), (30, 99)):
        index = substrings.FingerprintIndex(spark, docs, path=str(tmp_path / "index"), anchor_bits=2)
        got |= {r.doc_id: r.runs for r in index.add(docs.where(f"doc_id >= {lo} and doc_id < {hi}")).collect()}
    split = [t.encode().split() if t else [] for t in items]
    for i, (n, gone, _) in enumerate(brute_words(items, 20)):
        assert int(repeats.covered(len(split[i]), got.get(i), 20).sum()) == gone


def test_rows_without_id_and_repeated_rows(spark):
    passage = " ".join(f"w{i}" for i in range(450))
    rows = [(None, passage), (None, passage), (1, passage), (1, passage), (2, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.dedup(df).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 450)]
    size = len(passage)
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffixes.dedup(df).collect()) == [(0, 0), (0, 0), (1, size), (1, size), (2, size)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffixes.dedup(df, keep_first=True).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, size)]


@pytest.mark.parametrize("seed,length,keep_first,most", [(5, 60, False, 256), (6, 60, True, 256), (7, 60, False, 2), (8, 60, True, 2), (9, 400, False, 256)])
def test_suffixes_against_brute_force(spark, seed, length, keep_first, most):
    items = texts(seed)
    rows = suffixes.dedup(docs_of(spark, items).repartition(3), length, keep_first, 12, most).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(rows)] == brute_bytes(items, length, keep_first)


def common_passages(seed, n=120):
    """Texts around passages that most of them share, of lengths about the window's, and copies of some."""
    r = random.Random(seed)
    noise = lambda k: "".join(r.choice("abcdefghij é") for _ in range(k))
    shared = [noise(k) for k in (14, 40, 57, 59, 60, 61, 75)]
    ends = [noise(r.randint(1, 30)) for _ in range(8)]  # some texts agree a little further than the passage
    out = [noise(r.randint(0, 90)) + r.choice(ends) + r.choice(shared) + r.choice(ends) + noise(r.randint(0, 90)) for _ in range(n)]
    return out + out[3:9] + [out[5]] * 4 + ["a" * 200, "ab" * 120]


@pytest.mark.parametrize("keep_first,most", [(False, 2), (True, 2), (False, 9), (True, 9)])
def test_suffixes_of_common_passages_against_brute_force(spark, keep_first, most):
    items = common_passages(11)
    rows = suffixes.dedup(docs_of(spark, items).repartition(3), 60, keep_first, 12, most).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(rows)] == brute_bytes(items, 60, keep_first)


def test_contexts_of_a_common_passage_are_not_dealt_window_by_window(spark, monkeypatch):
    r = random.Random(12)
    noise = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    passage = noise(300)
    items = [noise(400) + passage + noise(400) for _ in range(300)]
    items[7] = items[7][:600] + items[8][600:]  # from inside the passage on as the next
    sizes = []

    def spied(df, name, keep=False, write=suffixes.materialize):
        out = write(df, name, keep)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(suffixes, "materialize", spied)
    monkeypatch.setattr(repeats, "materialize", spied)
    rows = suffixes.dedup(docs_of(spark, items)).collect()
    assert [(r.doc_id, r.n_removed, r.n_spans) for r in sorted(rows) if r.n_removed] == [(7, 700, 1), (8, 700, 1)]
    anchors = dict(reversed(sizes))["anchors"]  # of all texts; the passage has 256 contexts and more at an anchor
    assert max(n for name, n in sizes if name == "contexts") > suffixes.MOST
    assert all(n <= 2 * anchors for _, n in sizes), sizes


def test_copies_of_a_row_make_no_squares(spark):
    r = random.Random(13)
    noise = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    passage = noise(50)
    texts_ = [noise(60) + passage + noise(60) for _ in range(3)]
    docs = spark.createDataFrame([(i, texts_[i]) for i in (0, 1, 2) for _ in range(20 if i == 0 else 1)], "doc_id long, text string")
    _, refine = repeats.classify(repeats.find_segments(docs, repeats.byte_tokens, 60, 12).selectExpr("*", "true new"), True)
    refine = refine.selectExpr("*", "0 origin")
    rows = repeats.keyed(docs).selectExpr("doc_id", "tkey", "0 origin", "cast(text as binary) data")
    assert suffixes.contexts(rows, refine, 60).count() == refine.count() == 22


def test_suffix_ranks_and_longest_previous_factors():
    r = random.Random(0)
    for _ in range(30):
        data = bytes(r.choice(b"ab") for _ in range(r.randint(1, 60)))
        n = len(data)
        own, none = np.frombuffer(data, dtype=np.uint8), np.zeros(n, dtype=np.int64)
        rank = suffixes.ranks(own, none, n + 1)
        assert sorted(range(n), key=lambda i: data[i:]) == np.argsort(rank).tolist()
        longest = lambda i, others: max([0, *(k for j in others for k in range(1, n - max(i, j) + 1) if data[j : j + k] == data[i : i + k])])
        place = np.arange(n)
        for depth in (1, 3, 9):
            previous, following = suffixes.factors(suffixes.ranks(own, none, depth), place)
            assert previous.tolist() == [longest(i, range(i)) >= depth for i in range(n)]
            assert following.tolist() == [longest(i, range(i + 1, n)) >= depth for i in range(n)]
    assert [x.tolist() for x in suffixes.factors(np.array([5, 5, 5]), np.array([1, 1, 2]))] == [[False, False, True], [True, True, False]]
    assert suffixes.dedup.__defaults__[0] == 400


def test_suffixes_on_an_empty_table(spark):
    assert suffixes.dedup(docs_of(spark, [])).count() == 0
    row = suffixes.dedup(docs_of(spark, [None])).collect()[0]
    assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (0, 0, 0, hashlib.sha256(b"").hexdigest())
