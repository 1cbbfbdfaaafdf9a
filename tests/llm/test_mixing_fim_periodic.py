"""Mixing, fill-in-middle and periodic runs against brute force and round trips."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import fim, mixing, periodic

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, rank string, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", "clash", "clash") for i, t, s in rows], DOC)


def texts(n, seed=7):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma,", "x1", "é", "(d)", " wide", "z\x1cz"]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 20, 60, 200]))) for _ in range(n)]


# mixing


def brute_mix(rows, weights=(1, 2, 3), cap=3, full=50, per_bucket=5000):
    docs = []
    for i, t, s in rows:
        h = hashlib.md5(f"mix:{'' if i is None else i}:{t or ''}".encode()).hexdigest()
        docs.append({"id": i, "s": s, "size": len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), "u": (int(h[:13], 16) + 0.5) / 16**13})
    names = sorted({d["s"] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(d["size"] for d in docs if d["s"] == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, above = sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in above]
        level = (total - cap * sum(sizes[s] for s in above)) / sum(weight[s] for s in left) if left else 0.0
        more = {s for s in left if weight[s] * level > cap * sizes[s]}
        if not more:
            break
        above |= more
    target = {s: float(cap * sizes[s]) if s in above else weight[s] * level for s in names}
    for s in names:
        own = [d for d in docs if d["s"] == s]
        for d in own:
            d["v"] = min(max(d["size"], 1), full)
        lo, hi = 0.0, float(cap)  # the factor by halving
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(cap, mid * d["v"]) * d["size"] for d in own) < target[s] else (lo, mid)
        for d in own:
            d["e"] = min(cap, hi * d["v"])
        d_s = sizes[s], target[s]
        yield s, d_s, own


def walked(rows, rest, buckets):
    """(row, whether it is taken once more): by rank, whole buckets first, then the passes at the cut."""
    order = sorted(rows, key=lambda r: (r.place, r.doc_id or 0, r.size))
    taken, cut = [], None
    for b in range(buckets):
        own = [r for r in order if math.floor(r.place * buckets) == b]
        words = sum(r.size for r in own)
        if cut is None and words > rest:
            cut, left, chosen = b, rest, set()
            for _ in range(mixing.PASSES):
                run, was = 0, left
                for r in own:
                    if id(r) not in chosen and r.size <= was:
                        run += r.size
                        if run <= was:
                            chosen.add(id(r))
                            left -= r.size
            free = sorted((r for r in own if id(r) not in chosen), key=lambda r: abs(left - r.size))
            if free and abs(left - free[0].size) < left:
                chosen.add(id(free[0]))
            taken += [(r, int(id(r) in chosen)) for r in own]
        else:
            taken += [(r, int(cut is None)) for r in own]
            rest -= 0 if cut is not None else words
    return taken


def check_mix(spark, rows, **options):
    got = mixing.mix(docs_of(spark, rows), **options).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in rows)
    for s, (size, target), own in brute_mix(rows):
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size and r.target == pytest.approx(target, rel=1e-9) for r in mine)
        assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0 for r in mine)
        want = {(d["id"], d["size"], round(d["u"], 12)): d["e"] for d in own}
        for r in mine:
            e = next(v for (i, n, _), v in want.items() if (i, n) == (r.doc_id, r.size))
            assert r.expected == pytest.approx(e, abs=1e-6)
            assert r.size == 0 or math.floor(r.expected) <= r.taken / r.size <= math.floor(r.expected) + 1
        taken, sizes = sum(r.taken for r in mine), sorted(r.size for r in mine)
        assert abs(taken - target) <= max(sizes, default=0)
        want = walked([r for r in mine if r.place is not None], max(0.0, target - sum(math.floor(r.expected) * r.size for r in mine)), math.ceil(len(mine) / options.get("per_bucket", 5000)))
        assert sorted((r.place, r.taken) for r in mine if r.place is not None and r.size) == sorted((r.place, (math.floor(r.expected) + more) * r.size) for r, more in want if r.size)
        for r in mine:
            if r.p > 1e-9:
                u = next(d["u"] for d in own if (d["id"], d["size"]) == (r.doc_id, r.size))
                q = u / (1 - u) / (r.p / (1 - r.p))
                assert r.place == pytest.approx(q / (1 + q), rel=1e-6)
    return got


def test_mixing_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["a", "a", "a", "b", "c", "é", "\U0001F600", None])) for i, t in enumerate(texts(160))]
    first = check_mix(spark, rows)
    again = mixing.mix(docs_of(spark, rows).repartition(5)).collect()
    key = lambda r: tuple(r)
    assert sorted(map(str, map(key, first))) == sorted(map(str, map(key, again)))
    check_mix(spark, rows, per_bucket=4)  # many buckets a source
    # a source that is small for its weight stops at three times its words
    small = [(i, "w " * 50, "a") for i in range(40)] + [(100 + i, "w " * 10, "b") for i in range(3)] + [(200, "w " * 30, "c")]
    got = check_mix(spark, small)
    assert {r.target for r in got if r.source == "b"} == {90.0} and all(r.taken == 3 * r.size for r in got if r.source in "bc")
    total = sum(r.size for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)


def test_mixing_odd_tables(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (None, "x y z", None), (4, "one two", "b"), (4, "one two", "b"), (5, "w " * 3000, "b")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == 7 and all(r.taken == 0 for r in got if r.source == "a") and {r.target for r in got if r.source == "a"} == {0.0}
    assert mixing.mix(docs_of(spark, [])).collect() == []
    blank = mixing.mix(docs_of(spark, [(1, None, "a"), (2, " \n", "b")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in blank] == [(0, 0, 0.0, 0)] * 2
    one = mixing.mix(docs_of(spark, [(i, "a b c d e f g h i j", "only") for i in range(30)])).collect()  # repeated texts, one source
    assert sum(r.taken for r in one) == 300


def test_long_documents_are_sampled_more_often_than_fragments(spark):
    rows = [(i, "w " * (60 if i % 2 else 6), "ab"[i % 4 // 2]) for i in range(2000)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    share = lambda n, s: sum(r.taken for r in got if (r.size, r.source) == (n, s)) / sum(r.size for r in got if (r.size, r.source) == (n, s))
    for s in "ab":
        p = {r.size: r.expected for r in got if r.source == s}
        assert p[6] < p[60] and share(6, s) == pytest.approx(p[6], abs=0.06) and share(60, s) == pytest.approx(p[60], abs=0.06)


# fill in the middle


def brute_cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or three % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((one % (n + 1), two % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if four % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_lists_give_each_end(spark):
    rng = random.Random(5)
    for k in range(200):
        text = "".join(rng.choice(["word", "Ab", "é", " ", "\n", "\U0001F600", "1"]) for _ in range(rng.randrange(0, 80)))
        want = [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        found = fim.ends(text)
        index = fim.EliasFano.of(found)
        assert found.tolist() == want and [index.select(i) for i in range(len(want) + 1)] == [0, *want]
    far = np.array([5, 6, 7, 1_000_000, 1_000_001])
    assert [fim.EliasFano.of(far).select(i + 1) for i in range(5)] == far.tolist()
    long = fim.EliasFano.of(fim.ends("ab " * 400_000))
    assert long.select(long.n) == 1_200_000 and len(long.low) + len(long.high) < 400_000  # under half a byte a unit


FIM_TEXTS = [None, "", "a", "has <P> in it", "tail <M>", "é\U0001F600x y\r\n", "abc def, ghi. " * 30, "x" * 5000, *["shared text, copied often"] * 40, *texts(60)]


@pytest.mark.parametrize("options", [{}, {"least_share": 3}, {"hashed": lambda c: F.length(c) % 3}, {"hashed": lambda c: F.lit(1), "least_share": 7}])
def test_fill_in_middle_against_brute_force(spark, options):
    rows = [(i, t, "s") for i, t in enumerate(FIM_TEXTS)] + [(None, "no number here", "s"), (7, FIM_TEXTS[7], "s")]
    docs = docs_of(spark, rows)
    made = fim.cut(docs, **options).collect()
    want = [(i, *brute_cut(i, t)) for i, t, _ in rows]
    order = lambda x: (str(x[0]), x[5])
    assert sorted((tuple(r) for r in made), key=order) == sorted(want, key=order)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    back = sorted((str(r.doc_id), r.text) for r in fim.restore(fim.cut(docs, **options)).collect())
    assert back == sorted((str(i), t or "") for i, t, _ in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = sorted((str(r.doc_id), r.output_sha256, r.restored_sha256) for r in fim.digests(docs, **options).collect())
    assert digests == sorted((str(i), sha(brute_cut(i, t)[4]), sha(t or "")) for i, t, _ in rows)


def test_index_has_one_entry_a_text(spark):
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(FIM_TEXTS)])
    entries = fim.index(fim.dealt(docs)).collect()
    assert len(entries) == len({t or "" for t in FIM_TEXTS}) == len({r.key for r in entries})
    shared = fim.index(fim.dealt(docs, least_share=10)).groupBy("key").count().where("count > 1").collect()
    often = [t for t in {t or "" for t in FIM_TEXTS} if sum((x or "") == t for x in FIM_TEXTS) > 10]
    assert len(shared) == len(often) == 2 and all(2 <= r["count"] <= 5 for r in shared)  # an entry a share
    # different texts of one hash have no entry and are cut on their own
    assert fim.index(fim.dealt(docs, hashed=lambda c: F.lit(1))).count() == 0
    other = {r.doc_id: r.output for r in fim.cut(docs, seed="2").collect()}
    assert sum(other[r.doc_id] != r.output for r in fim.cut(docs).collect()) > 20
    assert fim.cut(docs_of(spark, [])).collect() == [] and fim.restore(fim.cut(docs_of(spark, []))).collect() == []


# periodic runs


def brute_runs(s, least=6, times=4):
    out = {}
    for q in range(1, len(s) // times + 1):
        i = 0
        while i < len(s) - q:
            j = i
            while j < len(s) - q and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((i, j - i, q) for (i, j), q in out.items())


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        n, kinds = rng.randrange(0, 70), rng.randrange(1, 4)
        s = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
        assert periodic.runs(np.array(s, dtype=np.int64)) == brute_runs(s), s
        assert periodic.runs(np.array(s, dtype=np.int64), 4, 2) == brute_runs(s, 4, 2), s
    one = periodic.runs(np.zeros(100_000, dtype=np.int64))
    assert one == [(0, 100_000, 1)]
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(4, dtype=np.int64), 6, 1)


def test_words_are_split_at_six_characters_alone():
    text = "a\x1cb\x85c d e\tf\x0bg\x0ch\ri\nj k"
    assert [w.decode() for w in periodic.words_of(text)] == re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in found)]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    whole = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, n, len(found), *whole, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(kept)))


def test_periodic_digests_against_brute_force(spark, sf):
    rows = [(i, t, "s") for i, t in enumerate([None, "", " \t", "la " * 9, "a b " * 5 + "c " * 7, "x y z " * 3, *texts(60)])] + [(None, "ha " * 8, "s"), (3, "la " * 9, "s")]
    got = [tuple(r)[:9] for r in periodic.digests(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted((brute_row(i, t) for i, t, _ in rows), key=str)
    assert periodic.digests(docs_of(spark, [])).collect() == []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = {r.doc_id: tuple(r)[:9] for r in periodic.digests(docs).collect()}
    short = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 3000]
    assert len(short) > 100 and sum(some[i][2] > 0 for i, _ in short) > 3
    assert all(some[i] == brute_row(i, t) for i, t in short)


def test_collapse_keeps_columns_and_texts_without_runs(spark):
    rows = [(1, "stay  as\tit is", "s"), (2, "go go go go go go on", "s"), (3, None, "s"), (4, "a b a b a b a b\nend", "s"), (5, "é " * 7, "s")]
    got = periodic.collapse(docs_of(spark, rows))
    assert got.columns == docs_of(spark, []).columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "stay  as\tit is", 2: "go on", 3: None, 4: "a b end", 5: "é"}
    assert [tuple(r) for r in periodic.runs_of(docs_of(spark, rows)).orderBy("doc_id").collect()] == [(2, 0, 6, 1), (4, 0, 8, 2), (5, 0, 7, 1)]
