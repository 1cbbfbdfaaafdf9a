"""Near-dedup against all pairs, and components against union-find."""

import random

from plumbline.llm import neardup
from plumbline.llm.components import components

from .test_simple import docs_of


def brute(items):
    sets = []
    for t in items:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    comp = list(range(len(items)))
    find = lambda i: i if comp[i] == i else find(comp[i])
    for i in range(len(items)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    out = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(n):
        words = [word() for _ in range(r.choice([6, 40, 200]))]
        out.append(" ".join(words))
        for _ in range(r.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 20))):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    base = [word() for _ in range(150)]
    for _ in range(120):  # a large group around one text, whose members differ from each other
        copy = list(base)
        for _ in range(r.randint(1, 4)):
            copy[r.randrange(150)] = word()
        out.append(" ".join(copy))
    r.shuffle(out)
    return out


def test_groups_against_all_pairs(spark):
    for seed, region in ((1, 256), (2, 256), (2, 8)):
        items = corpus(seed)
        rows = sorted(neardup.cluster(docs_of(spark, items).repartition(3), region=region).collect())
        got, want = [(r.n_shingles, r.component_id) for r in rows], brute(items)
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
        if region == 256:
            assert got == want
        else:  # a group of 121 texts, many of them at 0.75 of a single other, in regions of 8
            assert sum(a != b for a, b in zip(got, want)) <= 0.03 * len(items)


def test_one_of_each_group_stays_and_odd_tables(spark):
    docs = docs_of(spark, ["a b c d e f", "A b c d  e f", None, "", "x"])
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == [0, 2, 3, 4]
    assert neardup.keep_one(docs).columns == docs.columns
    assert neardup.cluster(docs_of(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert [(r.doc_id, r.component_id, r.kept) for r in neardup.cluster(odd).orderBy("doc_id").collect()] == [(None, 1, True), (1, 1, True), (1, 1, True)]


def test_components_against_union_find(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    comp = list(range(600))
    find = lambda i: i if comp[i] == i else find(comp[i])
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        comp[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame([*links, (None, 1), (5, 5)], "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in links for n in (a, b) if a != b} | {n: find(n) for a, b in links if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_group_around_one_text_is_whole(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    base = [word() for _ in range(150)]
    items = [" ".join(base)]
    for edits in [3] * 2500 + [5] * 40:  # at 0.81 of the first text, and at 0.70 or, where edits are close, more
        copy = list(base)
        for at in r.sample(range(150), edits):
            copy[at] = word()
        items.append(" ".join(copy))
    sets = [set(neardup.shingles(t).tolist()) for t in items]
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    assert all(linked(sets[0], s) for s in sets[:2501])  # so these are one group
    want = {i for i in range(len(items)) if i <= 2500 or any(linked(sets[i], s) for s in sets[:2501])}
    loose = [i for i in range(len(items)) if i not in want]
    assert loose and not any(linked(sets[i], sets[j]) for i in loose for j in range(len(items)) if i != j and j not in want)
    rows = neardup.cluster(docs_of(spark, items).repartition(3), region=256).collect()
    assert {row.doc_id for row in rows if row.component_id == 0} == want


def test_small_regions_lose_no_link(spark):
    for seed in (2, 3):
        items = corpus(seed)
        got = [(r.n_shingles, r.component_id) for r in sorted(neardup.cluster(docs_of(spark, items).repartition(3), region=8).collect())]
        assert got == brute(items)


def test_shared_counts_against_sets():
    r = random.Random(5)
    draw = lambda n: [neardup.np.unique(neardup.np.array([r.randrange(400) if r.random() < 0.5 else r.randrange(40) for _ in range(r.randint(1, 60))], dtype="uint64")) for _ in range(n)]
    x, y = draw(50), draw(70)
    assert (neardup.overlaps(x, y) == [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]).all()


def test_long_texts_and_small_buffers_change_nothing(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(200_000))
    texts = [long, long + " more words at the end", "w0 w1 w2 w3 w4 " * 3, *[f"a b c d e f g h i j k l m n o p q r s t u v w x y z {i}" for i in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = sorted(neardup.cluster(df).collect())
    groups = {r.doc_id: r.component_id for r in first}
    assert groups[1] == 0 and groups[2] == 2 and all(groups[i] == 3 for i in range(3, 43))
    monkeypatch.setattr(neardup, "AT_ONCE", 1)
    assert sorted(neardup.cluster(df, region=4).collect()) == first


def test_a_line_in_every_document_brings_none_together(spark, monkeypatch):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    line = " ".join(word() for _ in range(40))
    items = [" ".join(word() for _ in range(40)) + " " + line for _ in range(80)]
    items += [f"{items[0]} more words {i}" for i in range(12)]
    compared, exact = [], neardup.exact

    def counted(*args, **more):
        compared.append(next(x for x in args if "group" in getattr(x, "columns", [])).count())
        return exact(*args, **more)

    monkeypatch.setattr(neardup, "exact", counted)
    rows = sorted(neardup.cluster(docs_of(spark, items).repartition(3), region=8).collect())
    assert [(x.n_shingles, x.component_id) for x in rows] == brute(items)
    assert sum(compared) < len(items) // 2  # the line is in split regions of all trees
