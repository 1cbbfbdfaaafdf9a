"""HTML extraction and severity grading."""

import re
from collections import Counter
from html import unescape

import numpy as np
import pandas as pd

from plumbline.llm import ordinal, queries, wrappers

from .test_simple import docs_of


def test_simple_tree_matching_counts_shared_nodes():
    tree = lambda s: wrappers.repeated(wrappers.parse(s)[0])
    a, b = tree("<div><p>1</p><ul><li>x</li><li>y</li></ul></div>"), tree("<div><h1>t</h1><p>2</p><ul><li>x</li></ul></div>")
    assert len(wrappers.match(a, a)) == 5 == len(wrappers.match(a, b)) == len(wrappers.match(b, a))  # root, div, p, ul and the repeated li
    crossed = wrappers.match(tree("<h1>a</h1><p>b</p><ul><li>c<li>d</ul>"), tree("<ul><li>c</ul><h1>a</h1><p>b</p>"))
    assert sorted(x.label for x, _ in crossed) == ["", "h1", "p"]  # order is kept: the list can't be matched as well


def test_matching_is_the_largest_by_brute_force():
    def largest(x, y):
        if not x or not y:
            return 0
        both = 1 + largest(x[0].children, y[0].children) + largest(x[1:], y[1:]) if x[0].label == y[0].label else 0
        return max(both, largest(x[1:], y), largest(x, y[1:]))

    r = np.random.default_rng(3)

    def page(depth):
        return "".join(f"<{t}>{page(depth - 1)}</{t}>" for t in r.choice(["div", "span", "b"], r.integers(0, 4))) if depth else "x"

    for _ in range(60):
        a, b = (wrappers.repeated(wrappers.parse(page(3))[0]) for _ in range(2))
        assert len(wrappers.match(a, b)) == 1 + largest(a.children, b.children)


def test_learned_template_goes_and_varying_slots_stay():
    page = lambda i: f"<body><div>Site of all</div><div class=x>Story {i} is here. <b>Bold</b></div><span>part {i}</span><div>End of site</div></body>"
    wrapper = wrappers.learn([page(i) for i in range(6)])
    assert wrappers.main_text(page(77), wrapper) == "Story 77 is here. Bold\npart 77"
    assert wrappers.learn([page(1)] * 8) is None
    assert wrappers.Wrapper.load(wrapper.dump()) == wrapper


def test_the_wrapper_decides_within_articles_and_over_names():
    page = lambda i: f"<body><article><h1>Title {i}</h1><div class=box>Read our terms, friends.</div><p>Story {i} goes on and on, {i * i} times.</p></article></body>"
    wrapper = wrappers.learn([page(i) for i in range(6)])
    assert wrappers.main_text(page(9), wrapper) == "Title 9\nStory 9 goes on and on, 81 times."
    assert "terms" in wrappers.main_text(page(9))  # without a wrapper nobody can know
    teaser = lambda i: f"<body><article>See {i}</article><div class=story><p>The long story number {i} is told here, in {i} parts.</p></div></body>"
    wrapper = wrappers.learn([teaser(i) for i in range(6)])
    assert wrappers.main_text(teaser(9), wrapper) == "See 9\nThe long story number 9 is told here, in 9 parts."
    named = lambda i: f"<body><div class=main-menu><p>In truth the text, the {i}th of all.</p></div><p class=by>By {i}</p></body>"
    wrapper = wrappers.learn([named(i) for i in range(6)])
    assert wrappers.main_text(named(9), wrapper) == "In truth the text, the 9th of all.\nBy 9"
    assert wrappers.main_text(named(9)) == "By 9"


def test_names_that_only_sound_like_furniture():
    assert wrappers.main_text('<div class="content has-sidebar"><p>Real text</p></div>') == "Real text"
    assert wrappers.main_text('<article><div class="article-header"><h1>Title</h1></div><p>x</p></article>') == "Title\nx"
    assert wrappers.main_text('<div class="sidebar"><p>All there is</p></div>') == "All there is"
    assert wrappers.main_text('<div class="site-header">no</div><div class="main-nav">no</div><div class="top ad">no</div><p>x</p>') == "x"


def test_names_with_other_words_tell_little():
    text = wrappers.main_text
    assert text('<div class="share-price-analysis"><p>Shares fell.</p></div>') == "Shares fell."
    assert text('<article class="login-required"><p>Text</p></article>') == text('<article><div class="comment-on-law"><p>Text</p></div></article>') == "Text"
    assert text('<p>see <a class="share-link">this</a> ok</p>') == "see this ok"
    assert text('<article><h1 class="subscribe">T</h1><p>x</p></article>') == "T\nx"
    assert text('<article><p>a</p><div class="comment-list"><p>c</p></div><div class="login-required"><p>b</p></div></article><div class="ad-slot-2">buy</div>') == "a\nb"
    page = lambda i: f'<body><div class="share-bar"><p>The {i}th story is long and told in {i * i} parts, of which the last is the best, and so on to the end of it all.</p></div><footer>Site of all</footer></body>'
    other = lambda i: f'<body><p>The {i}th story is long and told in {i * i} parts.</p><div class="comments">Reader {i} says {i * 7}</div><footer>{i} times seen</footer></body>'
    assert wrappers.main_text(page(9)) == ""
    assert wrappers.main_text(other(9), wrappers.learn([other(i) for i in range(6)])) == "The 9th story is long and told in 81 parts."
    varied = lambda i: page(i).replace("<body>", f"<body><p>{i} {i * 3} {i * 5}</p>")
    assert "The 9th story" in wrappers.main_text(varied(9), wrappers.learn([varied(i) for i in range(8)]))  # nearly all varying text: the name is wrong


def test_wrappers_find_the_given_articles_without_lists(monkeypatch):
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").drop_duplicates("html")
    host = pages.url.str.extract(r"://([^/?#:]*)")[0].str.lower()
    want = {p.page_id: Counter(wrappers.main_text(p.html).split()) for p in pages.itertuples()}
    for name in ("SOFT", "SURE", "DOUBTFUL"):
        monkeypatch.setattr(wrappers, name, set())

    def shares(wrapper_of):
        both = found = right = 0
        for h, own in pages.groupby(host):
            if (wrapper := wrapper_of(own.html.tolist())) is not None:
                for p in own.itertuples():
                    got = Counter(wrappers.main_text(p.html, wrapper).split())
                    both, found, right = both + (got & want[p.page_id]).total(), found + got.total(), right + want[p.page_id].total()
        return both / max(1, right), both / max(1, found)

    learned = shares(lambda html: wrappers.learn(html[: wrappers.SAMPLE]))
    empty = shares(lambda html: wrappers.Wrapper(main=False) if wrappers.learn(html[: wrappers.SAMPLE]) else None)
    assert min(learned) >= 0.98 > min(empty)


def test_pages_of_any_depth_and_breadth_teach():
    deep = [f"{'<div>' * 3000}deep {i} text {i * 7}" for i in range(5)]
    assert wrappers.main_text(deep[0], wrappers.learn(deep)) == "deep 0 text 0"
    wide = ["<body>" + "".join(f"<p>a {i} {j}</p><div>b {j} {i}</div>" for j in range(2000)) for i in range(5)]
    assert wrappers.main_text(wide[0], wrappers.learn(wide)).count("\n") == 3999


def test_marked_elements_entities_and_broken_markup():
    html = (
        '<html><head><title>t</title><script>var t="</p>";</script></head><body><header>Top</header><nav><a href="/">m</a></nav><div class="cookie-notice">c</div>'
        '<article><header><h1>A &amp;amp; B</h1></header><p>one\n\n two<br>three&nbsp;<i>x</i>y<p class=lead>four <aside>no</aside><ul><li>l1<li>l2</ul>'
        '<div class="ad">ad</div><form>f<input></form><div id="comments"><p>reader</p></div><!-- <p>no</p> --><p title="a>b">a &lt; b</p></article><footer>&copy; x</footer>'
    )
    assert wrappers.main_text(html) == "A &amp; B\none two three xy\nfour\nl1\nl2\na < b"
    for odd in (None, "", "   ", "<", "<p", "a < b", "</p></div>", "<p><!--", "<script>x", "<a title='x>y" * 50, "<div>" * 3000 + "deep", "<![CDATA[x]]>"):
        assert isinstance(wrappers.main_text(odd), str)
    assert wrappers.main_text("a < b") == "a < b" and wrappers.main_text("<div>" * 3000 + "deep") == "deep"


def test_pages_give_their_articles(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in queries.op9_wrapper_extraction(spark, sf).collect()}
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    assert len(rows) == len(pages)
    for p in pages.itertuples():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(x for x in blocks if x)
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want)


def test_extraction_of_odd_tables(spark):
    kind = "page_id long, url string, html string, host int"
    rows = [(1, None, "<p>x</p>", 1), (2, "http://a/", None, 1), (2, "http://a/", None, 1), (3, "::", "", 1)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in wrappers.extract(spark.createDataFrame(rows, kind), broadcast_bytes=0).collect())
    assert got == [(1, "x", 1), (2, "", 0), (2, "", 0), (3, "", 0)]
    assert wrappers.extract(spark.createDataFrame([], kind)).count() == 0


def test_copies_and_long_pages_teach_a_wrapper(spark):
    page = lambda i, n=1: f"<body><div>Site of all</div><div class=x>{f'Story {i} is here. ' * n}</div></body>"
    rows = [(i, f"http://twice/{i}", page(i)) for i in range(20)] * 2 + [(50 + i, f"http://long/{i}", page(i, 3000)) for i in range(6)]
    rows += [(60, "http://one/", page(0))] * 300 + [(70 + i, f"http://one/{i}", page(i)) for i in range(1, 8)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 34 and all(t.startswith("Story") for t in got.values()), {k: v[:40] for k, v in got.items()}


def test_ordinal_regression_recovers_ordered_grades():
    r = np.random.default_rng(0)
    x = r.poisson(1, (3000, 4)).astype(float)
    z = x @ np.array([1.5, -1.0, 0.0, 0.5]) + r.logistic(size=3000)
    grade = np.digitize(z, [0.5, 3])
    w, theta = ordinal.fit(x, grade, np.ones(3000))
    assert np.allclose(w, [1.5, -1, 0, 0.5], atol=0.25) and np.allclose(theta, [0.5, 3], atol=0.3)
    p = ordinal.probabilities(ordinal.Model({}, w, theta), x)
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()


def test_toxic_rows_are_found_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = ordinal.train(docs, labels.where("doc_id % 2 = 0"), max_rows=2000)
    rows = ordinal.grade(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id", F_toxic(labels)), "doc_id").collect()
    hit = sum(r.toxic and r.truth for r in rows)
    assert hit >= 0.88 * sum(r.truth for r in rows) and hit >= 0.95 * sum(r.toxic for r in rows), (hit, sum(r.truth for r in rows), sum(r.toxic for r in rows))
    assert all(0 <= r.severity <= 2 and (r.severity > 0) for r in rows)


def F_toxic(labels):
    return (labels["toxic"] == 1).alias("truth")


def test_severity_follows_grades_that_labels_have(spark):
    r = np.random.default_rng(4)
    bad, good = [f"bad{i}" for i in range(12)], [f"fine{i}" for i in range(300)]
    rows = []
    for i in range(1200):
        grade = int(r.integers(0, 4))
        rows.append((i, " ".join(r.permutation([*r.choice(good, 60), *r.choice(bad, 2 * grade + int(r.integers(0, 2)))])), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = ordinal.train(df, df.where("doc_id < 800"))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    got = [(x.severity, rows[x.doc_id][2]) for x in ordinal.grade(df, model).where("doc_id >= 800").collect()]
    means = [np.mean([s for s, g in got if g == k]) for k in range(4)]
    assert np.corrcoef(*zip(*got))[0, 1] > 0.9 and all(abs(m - k) < 0.5 for k, m in enumerate(means)), means


def test_more_toxic_words_are_more_severe_and_long_texts_count_whole(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = ordinal.train(docs, labels, max_rows=2000)
    texts = ["the " * 400 + " ".join(["idiot", "moron", "scum", "trash"][:n]) for n in range(5)] + ["the " * 500_000 + "idiot moron scum trash"]
    got = [x.severity for x in sorted(ordinal.grade(docs_of(spark, texts), model).collect(), key=lambda x: x.doc_id)]
    assert got[:5] == sorted(got[:5]) and got[0] < 0.5 < got[4] and got[5] > got[0]


def test_grading_odd_tables(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None), (3, 1)], "doc_id long, toxic int")
    texts = [("idiot moron fine " if i % 2 else "fine good day ") * (i % 3 + 1) for i in range(20)] + [None, "", "IDIOT! moron, idiot; MORON"]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in ordinal.grade(docs, ordinal.train(docs, labels)).collect()}
    assert all(got[i].toxic == bool(i % 2) for i in range(20)) and not got[20].toxic and not got[21].toxic and got[22].toxic
    none = ordinal.grade(docs, ordinal.train(docs, labels.where("toxic = 0"))).collect()
    assert len(none) == 23 and all(r.severity == 0 and not r.toxic for r in none)
    assert ordinal.grade(docs_of(spark, []), ordinal.Model()).count() == 0
