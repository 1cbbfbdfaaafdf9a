"""The pipeline's stages against brute force on a small table."""

import unicodedata

import pytest

import corpus_pipeline
from plumbline.llm import neardup

from .test_neardup import brute
from .test_repeats import brute_words

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kinds = docs.columns, [f.dataType for f in docs.schema]
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 34 ½ ² Ⅷ!", "en", "s", 13), (10**6 + 2, "", None, None, 0)], docs.schema)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    seen = [docs.unionByName(odd)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF)
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if name != "packing":
            assert out.columns == columns and [f.dataType for f in out.schema] == kinds
    start, lang, near, cut, clean, packed = ({r.doc_id: r for r in x.collect()} for x in seen)
    assert set(lang) == {i for i, r in start.items() if r.text and any(unicodedata.category(c)[0] == "L" for c in r.text)}
    ids = sorted(lang)
    groups = brute([lang[i].text for i in ids])
    assert set(near) == {i for i, (_, g) in zip(ids, groups) if ids[g] == i}
    ids = sorted(near)
    for i, (n, gone, sha) in zip(ids, brute_words([near[i].text for i in ids], 20)):
        assert (i in cut) == (gone < n)
        if i in cut and not gone:
            assert cut[i].text == near[i].text
    from .test_simple import brute_hits

    items = [(r.item_id, r.text) for r in bench.collect()]
    assert set(clean) == {i for i, r in cut.items() if not brute_hits(r.text, items)[4]}
    assert set(packed) == set(clean)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == set(clean)  # the odd rows go first


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert stage[1](spark, docs, SF).count() == 0


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_whose_names_clash_with_their_own(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["lang_pred", "Score", "runs", "tkey", "owner", "row_key", "component_id", "kept", "words", "a", "b", "rep"]
    more = docs.selectExpr("*", *(f"'own' AS {x}" for x in names))
    out = stage[1](spark, more, SF)
    assert out.columns == more.columns
    rows = out.collect()
    assert {r[x] for r in rows for x in names} == {"own"}
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage[1](spark, docs, SF).collect())


def test_shingles_are_over_lower_case_words():
    assert len(neardup.shingles("A b c d e F")) == 2 and (neardup.shingles("a b") == neardup.shingles("A  B\n")).all()
