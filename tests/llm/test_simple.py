"""Decontamination, language ID, packing and sharding against brute force, round trips and held-out rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, langid, packing, queries, sharding

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(texts)], DOC)


def brute_hits(text, items):
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    words, hit, found = split(text), set(), set()
    for item, body in items:
        own = split(body)
        for i in range(max(1, len(own) - 12) if own else 0):
            w = own[i : i + 13]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit |= set(range(j, j + len(w)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination_against_brute_force(spark):
    long = " ".join(f"w{i % 7}é" for i in range(40))
    items = [(1, "Ab c-d"), (2, long), (10, long), (3, None), (4, "..."), (5, "x")]
    texts = [None, "", "--", "ab AB, c D ab c d", long.upper().replace("É", "é"), "y " * 300 + " ab c d", "x", "ax xa", " ".join(long.split()[3:17]) + " end"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(docs_of(spark, texts), bench).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    parted = decontaminate.contamination(docs_of(spark, texts), bench, max_windows=3).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in parted} == got
    place = next(r for r in rows if r.doc_id == 3)
    assert [texts[3][a:b] for a, b in zip(place.hit_starts, place.hit_ends)] == ["AB, c D ab c d"]
    clean = decontaminate.clean(docs_of(spark, texts), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in got if not got[i][4]] and clean.columns[-1] == "size"
    parts = decontaminate.clean(docs_of(spark, texts).withColumn("row_key", F.lit("own")), bench, max_windows=3)
    assert sorted(r.doc_id for r in parts.collect()) == sorted(r.doc_id for r in clean.collect()) and {r.row_key for r in parts.collect()} == {"own"}
    again = docs_of(spark, texts).union(docs_of(spark, texts)).union(docs_of(spark, texts).where("doc_id in (3, 4)"))
    key = lambda r: (r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated, r.hit_starts, r.hit_ends)
    once, often = (sorted(map(key, decontaminate.contamination(again, bench, max_windows=n).collect())) for n in (100, 2))
    assert once == often and len(once) == 2 * len(texts) + 2  # each repeated row, with its own runs, over any number of automata
    assert decontaminate.clean(again, bench, max_windows=2).count() == 2 * clean.count()
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs_of(spark, texts), empty).collect())
    assert decontaminate.contamination(docs_of(spark, []), bench).count() == 0


def test_language_id_is_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    known = [r for r in rows if r.lang and r.lang_pred != "und"]
    assert len(known) > 150 and sum(r.lang == r.lang_pred for r in known) >= 0.97 * len(known)


def test_language_model_is_a_probability_and_handles_odd_texts(spark):
    model = langid.fit({"a": [b"abab abc"], "b": [b"xyxy xyz", b""]}, order=2)
    for lang in range(2):
        for context in (b"", b"a", b"ab", b"xy", b"zz", b"\xff"):
            total = sum(2 ** -(langid.score(model, context + bytes([c]))[lang] - langid.score(model, context)[lang]) for c in range(256))
            assert total == pytest.approx(1, abs=1e-9)
    assert langid.predict(model, None) == ("und", 0.0) == langid.predict(model, "12 !") == langid.predict(model, "")
    assert langid.predict(model, "abab")[0] == "a" and langid.predict(model, "xyé" * 20000)[0] == "b"
    r = np.random.default_rng(1)  # bytes against a plain tree of counts
    words = bytes(r.integers(97, 101, 3000).astype(np.uint8))
    own = langid.fit({"x": [words[:2000], words[2000:]], "y": [b"zzz"]}, order=3)

    def plain(parts, context, byte, order):
        if order < 0:
            return {c: 1 / 256 for c in range(256)}[byte]
        context = context[len(context) - order :] if order else b""
        after = [p[i + order] for p in parts for i in range(len(p) - order) if p[i : i + order] == context]
        kinds, n = set(after), len(after)
        if not n:
            return plain(parts, context, byte, order - 1)
        if byte in kinds:
            return after.count(byte) / (n + len(kinds))
        rest = 1 - sum(plain(parts, context, c, order - 1) for c in kinds)
        return len(kinds) / (n + len(kinds)) * plain(parts, context, byte, order - 1) / rest

    for text in (b"abcdabdc", b"azb!", bytes(r.integers(97, 101, 40).astype(np.uint8))):
        want = -sum(np.log2(plain([words[:2000], words[2000:]], text[:i], text[i], min(i, 3))) for i in range(len(text)))
        assert langid.score(own, text)[0] == pytest.approx(want, rel=1e-9)
    none = langid.train(docs_of(spark, ["abc"]).selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert langid.predict(none, "abc") == ("und", 0.0)
    assert langid.predict(model, "½ ² Ⅷ ①") == ("und", 0.0) and langid.predict(model, "ª")[0] != "und"
    found = langid.identify(docs_of(spark, ["abab", None]), model)
    assert found.columns[-2:] == ["lang_pred", "score"] and found.count() == 2


def test_forty_languages_of_all_scripts_keep_their_order():
    import pickle

    r = np.random.default_rng(0)
    texts = {}
    for i in range(40):  # alphabets of their own in blocks all over Unicode
        block = [c for c in map(chr, range(0x400 * (i % 20) + 0x100, 0x400 * (i % 20) + 0x500)) if c.isalpha()] or [*"abcdefghij"]
        letters = r.choice(block, 30)
        words = ["".join(r.choice(letters, r.integers(2, 9))) for _ in range(2000)]
        texts[f"l{i:02}"] = [" ".join(r.choice(words, 250)).encode() for _ in range(40)]
    model = langid.fit({k: v[:30] for k, v in texts.items()})
    assert model.order == 3 and len(model.langs) == 40 and len(pickle.dumps(model)) < 128_000_000
    held = [(k, x.decode()) for k, v in texts.items() for x in v[30:]]
    assert all(langid.predict(model, x)[0] == k for k, x in held)


def test_packing_keeps_every_id_once_and_pads_nothing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    tok = Tokenizer.from_file(path)
    texts = [None, "", "Hello\x0bWORLD don't<|endoftext|> über", "a b  c\n\n123 é́", "word " * 9000, "ab " * 50, "ab " * 50, "x'll " * 4095 + "y"]
    for window in (4096, 64):
        rows = packing.pack(docs_of(spark, texts), path, window).collect()
        ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
        seqs, pieces = {}, {}
        for r in rows:
            own = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
            assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(own.tobytes()) and r.length == len(own) > 0
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
            pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        for parts in (*seqs.values(), *pieces.values()):
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
        for parts in seqs.values():
            n = sum(x for _, x in parts)
            assert n <= window and n & (n - 1) == 0
        assert {i: sum(x for _, x in p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    assert packing.pack(docs_of(spark, []), path).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    h = sharding.hilbert_index(grid, 3)
    assert sorted(h) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(h)], axis=0)).sum(1) == 1).all()


def test_shards_are_even_gapless_and_follow_the_curve(spark):
    texts = [None, "", *["same"] * 300, *[f"t{i}" * (i % 40) for i in range(200)]]
    for part_rows in (7, 50_000):
        rows = sharding.assign(docs_of(spark, texts), 16, 5, part_rows).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and sorted(r["rank"] for r in rows) == list(range(len(texts)))
        by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
        assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        order = sorted(rows, key=lambda r: r["rank"])
        assert [r.h for r in order] == sorted(r.h for r in rows)
        assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    odd = spark.createDataFrame([(None, None, None, None), (None, None, None, None), (1, "x", None, "s"), (1, "x", None, "s"), (2, "", "en", None), (3, "é" * 2_000_000, "en", "s")], "doc_id long, text string, lang string, source string")
    for part_rows in (1, 5_000):
        got = sharding.assign(odd, part_rows=part_rows).collect()
        assert sorted(r["rank"] for r in got) == list(range(6)) and len({r.shard for r in got}) == 6 and {r.slot for r in got} == {0}
        assert sorted(r.size for r in got) == [1, 1, 1, 2, 2, 4_000_001]
    few = sharding.assign(docs_of(spark, ["a", "b", "c"]))
    assert sorted(r.slot for r in few.collect()) == [0, 0, 0]
    assert sharding.assign(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("part_rows", [5_000, 20, 3])
def test_equal_texts_stand_together_in_shards(spark, sf, part_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    copies = docs.where("doc_id % 4 = 0").select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.concat("source", F.lit("b")).alias("source"))
    hot = spark.range(90).select((F.col("id") + 20_000).alias("doc_id"), F.lit("one text").alias("text"), F.concat(F.lit("l"), F.col("id") % 5).alias("lang"), F.when(F.col("id") % 3 > 0, F.lit("s")).alias("source"))
    empty = spark.createDataFrame([(30_000, None, "a", "b"), (30_001, "", None, None), (None, "one text", "q", "q")], docs.schema)
    whole = docs.union(copies).union(hot).union(empty)
    got = sharding.assign(whole, part_rows=part_rows).collect()
    text = {r.doc_id: r.text or "" for r in whole.collect()}
    assert sorted(r.rank for r in got) == list(range(whole.count()))
    sizes = [sum(r.shard == k for r in got) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
    places = {}
    for r in got:
        places.setdefault(text[r.doc_id], []).append(r)
    assert len([p for p in places.values() if len(p) > 1]) > 40
    for own in places.values():
        assert max(r.rank for r in own) - min(r.rank for r in own) == len(own) - 1  # neighbours on the curve
    assert sum(len({r.shard for r in own}) > 1 for own in places.values()) <= 15


def test_tasks_work_on_slices_of_large_batches():
    import pyarrow as pa

    from plumbline.llm import common

    large = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["x"]) for n in (2 * common.SLICE + 1, 0, 5)]
    got = list(common.in_slices(iter(large)))
    assert max(b.num_rows for b in got) <= common.SLICE
    assert [x for b in got for x in b.column(0).to_pylist()] == [*range(2 * common.SLICE + 1), *range(5)]


def test_clean_documents_are_found_and_judged_by_one_worker(spark):
    from plumbline.llm import decontaminate

    bench = spark.createDataFrame([("i", " ".join(f"w{i}" for i in range(13))), ("k", "one two three")], "item_id string, text string")
    rows = [(1, "x " * 400 + "one two three", "a"), (2, "x one two three", "b"), (3, None, "c"), (4, " ".join(f"w{i}" for i in range(14)), "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit_words string")
    for most in (100_000, 1):
        out = decontaminate.clean(docs, bench, max_windows=most)
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
