"""Substring dedup with a log-structured fingerprint index.

The index holds sorted immutable runs: tables of the window groups (see repeats) of the batches indexed so
far, each group once, with the first place it stands at. A run is bucketed by its anchors and sorted in
each bucket, so a new batch, whose own run is written first, is merge-joined with each run bucket by
bucket: the history is read where it lies, and never shuffled. Groups whose anchors meet are verified by
128-bit digests of the words they cover, and, where a group isn't equal as a whole, window by window on
the texts. When a batch meets `max_runs` runs, these are compacted first: merge-joined into one, each
group with its first place. What an index folder holds can be opened again by a later session.

A word is removed if a window of `width` words covers it whose word sequence also starts earlier: in
an indexed document, in a document of the batch with a smaller doc_id, or further up in its own.
Windows are judged on the input. Batches must come in ascending doc_id for the whole to equal one run
over all rows.

Hot keys: the places of a group are reduced to the first by partial aggregations before anything moves, so
a bucket holds a group once, however often it stands in the corpus.

Nulls, empties, ties: a null text has no words; a text of fewer words than a window keeps them all;
rows of one doc_id and text are neither earlier than the other, so both keep their words; a null
doc_id is not indexed and keeps all; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import configured, delete, free, materialize, read_text, scratch, shuffles_dropped, temporary, write_text

WIDTH = 20
GRAM = 6


#: For the scans of runs: each bucket is one sorted file, Spark may rely on that, and rows of equal keys share a bucket.
SORTED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
FIRST = ["doc_id", "start", "tkey", "n"]


class FingerprintIndex:
    """Runs of the window groups of the documents seen; `texts` gives the text of any indexed document.

    path: its folder, by default one of this application under the shared folder. A folder that holds an index is
    opened as it was left."""

    def __init__(self, spark: SparkSession, texts: DataFrame, width: int = WIDTH, k: int = GRAM, max_runs: int = 4, path: str | None = None, anchor_bits: int = 64):
        self.spark, self.texts, self.max_runs = spark, texts, max_runs
        self.path = path or scratch(spark, "index")
        self.state = {"width": width, "k": k, "anchor_bits": anchor_bits, "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": [], "version": 0}
        found = read_text(spark, f"{self.path}/manifest")
        if found:
            self.state = json.loads(found)

    @property
    def runs(self) -> list[str]:
        return self.state["runs"]

    def run(self, name: str) -> DataFrame:
        """A run as a table that Spark knows to be bucketed and sorted."""
        keys, n = ", ".join(repeats.KEY), self.state["buckets"]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{name}` (anchor long, c1 long, c2 long, doc_id long, start int, tkey long, n int, same long) USING parquet "
            f"CLUSTERED BY (anchor) SORTED BY ({keys}) INTO {n} BUCKETS LOCATION '{self.path}/{name}'"
        )
        return self.spark.table(name)

    def write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            rows.write.bucketBy(self.state["buckets"], "anchor").sortBy(*repeats.KEY).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def commit(self, runs: list[str]) -> None:
        """The new list of runs; runs that aren't on it any more go."""
        old = set(self.runs) - set(runs)
        self.state |= {"runs": runs, "version": self.state["version"] + 1}
        write_text(self.spark, f"{self.path}/manifest", json.dumps(self.state))
        for name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            delete(self.spark, f"{self.path}/{name}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Index the batch (doc_id, text); the runs of its windows that stand earlier, by document."""
        with temporary(self.spark):
            return self._add(batch)

    def _add(self, batch: DataFrame) -> DataFrame:
        width, k = self.state["width"], self.state["k"]
        if len(self.runs) >= self.max_runs:
            self.compact()
        places = materialize(repeats.find_segments(batch, repeats.word_tokens, width, k, self.state["anchor_bits"]), "places")
        first = F.min(F.struct(*FIRST)).alias("first")
        groups = places.groupBy(*repeats.KEY).agg(first, F.count("*").alias("same")).select(*repeats.KEY, "first.*", "same")
        own = self.write(groups.repartition(self.state["buckets"], "anchor"))
        with configured(self.spark, SORTED):
            known = self.known(self.run(own))
            groups, met = self.meet(self.run(own), known)
        repeated = groups.where("same > 1 or seen")
        # a group that stands once in the batch is where its own row says; the others are looked up
        once = repeated.where("same = 1").select("doc_id", "tkey", "start", "n")
        marks = repeated.where("same > 1").select(*repeats.KEY, "seen", F.col("doc_id").alias("first_doc"), F.col("start").alias("first_start"))
        often = places.join(marks, repeats.KEY).where("seen or doc_id <> first_doc or start <> first_start").select("doc_id", "tkey", "start", "n")
        # groups of one anchor, not equal as a whole, are compared by window
        refine = groups.where("mixed and not seen").select("doc_id", "tkey", "start", "n", F.lit(True).alias("new"))
        if met is not None:
            refine = refine.unionByName(met.select("doc_id", "tkey", "start", "n", F.lit(False).alias("new")))
        found = repeats.with_text(self.texts, refine)
        single = repeats.repeated_windows(repeats.window_rows(found, repeats.word_tokens, width), keep_first=True)
        lists = materialize(repeats.run_lists(once, often, single), "lists", keep=True)
        self.commit([*self.runs, own])
        return lists

    def known(self, own: DataFrame) -> DataFrame | None:
        """The groups of all runs that have an anchor of the batch, each with its first place."""
        if not self.runs:
            return None
        met = [materialize(self.merged(self.run(name), own), "met") for name in self.runs]
        if len(met) == 1:
            return met[0]
        return materialize(reduce(DataFrame.unionByName, met).groupBy(*repeats.KEY).agg(F.min(F.struct(*FIRST)).alias("first")).select(*repeats.KEY, "first.*"), "met")

    @staticmethod
    def merged(run: DataFrame, own: DataFrame) -> DataFrame:
        """The groups of a run whose anchors the batch has: a merge join of two sorted runs, bucket by bucket."""
        return run.join(own.select("anchor").hint("merge"), "anchor", "left_semi").drop("same")

    @staticmethod
    def meet(own: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """(the batch's groups whose anchors occur more than once, with `seen`: also in the index, and `mixed`: the anchor
        has other groups; the index's groups of mixed anchors)."""
        anchors = own.groupBy("anchor").agg(F.sum("same").alias("total"), F.count("*").alias("groups"))
        if known is None:
            rows = own.join(anchors.where("total > 1").hint("merge"), "anchor")
            return materialize(rows.select(*own.columns, F.lit(False).alias("seen"), (F.col("groups") > 1).alias("mixed")), "groups"), None
        anchors = anchors.join(known.groupBy("anchor").agg(F.count("*").alias("old")), "anchor", "left").where("total > 1 or old > 0")
        rows = own.join(anchors.hint("merge"), "anchor").join(known.select(*repeats.KEY, F.lit(True).alias("seen")).hint("merge"), repeats.KEY, "left")
        seen = F.coalesce("seen", F.lit(False))
        both = F.col("groups") + F.coalesce("old", F.lit(0))
        rows = materialize(rows.select(*own.columns, seen.alias("seen"), ((both > 2) | ((both == 2) & ~seen)).alias("mixed")), "groups")
        mixed = rows.where("mixed and not seen").select("anchor").distinct()
        return rows, known.join(mixed, "anchor", "left_semi")

    def compact(self) -> None:
        """All runs merge-joined into one, two at a time, each group with its first place."""
        runs = list(self.runs)
        while len(runs) > 1:
            with configured(self.spark, SORTED):
                name = self.write(self.united(self.run(runs[0]), self.run(runs[1])))
            runs = [name, *runs[2:]]
        self.commit(runs)


    @staticmethod
    def united(a: DataFrame, b: DataFrame) -> DataFrame:
        x, y = (t.select(*repeats.KEY, F.struct(*FIRST).alias(c)) for t, c in ((a, "x"), (b, "y")))
        both = x.hint("merge").join(y, repeats.KEY, "full_outer").select(*repeats.KEY, F.least("x", "y").alias("first"))
        return both.select(*repeats.KEY, "first.*", F.lit(1).cast("long").alias("same"))

    def discard(self) -> None:
        """Delete the index with all its runs."""
        self.commit([])
        delete(self.spark, self.path)


def removed(docs: DataFrame, width: int = WIDTH, k: int = GRAM, batches: int = 3, max_runs: int = 2) -> DataFrame:
    """doc_id, tkey, runs of repeated windows, for all documents, indexed in batches of ascending doc_id."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "index")
    out = None
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        seen = docs if hi is None else docs.where(F.col("doc_id") <= hi)
        part = seen if lo is None else seen.where(F.col("doc_id") > lo)
        # opened from its folder for each batch, as a later session would
        index = FingerprintIndex(spark, seen, width, k, max_runs, path)
        found = index.add(part)
        out = found if out is None else out.unionByName(found)
    index.discard()
    return out


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def dedup(docs: DataFrame, width: int = WIDTH, k: int = GRAM, batches: int = 3) -> DataFrame:
    """A row per document: its words, how many go, and the SHA-256 of the kept ones joined by a space."""

    def run(batches_: Iterator[pa.RecordBatch]):
        for batch in batches_:
            rows = []
            for doc_id, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), repeats.run_arrays(batch.column(2))):
                words = text.encode().split() if text else []
                kept = [w for w, g in zip(words, repeats.covered(len(words), runs, width).tolist()) if not g] if runs else words
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            ids, n, r, sha = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeats.keyed(docs).join(removed(docs, width, k, batches), ["doc_id", "tkey"], "left").select("doc_id", "text", "runs").mapInArrow(run, RESULT)


def cut(docs: DataFrame, width: int = WIDTH, k: int = GRAM, batches: int = 3) -> DataFrame:
    """docs with the repeated words taken out of the texts (n_chars follows); a text of which nothing is left is empty."""

    def run(batches_: Iterator[pa.RecordBatch]):
        for batch in batches_:
            texts = []
            for text, own in zip(batch.column("text").to_pylist(), repeats.run_arrays(batch.column(batch.num_columns - 1))):
                if text and own:
                    words = text.encode().split()
                    gone = repeats.covered(len(words), own, width).tolist()
                    text = b" ".join(w for w, g in zip(words, gone) if not g).decode()
                texts.append(text)
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])], batch.schema.names[:-1])

    owner, key, runs = (free(x, docs) for x in ("owner", "tkey", "runs"))
    lists = removed(docs, width, k, batches).toDF(owner, key, runs)
    out = docs.join(lists, (docs["doc_id"].cast("long") == F.col(owner)) & (F.xxhash64(docs["text"]) == F.col(key)), "left").select(*docs.columns, runs)
    out = out.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
