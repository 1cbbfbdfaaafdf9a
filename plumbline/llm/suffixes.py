"""Suffix-array dedup: repeated byte strings by longest-previous-factor arrays.

A position of the corpus has an earlier match of `length` bytes if its longest previous factor is that
long: if, in suffix order, the previous or the next smaller position shares so many bytes with it. A match
that comes later is told by the previous and next larger one. factors() takes both from the suffix order.

At scale no single suffix array holds the corpus, so positions that may match are brought together first:
anchors elected by each `length`-byte window (see repeats) decide where windows can be equal at all.
Contexts that are equal as a whole, by 128-bit digests, are reduced to one. What stands around the ends of
shared passages is sent, as short contexts, to the task of its anchor, where the suffixes of all contexts
are sorted to depth `length`, byte by byte, and the factor arrays read off. An anchor with more than `most`
contexts would be an unbounded group for one suffix array: its contexts elect longer anchors, which fewer of
them share, and go through the same steps, again and again until no group is larger. Three quarters of what an
anchor lacks of `length` are added each time, so this ends, five rounds later at most (32, 308, 377, 395, 399,
400 bytes), with anchors that are whole windows. A context has a few longer anchors as a rule, far fewer than windows.

With keep_first, only later copies are removed (a previous factor of `length` bytes); without it,
every copy is, the first too (a previous or next factor). Matches never cross documents, overlaps
count, and strings are judged on the input.

Nulls, empties, ties: a null text is empty; a text shorter than `length` is kept whole; rows of one
doc_id and text count as copies of each other (with keep_first neither is the earlier one); a null
doc_id is not compared and keeps all its bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import in_slices, materialize, temporary

LENGTH = 400
GRAM = 32
MOST = 256


def ranks(data: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes of data in suffix order to depth `length`: equal ranks, equal `length` bytes.

    groups: a number for each position; suffixes of different groups are never equal. Suffixes that run
    out before that depth are all different. Prefix doubling over those not yet told apart."""
    n = len(data)
    depth = 8 if length > 8 and n else 1
    if depth == 8:
        padded = np.concatenate([data, np.zeros(7, dtype=np.uint8)]).astype(np.uint64)
        first = np.zeros(n, dtype=np.uint64)
        for i in range(8):
            first = (first << np.uint64(8)) | padded[i : i + n]
        order = np.argsort(first)
        step = np.concatenate([[False], np.diff(first[order]) != 0])
        ahead = np.empty(n, dtype=np.int64)
        ahead[order] = np.cumsum(step)
        key = groups.astype(np.int64) * n + ahead
    else:
        key = groups.astype(np.int64) * 256 + data
    out = _spread(np.unique(key, return_inverse=True)[1])
    active = np.arange(n)
    while depth < length:
        active = active[np.bincount(out, minlength=n)[out[active]] > 1]
        if not len(active):
            break
        step = min(depth, length - depth)
        ahead = active + step
        # a suffix that runs out sorts before the others, each by itself
        second = np.where(ahead < n, out[np.minimum(ahead, n - 1)] + n, n - 1 - active)
        both = out[active] * (2 * n) + second
        order = np.argsort(both)
        a, both = out[active][order], both[order]
        old = np.concatenate([[True], a[1:] != a[:-1]])
        new = np.concatenate([[True], both[1:] != both[:-1]])
        place = np.arange(len(active))
        # an old rank of m members has room for m new ones, since a rank is the number of positions below it
        out = out.copy()
        out[active[order]] = a + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
        depth += step
    return out


def _spread(rank: np.ndarray) -> np.ndarray:
    """The same order, with each rank the number of positions below it."""
    counts = np.bincount(rank)
    return (np.cumsum(counts) - counts)[rank]


def factors(rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous, next): whether a smaller, a larger position has the same `length` bytes. rank: ranks() to that depth;
    place: where each suffix stands in the corpus, copies of a row in one place.

    Suffixes that agree to the depth are neighbours in suffix order, and there in the order of their places; so the
    longest factor reaches the depth if the previous smaller position, the nearest before with a smaller place, has the
    same rank; the next smaller one never has. Larger positions are the same from the other side."""
    order = np.lexsort((place, rank))
    r, p = rank[order], place[order]
    at = np.arange(len(r))
    new = np.concatenate([[True], r[1:] != r[:-1]])[: len(r)]
    first = np.maximum.accumulate(np.where(new, at, 0))
    last = len(r) - 1 - np.maximum.accumulate(np.where(np.concatenate([new[1:], [True]])[: len(r)][::-1], at, 0))[::-1] if len(r) else at
    previous, following = np.empty(len(r), dtype=bool), np.empty(len(r), dtype=bool)
    previous[order], following[order] = p[first] < p, p[last] > p
    return previous, following


CONTEXT = "anchor long, doc_id long, tkey long, start int, n int, classes long, context binary"


def contexts(rows: DataFrame, refine: DataFrame, length: int) -> DataFrame:
    """The bytes that the windows of each segment of refine cover. rows: doc_id, tkey, origin, and data, the document's
    bytes from origin on; refine: repeats.classify() with origin."""

    def run(batches: Iterator[pa.RecordBatch]):
        names = ["anchor", "doc_id", "tkey", "start", "n", "classes", "context"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            out = []
            for doc_id, tkey, origin, data, segs in zip(*(c.to_pylist() for c in batch.columns)):
                for s in segs:
                    lo = s["start"] - origin
                    out.append((s["anchor"], doc_id, tkey, s["start"], s["n"], s["classes"], data[lo : lo + s["n"] - 1 + length]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names)

    by = ["doc_id", "tkey", "origin"]
    # copies of a row have the same segments: each of them is listed once
    lists = refine.groupBy(*by).agg(F.collect_set(F.struct("anchor", "start", "n", "classes")).alias("segs"))
    return rows.join(lists, by).select(*by, "data", "segs").mapInArrow(run, CONTEXT)


def finer(rows: DataFrame, length: int, k: int) -> DataFrame:
    """repeats.SEGMENT and origin, where its context begins, of the segments that anchors of k bytes make of each
    context. The anchor so far is part of the new one, so no group of segments is larger than its contexts' was."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in in_slices(batches):
            parts: list[tuple] = []
            for anchor, doc_id, tkey, start, context in zip(*(c.to_pylist() for c in batch.columns)):
                own, c1, c2, at, n = repeats.segments(repeats.byte_tokens(context), length, k)
                same = np.ones(len(at), dtype=np.int64)
                parts.append((own ^ anchor, c1, c2, same * doc_id, same * tkey, at + np.int32(start), n, np.full(len(at), start, dtype=np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], [*repeats.KEY, "doc_id", "tkey", "start", "n", "origin"])

    return rows.select("anchor", "doc_id", "tkey", "start", "context").mapInArrow(run, f"{repeats.SEGMENT}, origin int")


RUN = "doc_id long, tkey long, start int, n int"
#: Bytes of contexts whose suffixes are sorted at a time.
AT_ONCE = 2_000_000


def sorted_runs(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Runs of matched windows among the contexts of each anchor. rows: CONTEXT, at most `most` an anchor."""

    def settle(part: list[dict]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(r["context"] for r in part), dtype=np.uint8)
        sizes = np.array([len(r["context"]) for r in part], dtype=np.int64)
        n = np.array([r["n"] for r in part], dtype=np.int64)
        groups = np.repeat(np.unique([r["anchor"] for r in part], return_inverse=True)[1], sizes)
        rank = ranks(data, groups, length)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(part)), n)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        start = np.array([r["start"] for r in part], dtype=np.int64)[owner] + offset
        doc = np.array([r["doc_id"] for r in part], dtype=np.int64)[owner]
        by_place = np.lexsort((start, doc))
        place = np.empty(len(owner), dtype=np.int64)
        if keep_first:  # copies of a row are in one place
            steps = np.ones(len(owner), dtype=np.int64)
            steps[1:] = (np.diff(doc[by_place]) != 0) | (np.diff(start[by_place]) != 0)
            place[by_place] = np.cumsum(steps)
        else:
            place[by_place] = np.arange(len(owner))
        previous, following = factors(rank[begin[owner] + offset], place)
        hit = previous if keep_first else previous | following
        # runs end where a segment does
        firsts = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (owner[1:] == owner[:-1])]))
        lasts = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (owner[1:] == owner[:-1]), [False]]))
        own = owner[firsts]
        pick = lambda c: np.array([r[c] for r in part], dtype=np.int64)[own]
        return pick("doc_id"), pick("tkey"), start[firsts].astype(np.int32), (lasts - firsts + 1).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]):
        part: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if size > AT_ONCE and row["anchor"] != part[-1]["anchor"]:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in settle(part)], RUN_NAMES)
                    part, size = [], 0
                part.append(row)
                size += len(row["context"])
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in settle(part)], RUN_NAMES)

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, RUN)


RUN_NAMES = ["doc_id", "tkey", "start", "n"]


def removed(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, k: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, tkey, runs of windows to remove."""
    k = min(k, length)
    with temporary(docs.sparkSession):
        segs = materialize(repeats.find_segments(docs, repeats.byte_tokens, length, k), "anchors")
        whole, refine = repeats.classify(segs.withColumn("new", F.lit(True)), keep_first)
        runs, refine = [whole], refine.withColumn("origin", F.lit(0))
        rows = repeats.keyed(docs).select("doc_id", "tkey", F.lit(0).alias("origin"), F.col("text").cast("binary").alias("data"))
        while k < length:  # an anchor of a whole window has no two classes
            shown = materialize(contexts(rows, refine, length), "contexts")
            runs.append(sorted_runs(shown.where(F.col("classes") <= most), length, keep_first))
            large = shown.where(F.col("classes") > most)
            if large.isEmpty():
                break
            k = length - (length - k) // 4
            segs = materialize(finer(large, length, k), "anchors")
            whole, refine = repeats.classify(segs.withColumn("new", F.lit(True)), keep_first, ("origin",))
            runs.append(whole)
            rows = large.select("doc_id", "tkey", F.col("start").alias("origin"), F.col("context").alias("data"))
        return materialize(repeats.run_lists(*runs), "lists", keep=True)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, k: int = GRAM, most: int = MOST) -> DataFrame:
    """A row per document: bytes, removed bytes, removed runs, and the SHA-256 of the bytes kept."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for doc_id, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), repeats.run_arrays(batch.column(2))):
                data = (text or "").encode()
                gone = repeats.covered(len(data), runs, length) if runs else np.zeros(0, dtype=bool)
                spans = int((np.diff(gone.view(np.int8), prepend=0) == 1).sum())
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes() if spans else data
                rows.append((doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            ids, *ints, sha = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in ints), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    lists = removed(docs, length, keep_first, k, most)
    return repeats.keyed(docs).join(lists, ["doc_id", "tkey"], "left").select("doc_id", "text", "runs").mapInArrow(run, RESULT)
