"""Repeated windows: which windows of `width` tokens occur elsewhere, without moving every window.

1. Each window elects an anchor: its least k-gram hash (the first of equals). Equal windows elect
   equal anchors, and neighbouring windows mostly the same one, so a document becomes a short list of
   segments: (anchor, c1, c2, start, windows), where c1 and c2 are a 128-bit digest of all that the
   segment's windows cover.
2. Anchors that occur once are dropped: no window there is repeated. This is most of the text.
3. Segments of equal (anchor, c1, c2) form a class; all their windows are repeated. Its first segment, by
   (doc_id, start), stands for the class from here on.
4. Where an anchor has several classes, their first segments are compared window by window.

Anchors only bring together what may be equal; what is equal is told by 128-bit digests of the bytes
themselves, so anchors that collide cost time and no more.

Hot keys: 2 and 3 are aggregations with partial sums before the shuffle, followed by joins that Spark
splits where skewed; no task gathers a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTES, Rolling, in_slices, materialize, ragged, sliding_min

POSITION = np.uint64((1 << 28) - 1)
KEY = ["anchor", "c1", "c2"]
SEGMENT = "anchor long, c1 long, c2 long, doc_id long, tkey long, start int, n int"


@dataclass
class Tokens:
    """A text as tokens: their hashes, and the bytes they stand in, from ends[i] on for token i; `gap` bytes
    part a token from the next."""

    hashes: np.ndarray
    data: bytes
    places: np.ndarray
    gap: int

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two 64-bit halves of a digest of the bytes of each span of tokens."""
        lo, hi = self.places[start].tolist(), (self.places[end] - self.gap).tolist()
        data, digest = self.data, xxhash.xxh3_128_digest
        return np.frombuffer(b"".join([digest(data[x:y]) for x, y in zip(lo, hi)]), dtype=np.int64).reshape(-1, 2)


def byte_tokens(text: str | bytes | None) -> Tokens:
    data = text if isinstance(text, bytes) else (text or "").encode()
    return Tokens(BYTES[np.frombuffer(data, dtype=np.uint8)], data, np.arange(len(data) + 1), 0)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def word_tokens(text: str | None) -> Tokens:
    """Words between ASCII white space, unchanged."""
    words = text.encode().split() if text else []
    places = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=places[1:])
    return Tokens(word_hashes(words), b" ".join(words), places, 1)


def segments(tokens: Tokens, width: int, k: int, anchor_bits: int = 64) -> tuple[np.ndarray, ...] | None:
    """(anchor, c1, c2, start, windows) of each segment; None if the text has no window. anchor_bits: fewer make
    anchors collide, to test that nothing rests on them."""
    n = len(tokens.hashes) - width + 1
    if n <= 0:
        return None
    grams = Rolling(tokens.hashes).grams(k)
    if anchor_bits < 64:
        grams = grams & np.uint64(((1 << anchor_bits) - 1) << (64 - anchor_bits))
    least = sliding_min((grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64), width - k + 1)
    place = (least & POSITION).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    end = np.append(start[1:], n)
    digest = tokens.digests(start, end - 1 + width)
    return grams[place[start]].view(np.int64), digest[:, 0], digest[:, 1], start.astype(np.int32), (end - start).astype(np.int32)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, text: tkey tells rows of one doc_id apart by their text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")


def find_segments(docs: DataFrame, tokens_of: Callable[[str | None], Tokens], width: int, k: int, anchor_bits: int = 64) -> DataFrame:
    names = [*KEY, "doc_id", "tkey", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in in_slices(batches):
            parts: list[tuple] = []
            for doc_id, tkey, text in zip(*(c.to_pylist() for c in batch.columns)):
                if doc_id is not None and (found := segments(tokens_of(text), width, k, anchor_bits)):
                    parts.append((*found, doc_id, tkey))
            if parts:
                sizes = [len(p[0]) for p in parts]
                *key, start, n = (np.concatenate([p[i] for p in parts]) for i in range(5))
                ids = [np.repeat(np.array([p[i] for p in parts], dtype=np.int64), sizes) for i in (5, 6)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*key, *ids, start, n)], names)

    return keyed(docs).mapInArrow(run, SEGMENT)


def classify(segs: DataFrame, keep_first: bool, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """segs: SEGMENT, `new` and the columns of also. (runs, refine): runs of windows of new rows that are repeated as
    whole segments, and the first segments that must be compared by window, with the number of classes and also."""
    # sums are written before they are joined: Spark splits a skewed join only if both sides come straight from a shuffle
    often = materialize(segs.groupBy("anchor").agg(F.count("*").alias("total"), F.max("new").alias("any_new")).where("total > 1 and any_new").drop("any_new"), "often")
    some = materialize(segs.join(often, "anchor"), "segments")
    by = KEY
    classes = materialize(some.groupBy(*by).agg(F.count("*").alias("same"), F.min(F.struct("doc_id", "start")).alias("first")), "classes")
    mixed = materialize(classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1"), "mixed")
    joined = some.join(classes.where("same > 1"), by, "left")
    is_first = F.col("first").isNull() | ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") == F.col("first.start")))
    repeated = ~is_first if keep_first else F.col("first").isNotNull()
    state = materialize(
        joined.select("anchor", "doc_id", "tkey", "start", "n", "new", is_first.alias("rep"), repeated.alias("repeated"), (F.coalesce("same", F.lit(1)) < F.col("total")).alias("mixed"), *also),
        "states",
    )
    runs = state.where("repeated and new").select("doc_id", "tkey", "start", "n")
    refine = state.where("rep and mixed").join(mixed, "anchor").select("anchor", "doc_id", "tkey", "start", "n", "new", "classes", *also)
    return runs, refine


def with_text(docs: DataFrame, refine: DataFrame) -> DataFrame:
    """The documents that have segments to refine, each with the list of them."""
    lists = refine.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start", "n", "new")).alias("segs"))
    return keyed(docs).join(lists, ["doc_id", "tkey"])


WINDOW = ["h1", "h2"]
WINDOW_ROW = "h1 long, h2 long, doc_id long, tkey long, start int, new boolean"
WINDOW_NAMES = [*WINDOW, "doc_id", "tkey", "start", "new"]


def lists_of(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Where the list of each row begins in the arrays of its structs' fields, with one end more; then those arrays."""
    values = column.values
    return column.offsets.to_numpy(), *(values.field(n).to_numpy(zero_copy_only=False) for n in names)


#: Rows of windows that are handed over at a time.
WINDOWS_AT_ONCE = 200_000


def window_rows(found: DataFrame, tokens_of: Callable[[str | None], Tokens], width: int) -> DataFrame:
    """A row per window of the listed segments, with the digest of what it covers. found: with_text()."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ends, starts, sizes, news = lists_of(batch.column(3), "start", "n", "new")
            parts: list[tuple] = []
            held = 0
            for i, (doc_id, tkey, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                start, n = starts[ends[i] : ends[i + 1]].astype(np.int64), sizes[ends[i] : ends[i + 1]]
                at = ragged(start, n)
                h = tokens_of(text).digests(at, at + width)
                parts.append((h[:, 0], h[:, 1], np.full(len(at), doc_id), np.full(len(at), tkey), at.astype(np.int32), np.repeat(news[ends[i] : ends[i + 1]], n)))
                held += len(at)
                if held > WINDOWS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], WINDOW_NAMES)
                    parts, held = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], WINDOW_NAMES)

    return found.select("doc_id", "tkey", "text", "segs").mapInArrow(run, WINDOW_ROW)


def repeated_windows(rows: DataFrame, keep_first: bool) -> DataFrame:
    """The new rows of WINDOW_ROW whose window stands elsewhere too, or (keep_first) earlier."""
    rows = materialize(rows, "windows")
    groups = rows.groupBy(*WINDOW).agg(F.count("*").alias("times"), *([F.min(F.struct("doc_id", "start")).alias("first")] if keep_first else [])).where("times > 1")
    groups = materialize(groups, "groups")
    out = rows.where("new").join(groups, WINDOW)
    if keep_first:
        out = out.where(F.struct("doc_id", "start") > F.col("first"))
    return out.select("doc_id", "tkey", "start", F.lit(1).alias("n"))


def run_lists(*runs: DataFrame) -> DataFrame:
    """doc_id, tkey and the list of its runs (start, n) of repeated windows."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def covered(n: int, runs: list | tuple[np.ndarray, np.ndarray] | None, width: int) -> np.ndarray:
    """Which of n tokens the windows of the runs cover; runs: (start, n) each, or the arrays of both."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if runs is not None and len(runs):
        start, size = runs if isinstance(runs, tuple) else (np.array([r[c] for r in runs], dtype=np.int64) for c in ("start", "n"))
        np.add.at(edge, start, 1)
        np.add.at(edge, start + size - 1 + width, -1)
    return np.cumsum(edge[:-1]) > 0


def run_arrays(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """The runs of each row, as covered() takes them; None where there are none."""
    ends, start, n = lists_of(column, "start", "n")
    for lo, hi in zip(ends[:-1], ends[1:]):
        yield (start[lo:hi], n[lo:hi]) if hi > lo else None
