"""Periodic runs of words by Main-Lorentz divide and conquer, and texts with their repeats collapsed.

Words `[^\\x20\\x09-\\x0D]+` of a text are interned as numbers. A run is a stretch of words in which words `period`
apart are identical, of the smallest such period, at least `least` words and `times` periods long, that neither
neighbour extends. runs() finds them all:

* A word in such a run occurs `times` times in it. Words that occur less often in their stretch are dropped and split
  the text into stretches, until none goes (or after ROUNDS rounds: what stays is more work, not another result). Prose
  has few stretches left.
* A stretch is halved again and again. At each midpoint, Z-functions of the right half and of the reversed left half
  give for each period how far words agree that far apart, to both sides; where both together reach a whole period, a
  repetition crosses the midpoint. It is extended by these lengths to its full interval. A run lies whole in the first
  part whose midpoint it crosses, so one that goes on beyond its part was found there already and is passed over.
* Equal intervals are kept once, with the smallest period: by Fine and Wilf's theorem the others are its multiples.

O(n log n) for a stretch of n words, on numbers; nothing is shuffled, and memory is bounded by one batch of texts.

Nulls, empties, ties: a null or empty text has no words and no run; of runs of equal length the one with the smallest
start, then the smallest period, is reported; repeated rows have each their own result; a null doc_id never changes
a text in digests(); other columns are ignored by digests() and runs_of(), and kept by collapse(); an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 6
TIMES = 4
ROUNDS = 8
RUN = "doc_id long, start long, length long, period long"
RESULT = "doc_id long, n long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_kept long"


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() splits at just the six characters of the rule."""
    return (text or "").encode().split()


def interned(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def z_function(s: list[int], limit: int) -> list[int]:
    """How many values from each of the first `limit` places agree with the beginning of s."""
    n, z, lo, hi = len(s), [0] * limit, 0, 0
    if limit:
        z[0] = n
    for i in range(1, limit):
        k = min(z[i - lo], hi - i) if i < hi else 0
        if i + k >= hi:
            while i + k < n and s[i + k] == s[k]:
                k += 1
            lo, hi = i, i + k
        z[i] = k
    return z


def z_match(pattern: list[int], z: list[int], text: list[int], limit: int) -> list[int]:
    """How many values from each of the first `limit` places of text agree with the beginning of pattern; z: its z_function."""
    n, m, out, lo, hi = len(text), len(pattern), [0] * limit, 0, 0
    for i in range(limit):
        k = min(z[i - lo], hi - i) if i < hi else 0
        if i + k >= hi:
            while k < m and i + k < n and text[i + k] == pattern[k]:
                k += 1
            lo, hi = i, i + k
        out[i] = k
    return out


def crossing(s: list[int], lo: int, mid: int, hi: int, times: int):
    """(start, end, period) of the repetitions in s[lo:hi] at its middle, of `times` periods, 2 or more. With most = (hi -
    lo) // times periods to try, both halves have more values than that."""
    most = (hi - lo) // times
    right, left = s[mid:hi], s[lo:mid][::-1]
    zr, zl = z_function(right, most + 1), z_function(left, most + 1)
    # what follows mid + p against what follows mid; what precedes mid + p against what precedes mid
    back = z_match(left, zl, s[lo : mid + most][::-1], most)
    for p in range(1, most + 1):
        before, after = back[most - p], zr[p]
        if before + after >= (times - 1) * p:
            yield mid - before, mid + p + after, p
    # the same for mid - p
    forth = z_match(right, zr, s[mid - most : hi], most)
    for p in range(1, most + 1):
        before, after = zl[p], forth[most - p]
        if before + after >= (times - 1) * p:
            yield mid - p - before, mid + after, p


def stretches(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """The parts of a text, as (first, end), that words of fewer than `times` in their part don't interrupt."""
    key, kept = ids, np.arange(len(ids))
    part = np.zeros(len(ids), dtype=np.int64)
    for _ in range(ROUNDS):
        often = np.bincount(key)[key] >= times if len(key) else np.zeros(0, dtype=bool)
        if often.all():
            break
        kept = kept[often]
        part = np.cumsum(np.diff(kept, prepend=-2) != 1) - 1
        long = np.bincount(part)[part] >= least if len(part) else np.zeros(0, dtype=bool)
        kept, part = kept[long], part[long]
        key = np.unique(part * len(ids) + ids[kept], return_inverse=True)[1]
    if not len(kept):
        return []
    first = np.flatnonzero(np.diff(kept, prepend=-2) != 1)
    return list(zip(kept[first].tolist(), (kept[np.append(first[1:], len(kept)) - 1] + 1).tolist()))


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if times < 2 or least < times:
        raise ValueError("a run needs two periods or more, and a word for each")
    s, found = ids.tolist(), {}
    todo = [x for x in stretches(ids, least, times) if x[1] - x[0] >= least]
    while todo:
        lo, hi = todo.pop()
        mid = (lo + hi) // 2
        for i, j, p in crossing(s, lo, mid, hi, times):
            beyond = (i == lo > 0 and s[i - 1] == s[i - 1 + p]) or (j == hi < len(s) and s[j] == s[j - p])
            if j - i >= least and not beyond and found.get((i, j), p) >= p:
                found[i, j] = p
        todo += [x for x in ((lo, mid), (mid, hi)) if x[1] - x[0] >= least]
    return sorted((i, j - i, p) for (i, j), p in found.items())


def dropped(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for i, length, p in found:
        change[i + p] += 1
        change[i + length] -= 1
    return np.cumsum(change)[:n] > 0


def planted(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The numbers of the original words that stand in a document's text, in order: in one document of ten, chosen by
    doc_id alone, the words from some place on are repeats of those that begin there."""
    at = np.arange(len(ids))
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not len(ids):
        return at
    g = h // 10
    a = g % len(ids)
    p = 1 + (len(ids) - a) // (3 + g % 8)
    return np.where(at < a, at, a + (at - a) % p)


def frame(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def digests(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per document its number of words and runs, its longest run, and digests of all runs and of the kept words, after
    planted() repeats. docs: doc_id, text."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                at = planted(words, doc_id)
                ids = interned(words)[at]
                found = runs(ids, least, times)
                best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                kept = at[~dropped(len(ids), found)].tolist()
                lines = "".join(f"{i},{n},{p}\n" for i, n, p in found).encode()
                whole = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                rows.append((doc_id, len(words), len(found), *whole, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(words[i] for i in kept)).hexdigest(), len(kept)))
            yield frame(rows, RESULT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def runs_of(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, start, length, period: a row for each run. docs: doc_id, text."""

    def run(batches):
        for batch in batches:
            yield frame([(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in runs(interned(words_of(t)), least, times)], RUN)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RUN)


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs, each run of a text cut down to its first period. A text with a run becomes its kept words, joined by one
    space; others, and null, stay as they are."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(texts):
                words = words_of(text)
                if found := runs(interned(words), least, times):
                    texts[i] = b" ".join(words[k] for k in np.flatnonzero(~dropped(len(words), found))).decode()
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
