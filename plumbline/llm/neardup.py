"""MinHash near-dedup with an LSH forest.

A document is the set of its distinct 5-word shingles. `TREES` sorted orders are built from one MinHash
signature: tree t sorts all documents by the signature read from position t * STRIDE on, round its
end, as bytes behind the first full value. In each order, neighbours with a common prefix are
candidates, to a depth that adapts to the region: a region of documents that share the first value is
taken whole if it has at most `region` members, and else is split at the next value, and so on; the
neighbours on both sides of a split stay candidates. The orders are range-partitioned sorts, so a value
that a third of all documents share is spread over tasks by the values behind it.

Equal sets are one class and stand in the orders once. Within a region the likeness of each two
signatures is estimated in the task, and only the edges of a maximum spanning forest are emitted: not
all pairs of a group. All emitted links are confirmed on the full sets. Where a link of the forest
fails, the documents around it are looked at again: they go through the orders with their sets, and all
candidate pairs across the components found so far are compared on those sets in the task, so that only
pairs near the bound are emitted, to be confirmed like the others. No candidate is capped.

Splitting a region parts pairs that no other tree may bring together: in a large group around one text a
copy may be linked to that text alone. Such a pair shares first values of split regions only. So the
documents with SHARED such values or more are looked at once more, by a prefix filter on DRAWN values of
their signatures: a document goes on if AGREEING of them stand in other components too, and meets those
with which it shares one of the rarest of these. A line that very many documents hold brings few together,
since it isn't among the rarest; what is left are groups of near copies. Each two documents of a group, of
different components and of sizes that allow a link, are compared on their full sets, in blocks whose
shared shingles are counted by a matrix product. That costs the square of such a group in products; the
documents before it cost DRAWN rows each.

A pair of likeness 0.75 agrees in the first value of a tree with probability 0.75; all 16 trees miss
with 2e-10, at depth 3 with 1.5e-4; the prefix filter misses with 1.2e-5.

Nulls, empties, ties: null or empty texts have no shingles and link with nothing; fewer than five words
are one shingle; a group keeps its smallest doc_id; a null doc_id is its own, with a null component;
repeated rows have the same component; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, Rolling, in_slices, materialize, mix, ragged, temporary
from .components import components
from .repeats import word_hashes

WORDS = 5
LIKENESS = 75  # percent
TREES, STRIDE = 16, 8
VALUES = TREES * STRIDE
REGION = 256
#: A pair of likeness 0.75 shares fewer first values of the 16 trees with 3.8e-6.
SHARED = 4
#: It agrees in fewer of so many values of the signature with 8e-6.
DRAWN, AGREEING = 32, 13
#: A pair is dropped unseen only if its estimate lies four, in the second round three, deviations under the bound.
FLOOR, SECOND_FLOOR = 0.60, 0.64

_A = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(BASE)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, VALUES + 1001, dtype=np.uint64) * np.uint64(BASE)).astype(np.uint32)


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles, A-Z lowered."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    rolling = Rolling(word_hashes(words))
    if len(words) < k:
        return rolling.spans(np.array([0]), np.array([len(words)]))
    return np.unique(rolling.grams(k))


def signature(grams: np.ndarray) -> np.ndarray:
    """The least of each of VALUES random orders over the set."""
    high = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(high), 2048):
        out = np.minimum(out, ((high[None, lo : lo + 2048] ^ _B[:, None]) * _A[:, None]).min(axis=1))
    return out


SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, firsts binary, rest binary"


def sign(docs: DataFrame) -> DataFrame:
    """n_shingles, the 128-bit key of the set and its signature: first values in full, all as bytes."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in in_slices(batches):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = shingles(text)
                if not len(own):
                    rows.append((doc_id, 0, None, None, None, None))
                    continue
                key = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64)
                values = signature(own)
                rows.append((doc_id, len(own), int(key[0]), int(key[1]), values[::STRIDE].astype(">u4").tobytes(), (values & 0xFF).astype(np.uint8).tobytes()))
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], SIGNED.replace(" long", "").replace(" binary", "").split(", "))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNED)


PREFIX = 5  # of a key: the tree and its first value
#: Rows of an order that a task holds before it works off whole runs of them.
AT_ONCE = 20_000
PAIR = "a long, b long"


def estimates(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Likeness of signatures by their bytes; unequal values have equal bytes once in 256."""
    same = (rows[i] == rows[j]).mean(axis=1)
    return (same - 1 / 256) / (1 - 1 / 256)


def regions(lcp: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of a sorted order whose members share a prefix: as short a one as leaves at most
    `most` members. lcp[i]: common bytes of i and i + 1. Where even whole keys are equal in more
    members, overlapping runs."""
    ends = np.append(np.flatnonzero(lcp < PREFIX + 1) + 1, len(lcp) + 1)
    stack = [(int(a), int(b), 1) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends) if b - a > 2]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo <= most:
            yield lo, hi
        elif depth >= VALUES:
            for at in range(lo, hi, most // 2):
                yield at, min(hi, at + most)
        else:
            cut = lo + np.flatnonzero(lcp[lo : hi - 1] < PREFIX + depth + 1) + 1
            stack += [(int(a), int(b), depth + 1) for a, b in zip(np.concatenate([[lo], cut]), np.append(cut, hi)) if b - a > 2]


def spanning(like: np.ndarray, floor: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over the pairs with likeness of floor or more."""
    m = len(like)
    left = np.ones(m, dtype=bool)
    best, via = np.full(m, -1.0), np.zeros(m, dtype=np.int64)
    out = []
    for _ in range(m):
        at = int(np.where(left, best, -2).argmax())
        if best[at] >= floor:
            out.append((int(via[at]), at))
        left[at] = False
        closer = like[at] > best
        best[closer] = like[at][closer]
        via[closer] = at
    return out


def gram_sets(docs: DataFrame, wanted: DataFrame, kind: type = np.uint32) -> DataFrame:
    """wanted (rep, k1, k2 and more) with `grams`: the hashes, or 32 bits of each, of the set that k1 and k2 name."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.select("rep").hint("merge"), "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for rep, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = shingles(text)
                key = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64)
                rows.append((rep, int(key[0]), int(key[1]), np.unique(own.astype(kind)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["rep", "k1", "k2", "grams"])

    sets = texts.mapInArrow(run, "rep long, k1 long, k2 long, grams binary").dropDuplicates(["rep", "k1", "k2"])
    return wanted.join(sets.hint("merge"), ["rep", "k1", "k2"])


def near(grams: pa.Array, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (x[i], y[i]) of sets come within a point of percent of their union."""
    sets: dict[int, set] = {}

    def own(i: int) -> set:
        if i not in sets:
            sets[i] = set(np.frombuffer(grams[i].as_py(), dtype=np.uint32).tolist())
        return sets[i]

    out = np.zeros(len(x), dtype=bool)
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        a, b = own(i), own(j)
        both = len(a & b)
        out[k] = 100 * both >= (percent - 1) * (len(a) + len(b) - both)
    return out


def candidates(reps: DataFrame, region: int, floor: float, labelled: bool = False, percent: int = LIKENESS) -> DataFrame:
    """Candidate pairs a < b of the forest over reps (rep, firsts, rest). labelled: reps also has a label
    and grams; then all candidate pairs of different labels whose sets are near, not a spanning forest."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")
    label = F.col("label") if labelled else F.lit(0).cast("long")
    key = F.expr(f"concat(substring(unhex('{''.join(f'{t:02x}' for t in range(TREES))}'), t + 1, 1), substring(firsts, 4 * t + 1, 4), substring(rest, {STRIDE} * t + 1, {VALUES}), substring(rest, 1, {STRIDE} * t))")
    more = ["grams"] if labelled else []
    order = reps.select("rep", label.alias("label"), "firsts", "rest", *more, trees).select(key.alias("key"), "rep", "label", *more)
    order = order.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")

    def run(batches: Iterator[pa.RecordBatch]):
        """Documents that share a tree's first value are neighbours: such runs are worked off as they come."""
        parts: list[tuple] = []
        rows = 0
        for batch in batches:
            parts.append((_fixed(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3) if labelled else None))
            rows += batch.num_rows
            if rows < AT_ONCE:
                continue
            keys = np.concatenate([p[0][:, : PREFIX] for p in parts])
            cut = int(np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)[-1])  # where the last run begins
            if cut:
                yield from links(parts, cut)
                whole = _joined(parts)
                parts = [tuple(None if c is None else c[cut:] if isinstance(c, np.ndarray) else c.slice(cut) for c in whole)]
                rows -= cut
        if parts:
            yield from links(parts, rows)

    def links(parts: list[tuple], hi: int) -> Iterator[pa.RecordBatch]:
        keys, ids, labels, sets = _joined(parts)
        keys, ids, labels = keys[:hi], ids[:hi], labels[:hi]
        if len(ids) < 2:
            return
        lcp = np.empty(len(ids) - 1, dtype=np.int64)
        for lo in range(0, len(lcp), 65536):
            hi = min(len(lcp), lo + 65536)
            differ = keys[lo + 1 : hi + 1] != keys[lo:hi]
            lcp[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), PREFIX + VALUES)
        rows = keys[:, PREFIX:]
        across = lcp >= PREFIX  # neighbours that share the first value at least
        found = []
        for lo, hi in regions(lcp, region):
            across[lo : hi - 1] = False  # the region's own edges link its neighbours
            own = lo + np.argsort(ids[lo:hi], kind="stable")
            like = np.empty((hi - lo, hi - lo))
            for at in range(hi - lo):
                like[at] = (rows[own] == rows[own[at]]).mean(axis=1)
            like = (like - 1 / 256) / (1 - 1 / 256)
            if labelled:
                x, y = np.nonzero(np.triu(like >= floor, 1) & (labels[own][:, None] != labels[own][None, :]))
                close = near(sets, own[x], own[y], percent)
                x, y = x[close], y[close]
            else:
                edges = spanning(like, floor)
                x, y = np.array(edges, dtype=np.int64).reshape(-1, 2).T
            if len(x):
                found.append(np.stack([ids[own[x]], ids[own[y]]], 1))
        i = np.flatnonzero(across)
        i = i[estimates(rows, i, i + 1) >= floor]
        if labelled:
            i = i[labels[i] != labels[i + 1]]
            i = i[near(sets, i, i + 1, percent)]
        pairs = np.concatenate([*found, np.stack([ids[i], ids[i + 1]], 1)])
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return order.mapInArrow(run, PAIR).distinct()


def split_members(reps: DataFrame, region: int) -> DataFrame | None:
    """rep of the documents that a link may have been lost of as their regions were split: those with SHARED or more
    first values that more than `region` documents have. A pair with a rarer value in common was in a whole region."""
    values = F.array(*(F.lit(t << 32) + F.conv(F.hex(F.substring("firsts", 4 * t + 1, 4)), 16, 10).cast("long") for t in range(TREES)))
    placed = reps.select("rep", F.explode(values).alias("at"))
    split = materialize(placed.groupBy("at").count().where(F.col("count") > region).select("at"), "split")
    if split.isEmpty():
        return None
    return placed.join(split, "at").groupBy("rep").agg(F.count("*").alias("hot")).where(F.col("hot") >= SHARED).select("rep")


VALUE_ROW = "rep long, label long, value long"


def value_rows(sets: DataFrame) -> DataFrame:
    """A row for each of DRAWN values of each set's signature, in full."""

    def run(batches: Iterator[pa.RecordBatch]):
        places = np.arange(DRAWN, dtype=np.int64) << 32
        for batch in batches:
            own = [places | signature(np.frombuffer(g, dtype=np.uint64))[:DRAWN] for g in batch.column(2).to_pylist()]
            if own:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(c.to_numpy(), DRAWN)) for c in batch.columns[:2]), pa.array(np.concatenate(own))], ["rep", "label", "value"])

    return sets.select("rep", "label", "grams").mapInArrow(run, VALUE_ROW)


def prefix_groups(sets: DataFrame) -> DataFrame:
    """rep, group for those of sets (rep, label, grams) that may be linked with one of another label.

    Values are ordered by the number of sets that have them. Two sets with AGREEING values in common share one of the
    first n - AGREEING + 1 of both, where n counts the values that other labels have too; a set with fewer of these
    is linked with no other label. Sets that share such a value are of one group."""
    rows = materialize(value_rows(sets), "values")
    counts = rows.groupBy("value").agg(F.count("*").alias("times"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    across = materialize(counts.where("lo <> hi").select("value", "times"), "across")
    own = rows.join(across, "value").groupBy("rep", "label").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("own"))
    first = own.where(F.size("own") >= AGREEING).select("rep", "label", F.explode(F.slice("own", F.lit(1), F.size("own") - (AGREEING - 1))).alias("x"))
    first = materialize(first.select("rep", "label", F.col("x.value").alias("value")), "prefixes")
    shared = first.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("value", "lo")
    met = materialize(first.join(materialize(shared, "shared"), "value").select("rep", "label", "lo").distinct(), "met")
    joined = components(met.select("label", "lo").distinct(), "label", "lo")
    return met.select("rep", "label").distinct().join(joined, F.col("label") == F.col("node")).select("rep", F.col("component").alias("group"))


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets x[i], y[j] share."""
    tx, ty = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(tx, ty)
    places = []
    for sets, values in ((x, tx), (y, ty)):
        rows, ids = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(common, values)
        known = np.flatnonzero(common[np.minimum(ids, len(common) - 1)] == values) if len(common) else np.zeros(0, dtype=np.int64)
        by_id = known[np.argsort(ids[known], kind="stable")]
        places.append((rows[by_id], ids[by_id], np.bincount(ids[by_id], minlength=len(common))))
    (rx, ix, fx), (ry, iy, fy) = places
    out = np.zeros((len(x), len(y)), dtype=np.float32)  # counts under 2**24 are exact
    dense = 128 * fx * fy > out.size
    number = np.cumsum(dense) - 1
    for lo in range(0, int(dense.sum()), 512):
        sides = []
        for rows, ids, n in ((rx, ix, len(x)), (ry, iy, len(y))):
            of = dense[ids] & (number[ids] >= lo) & (number[ids] < lo + 512)
            side = np.zeros((n, 512), dtype=np.float32)
            side[rows[of], number[ids[of]] - lo] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    # the others as pairs of places
    start, each = np.cumsum(fy) - fy, fy[ix] * ~dense[ix]
    ends = np.cumsum(each)
    lo = 0
    while lo < len(ix):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 21), "right")))
        pairs = np.repeat(rx[lo:hi], each[lo:hi]) * len(y) + ry[ragged(start[ix[lo:hi]], each[lo:hi])]
        at, count = np.unique(pairs, return_counts=True)
        out.reshape(-1)[at] += count
        lo = hi
    return out


def joining(ok: np.ndarray, of_x: np.ndarray, of_y: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) of ok that join components as all of ok do; of_x and of_y are the components before."""
    now = np.concatenate([of_x, of_y])
    m, out = len(of_x), []
    for i in np.flatnonzero(ok.any(axis=1)).tolist():
        j = np.flatnonzero(ok[i])
        new, first = np.unique(now[m + j], return_index=True)
        apart = new != now[i]
        out += [(i, int(k)) for k in j[first[apart]]]
        if apart.any():
            now[np.isin(now, new[apart])] = now[i]
    return out


BLOCK, BLOCK_GRAMS = 2048, 1 << 20


def exact(members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the components of members (rep, k1, k2, label, n_shingles, grams, group) as all links
    within groups do. Sizes are dealt to classes so that linked sets are of one class or neighbouring ones."""
    size = F.floor(F.log("n_shingles") / math.log(100 / percent * 1.001)).cast("int")
    members = members.withColumn("size", size)
    big = members.groupBy("group", "size", "label").count().where(F.col("count") >= block // 2).select("group", "size", "label", F.col("label").alias("own"))
    dealt = materialize(members.join(big, ["group", "size", "label"], "left"), "sets")
    cells = dealt.groupBy("group", "size", "own").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n_shingles") / BLOCK_GRAMS)).cast("int").alias("parts"))
    cells = materialize(cells, "cells")
    name = F.concat_ws("/", F.col("group"), F.col("size"), F.coalesce(F.col("own").cast("string"), F.lit("-")), F.col("part"))
    rows = dealt.join(cells, dealt["group"].eqNullSafe(cells["group"]) & dealt["size"].eqNullSafe(cells["size"]) & dealt["own"].eqNullSafe(cells["own"]))
    rows = rows.select("rep", "label", "grams", dealt["group"], dealt["size"], dealt["own"], F.expr("pmod(xxhash64(rep, k1, k2), parts)").cast("int").alias("part")).select("rep", "label", "grams", name.alias("block"))
    blocks = cells.select("group", "size", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("group", "size", "own", name.alias("block"))
    x, y = blocks.toDF("group", "sx", "ox", "x"), blocks.toDF("group", "sy", "oy", "y")
    pairs = x.join(y, "group").where("(sy = sx + 1 or sy = sx and x <= y) and not coalesce(ox = oy, false)").select("x", "y")
    pairs = materialize(pairs, "blocks")
    sides = rows.join(pairs, F.col("block") == F.col("x")).withColumn("side", F.lit(0)).unionByName(rows.join(pairs.where("x <> y"), F.col("block") == F.col("y")).withColumn("side", F.lit(1)))

    def run(pdf):
        import pandas as pd

        parts = [pdf[pdf.side == 0], pdf[pdf.side == 1]]
        parts[1] = parts[1] if pdf.x.iloc[0] != pdf.y.iloc[0] else parts[0]
        found = []
        if len(parts[0]) and len(parts[1]):
            (sets_x, of_x, ids_x), (sets_y, of_y, ids_y) = (([np.frombuffer(g, dtype=np.uint64) for g in p.grams], p.label.to_numpy(), p.rep.to_numpy()) for p in parts)
            both = overlaps(sets_x, sets_y).astype(np.int64)
            sizes = np.array([len(s) for s in sets_x])[:, None] + np.array([len(s) for s in sets_y])[None, :]
            ok = (100 * both >= percent * (sizes - both)) & (of_x[:, None] != of_y[None, :])
            found = [(min(ids_x[i], ids_y[j]), max(ids_x[i], ids_y[j])) for i, j in joining(ok, of_x, of_y)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return sides.select("x", "y", "side", "rep", "label", "grams").groupBy("x", "y").applyInPandas(run, PAIR)


def _joined(parts: list[tuple]) -> tuple:
    arrays = (np.concatenate([p[i] for p in parts]) for i in range(3))
    grams = [p[3] for p in parts if p[3] is not None]
    return *arrays, pa.chunked_array([c for g in grams for c in (g.chunks if isinstance(g, pa.ChunkedArray) else [g])]) if grams else None


def _fixed(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, PREFIX + VALUES), dtype=np.uint8)


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = LIKENESS) -> DataFrame:
    """pairs (a, b) with ok: whether their full sets share percent of their union."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # sort-merge joins at every size: a broadcast below some size would not be the plan of a large corpus
    some = materialize(texts.join(ids.hint("merge"), "doc_id", "left_semi"), "texts")
    one, two = some.toDF("a", "text_a"), some.toDF("b", "text_b")

    def run(batches: Iterator[pa.RecordBatch]):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            ok = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                for doc_id, text in ((a, x), (b, y)):
                    if doc_id not in kept:
                        if len(kept) > 64:
                            kept.pop(next(iter(kept)))
                        kept[doc_id] = shingles(text)
                s, t = kept.get(a), kept.get(b)
                s = shingles(x) if s is None else s
                t = shingles(y) if t is None else t
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, ok boolean")


def cluster(docs: DataFrame, percent: int = LIKENESS, region: int = REGION) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per document. docs: doc_id, text."""
    with temporary(docs.sparkSession):
        return materialize(_cluster(docs, percent, region), "clusters", keep=True)


def _cluster(docs: DataFrame, percent: int, region: int) -> DataFrame:
    signed = materialize(sign(docs), "signatures")
    own = signed.where("k1 is not null and doc_id is not null")
    reps = own.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "firsts", "rest", "n_shingles")).alias("s")).select("k1", "k2", F.col("s.doc_id").alias("rep"), "s.firsts", "s.rest", "s.n_shingles")
    reps = materialize(reps, "classes")
    checked = materialize(confirm(materialize(candidates(reps, region, FLOOR, percent=percent), "pairs"), docs, percent), "links")
    links = checked.where("ok").select("a", "b")
    found = components(links)
    failed = checked.where("not ok")
    if not failed.isEmpty():
        found = materialize(found, "components")
        label = F.coalesce("component", "rep")
        labelled = reps.join(found, F.col("rep") == F.col("node"), "left").select("rep", "k1", "k2", "firsts", "rest", label.alias("label"))
        ends = failed.select(F.col("a").alias("rep")).union(failed.select("b"))
        touched = labelled.join(ends, "rep", "left_semi").select("label").distinct()
        around = materialize(labelled.join(touched, "label"), "around")
        again = materialize(gram_sets(docs, around), "sets")
        more = candidates(again, region, SECOND_FLOOR, labelled=True, percent=percent).join(checked.select("a", "b"), ["a", "b"], "left_anti")
        second = materialize(confirm(materialize(more, "pairs"), docs, percent), "links")
        links = links.union(second.where("ok").select("a", "b"))
        found = components(links)
    split = split_members(reps, region)
    if split is not None:
        found, split = materialize(found, "components"), materialize(split, "split")
        members = reps.join(split, "rep").join(found, F.col("rep") == F.col("node"), "left").select("rep", "k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("label"))
        members = materialize(gram_sets(docs, members, np.uint64), "members")
        groups = materialize(prefix_groups(members), "groups")
        if not groups.isEmpty():
            found = components(links.union(materialize(exact(members.join(groups, "rep"), percent), "links")))
    by_set = reps.select("k1", "k2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(by_set, ["k1", "k2"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = LIKENESS) -> DataFrame:
    """docs without all but the smallest doc_id of each group, all columns as they are."""
    gone = cluster(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
