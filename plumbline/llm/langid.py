"""Language ID by prediction by partial matching.

Each language has a variable-order byte context tree: counts of the byte that follows each context of
0 to ORDER bytes. A byte costs -log2 P bits, where P blends the orders with escape probabilities
(method C: a context with n followers of u kinds escapes with u / (n + u)) and leaves out, after an
escape, what the longer context has already ruled out, so that P sums to one over all 256 bytes. The
statistics are frozen, so code lengths are worked out once. The language with the least code length wins.

The trees are sparse: sorted keys of the contexts seen (what an escape from there costs) and of the
contexts and bytes seen (what coding the byte there saves against escaping), each with the languages that
have it. A text's code length is the sum of those entries over its substrings of up to ORDER + 1 bytes,
looked up in sorted order, whole. Their size is that of the training sample, whatever the alphabets.

Training takes a bounded sample: at most `per_lang` documents of each language, those with the
smallest hashes of doc_id, of at most `max_bytes` bytes each. Prediction sees the text alone.

Nulls, empties, ties: a null text, or one without a letter (Unicode category L), is `und` with score 0;
without training rows all is `und`; of equal code lengths the first language by name wins; documents whose
language is null never train; repeated rows are scored each by itself; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, in_slices, ragged

#: A context and its next byte are 32 bits.
ORDER = 3
PER_LANG = 250
MAX_BYTES = 20_000
LETTER = regex.compile(r"\p{L}")


@dataclass
class Entries:
    """Sorted keys, and for each the languages that have it, with a number of bits."""

    keys: np.ndarray
    ends: np.ndarray
    lang: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray]]) -> "Entries":
        """parts: (keys, bits) of each language."""
        keys = np.concatenate([np.zeros(0, dtype=np.uint32), *(k for k, _ in parts)])
        lang = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
        bits = np.concatenate([np.zeros(0), *(b for _, b in parts)])
        order = np.argsort(keys, kind="stable")
        known, start = np.unique(keys[order], return_index=True)
        return Entries(known, np.append(start, len(keys)), lang[order].astype(np.int32), bits[order])

    def total(self, found: np.ndarray, times: np.ndarray, langs: int) -> np.ndarray:
        """The bits of each language over the found keys (sorted), each so many times."""
        if not len(self.keys):
            return np.zeros(langs)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        hit = self.keys[at] == found
        at, times = at[hit], times[hit]
        n = self.ends[at + 1] - self.ends[at]
        rows = ragged(self.ends[at], n)
        return np.bincount(self.lang[rows], weights=self.bits[rows] * np.repeat(times, n), minlength=langs)


@dataclass
class Model:
    """For each order the costs of escapes by context and the savings by context and byte."""

    langs: list[str]
    escapes: list[Entries]
    savings: list[Entries]

    @property
    def order(self) -> int:
        return len(self.savings) - 1


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """All substrings of n bytes (4 at most) as numbers."""
    out = np.zeros(max(0, len(data) - n + 1), dtype=np.uint32)
    for i in range(n):
        out = (out << np.uint32(8)) | data[i : len(data) - n + 1 + i]
    return out


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _tree(texts: list[bytes], order: int) -> list[tuple[np.ndarray, ...]]:
    """For each order: contexts, escape bits, context and byte, savings of one language."""
    own = [np.frombuffer(x, dtype=np.uint8) for x in texts]
    out = []
    before, shorter = np.zeros(0, dtype=np.uint32), np.zeros(0)
    for o in range(order + 1):
        pairs, n = counted(np.concatenate([np.zeros(0, dtype=np.uint32), *(grams(x, o + 1) for x in own)]))
        context, start, kinds = np.unique(pairs >> np.uint32(8), return_index=True, return_counts=True)
        if not len(pairs):
            out.append((context, np.zeros(0), pairs, np.zeros(0)))
            before, shorter = pairs, np.zeros(0)
            continue
        group = np.repeat(np.arange(len(context)), kinds)
        total = np.add.reduceat(n, start)
        # the same byte after the context without its first byte; where there is none, each of 256 bytes alike
        less = shorter[np.searchsorted(before, pairs & np.uint32((1 << 8 * o) - 1))] if o else np.full(len(pairs), 1 / 256)
        rest = 1 - np.add.reduceat(less, start)
        whole = (kinds == 256) | (rest < 1e-12)  # nothing is left to escape to
        escape = np.where(whole, 0.0, -np.log2(kinds / (total + kinds) / np.where(whole, 1.0, rest)))
        p = n / np.where(whole, total, total + kinds)[group]
        out.append((context, escape, pairs, -np.log2(p) - escape[group] + np.log2(less)))
        before, shorter = pairs, p
    return out


def fit(texts: dict[str, list[bytes]], order: int = ORDER) -> Model:
    langs = sorted(texts)
    trees = [_tree(texts[lang], order) for lang in langs]
    escapes, savings = ([Entries.of([(t[o][i], t[o][i + 1]) for t in trees]) for o in range(order + 1)] for i in (0, 2))
    return Model(langs, escapes, savings)


def score(model: Model, text: bytes) -> np.ndarray:
    """Code length of the text in bits, for each language."""
    data = np.frombuffer(text, dtype=np.uint8)
    out = np.full(len(model.langs), 8.0 * len(data))  # of 256 bytes alike
    for o, (escapes, savings) in enumerate(zip(model.escapes, model.savings)):
        if len(data) <= o:
            break
        pairs, n = counted(grams(data, o + 1))
        out += savings.total(pairs, n, len(out))
        context = pairs >> np.uint32(8)
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        out += escapes.total(context[start], np.add.reduceat(n, start), len(out))
    return out


def predict(model: Model, text: str | None) -> tuple[str, float]:
    """(language, score): the share of the best language if code lengths counted by the root of the text's length."""
    if not model.langs or text is None or not LETTER.search(text):
        return "und", 0.0
    data = text.encode()
    bits = score(model, data)
    best = int(bits.argmin())
    gain = (bits - bits[best]) / max(1.0, len(data) ** 0.5)
    return model.langs[best], float(1.0 / np.exp2(-np.minimum(gain, 100)).sum())


def train(docs: DataFrame, per_lang: int = PER_LANG, max_bytes: int = MAX_BYTES, order: int = ORDER) -> Model:
    """Fit on a bounded sample of docs (doc_id, text, lang): at most per_lang rows of each language."""
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and octet_length(text) between 1 and %d" % max_bytes)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return Model([], [], [])
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2.0 * per_lang / n))))
    few = rows.withColumn("unit", unit).where(F.col("unit") < F.coalesce(F.try_element_at(share, "lang"), F.lit(0.0)))
    # about twice per_lang rows of each language; the smallest hashes of them are taken
    picked = few.orderBy("unit", "doc_id").limit(2 * per_lang * len(sizes)).collect()
    texts: dict[str, list[bytes]] = {}
    for r in picked:
        own = texts.setdefault(r.lang, [])
        if len(own) < per_lang:
            own.append(r.text.encode())
    return fit(texts, order)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, which have underscores behind their names where docs has such
    columns already; docs: text and whatever else, kept as it is."""
    spark = docs.sparkSession
    names = [free("lang_pred", docs), free("score", docs)]
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{names[0]}` string, `{names[1]}` double"

    def run(batches):
        own = sent.value
        for batch in in_slices(batches):
            found = [predict(own, x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [*batch.schema.names, *names],
            )

    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Those that may train: crc32 of doc_id as text, modulo 4, isn't 2."""
    return docs.where(~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
