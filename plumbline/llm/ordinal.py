"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades 0 .. K-1 are ordered; P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector for all
thresholds theta_0 < theta_1 < ...; the result is the expected grade, the severity. Features are
log(1 + count) of the words and beginnings of words that tell toxic from clean documents best.

Labels of more than two grades are learnt as they are. Labels of 0 and 1 say nothing of severity, so two
grades of toxic documents are made, by cross-fitting: training documents are dealt to two folds, each fold
fits toxic against clean, and a toxic document has grade 1 or 2 as the *other* fold's fit scores it under
or over the median of its fold. The upper threshold is thus learnt from a rule, not from human grades; only
toxic or clean can be held against the labels.

Training takes a bounded sample of labelled rows: at most `max_rows` documents, half of them toxic, by
the smallest hash of doc_id, weighted to the shares among all labels. All documents are scored, whole.

Nulls, empties, ties: a null or empty text has no features; null labels don't train; without labels
of both kinds severity is 0 for all; repeated rows are scored each by itself, and a doc_id labelled
twice trains on its worse label; of equally likely grades the lower is returned; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 6_000
FEATURES = 300
LEAST_DOCS = 3

#: ASCII letters and digits and all bytes of other characters make words.
TABLE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


#: A longer word also counts under its first so many bytes, marked by a caret.
STEMS = (5, 6, 7, 8)


def counts(text: str | None, only: dict[bytes, int] | None = None) -> Counter:
    """How often each word, and each beginning of a longer word, stands in the text; only: no others."""
    out: Counter = Counter()
    for w, n in Counter(text.lower().encode().translate(TABLE).split()).items() if text else ():
        for key in (w, *(b"^" + w[:k] for k in STEMS if len(w) > k)):
            if only is None or key in only:
                out[key] += n
    return out


@dataclass
class Model:
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """P(grade = k) for the rows of x."""
    below = 1 / (1 + np.exp(-np.clip(model.thresholds[None, :] - (x @ model.weights)[:, None], -500, 500)))
    edges = np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], axis=1)
    return np.diff(edges, axis=1)


def fit(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, penalty: float = 0.1, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient descent with adaptive steps on the weighted log-loss."""
    k = int(grade.max()) + 1
    weight = weight / weight.sum()
    shares = np.cumsum([weight[grade == g].sum() for g in range(k)])[:-1]
    first = np.log(shares / (1 - shares))
    params = np.concatenate([np.zeros(x.shape[1]), [first[0]], np.log(np.maximum(np.diff(first), 1e-3))])
    d, m, v = x.shape[1], np.zeros(len(params)), np.zeros(len(params))
    for step in range(1, steps + 1):
        w, gaps = params[:d], np.exp(params[d + 1 :])
        theta = params[d] + np.concatenate([[0], np.cumsum(gaps)])
        z = x @ w
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = (1 / (1 + np.exp(-np.clip(edge[grade + i] - z, -500, 500))) for i in (1, 0))
        p = np.maximum(hi - lo, 1e-12)
        up, down = weight * hi * (1 - hi) / p, weight * lo * (1 - lo) / p  # of -log p by the edges, negated
        by_theta = np.array([down[grade == j + 1].sum() - up[grade == j].sum() for j in range(k - 1)])
        grad = np.concatenate([x.T @ (up - down) + penalty * w / len(x), [by_theta.sum()], [by_theta[j + 1 :].sum() * gaps[j] for j in range(k - 2)]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return params[:d], params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, features: int = FEATURES) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("order", F.xxhash64(F.col("doc_id").cast("string")))
    total = known.agg(F.expr("count_if(toxic <= 0)"), F.expr("count_if(toxic > 0)")).first()
    if not (total[0] and total[1]):
        return Model()
    fold = F.pmod(F.xxhash64("order"), F.lit(2)).cast("int").alias("fold")
    side = lambda c: known.where(c).orderBy("order", "doc_id").limit(max_rows // 2)
    picked = side("toxic > 0").union(side("toxic <= 0")).select("doc_id", F.greatest("toxic", F.lit(0)).alias("grade"), fold)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # max_rows rows at most

    def words(batches):
        for batch in batches:
            rows = [(grade > 0, w) for text, grade in zip(*(batch.column(c).to_pylist() for c in ("text", "grade"))) for w in counts(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 2, (pa.bool_(), pa.binary()))], ["toxic", "word"])

    found = chosen.mapInArrow(words, "toxic boolean, word binary")
    n_bad, n_good = picked.agg(F.expr("count_if(grade > 0)"), F.expr("count_if(grade = 0)")).first()
    per_word = found.groupBy("word").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")).where(F.col("bad") + F.col("good") >= LEAST_DOCS)
    telling = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    ranked = per_word.orderBy(F.desc(F.abs(telling) * F.sqrt(F.col("bad") + F.col("good"))), "word").limit(features).collect()
    if not ranked:
        return Model()
    vocabulary = {bytes(r.word): i for i, r in enumerate(ranked)}

    def vectors(batches):
        for batch in batches:
            rows = []
            for text, grade, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "grade", "fold"))):
                found = counts(text, vocabulary)
                rows.append((grade, fold, [vocabulary[w] for w in found], list(found.values())))
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["grade", "fold", "at", "n"])

    rows = chosen.mapInArrow(vectors, "grade int, fold int, at array<int>, n array<int>").collect()  # max_rows sparse rows
    x = np.zeros((len(rows), len(vocabulary)))
    for i, r in enumerate(rows):
        x[i, r["at"]] = np.log1p(r["n"])
    label, folds = np.array([r.grade for r in rows], dtype=np.int64), np.array([r.fold for r in rows])
    toxic = label > 0
    if not len(rows) or toxic.all() or not toxic.any():
        return Model()
    weight = np.where(toxic, total[1] / toxic.sum(), total[0] / (~toxic).sum())
    grades = np.unique(label)
    grade = np.searchsorted(grades, label)
    if len(grades) == 2:
        for f in (0, 1):
            mine, other = toxic & (folds == f), folds != f
            if mine.any() and 0 < toxic[other].sum() < other.sum():
                seen = x[mine] @ fit(x[other], toxic[other].astype(np.int64), weight[other])[0]
                grade[mine] = 1 + (seen > np.median(seen))
        if not (grade == 1).any():
            grade = toxic.astype(np.int64)
    weights, thresholds = fit(x, grade, weight)
    return Model(vocabulary, weights, thresholds)


RESULT = "doc_id long, severity double, grade int, p_toxic double, toxic boolean"


def grade(docs: DataFrame, model: Model, bound: float = 0.5) -> DataFrame:
    """A row per document: expected grade, likeliest grade, P(grade > 0), and whether that is bound or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in batches:
            x = np.zeros((batch.num_rows, len(own.weights)))
            for i, text in enumerate(batch.column(1).to_pylist()):
                for w, n in counts(text, own.vocabulary).items():
                    x[i, own.vocabulary[w]] = np.log1p(n)
            p = probabilities(own, x)
            bad = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(bad), pa.array(bad >= bound)],
                ["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)
