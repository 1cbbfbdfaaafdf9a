"""Labels that resemble each other, merged; all of it by tasks on blocks of labels, whatever their number.

The likeness of two labels is the share of their characters in common blocks, longest first (difflib's ratio, the
earlier label first). Two labels are close if it is at least the third quartile of that of all pairs. In alphabetical
order, each label that no earlier one has taken takes all later ones that are close; the last to take a label keeps it.

The quartile is found by counting: labels are dealt into blocks, a task compares two blocks and passes on how often each
likeness occurs, and ranges of these counts have the exact quantile. No pair is kept. The takers are the first maximal
set of labels that aren't close to each other. They are found in rounds: of the first labels that are still open, a
task finds the takers among them; these, BATCH at most, are held against all later labels, block by block, and the next
round starts behind them. A taker takes a share of all labels, so rounds are few, and no close pair is kept either.
"""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import landing
from . import profile

BLOCK = 500
BATCH = 200
LABEL = "i long, v string, taker long"


def ranked(labels: DataFrame) -> DataFrame:
    """LABEL for distinct labels (v): numbered from 0 in order, by ranges and then within each, and landed."""
    cut = landing.land(labels.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "labels")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = cut.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1
    numbered = cut.join(F.broadcast(sizes), "part").select((F.col("before") + inside).cast("long").alias("i"), "v", F.lit(None).cast("long").alias("taker"))
    out = landing.land(numbered, "labels")
    landing.drop(cut)
    return out


def tasks(df: DataFrame, most: int) -> int:
    """How many tasks for work that its size in bytes doesn't tell."""
    return max(1, min(most, 4 * df.sparkSession.sparkContext.defaultParallelism))


def likeness_counts(labels: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """x, n: how many pairs of the k labels have each likeness. Each two blocks meet in one group of 2 * block labels."""
    blocks = -(-k // block)
    own = labels.select("i", "v", F.floor(F.col("i") / block).cast("int").alias("b"))
    first = own.select(F.col("b").alias("p"), F.explode(F.sequence("b", F.lit(blocks - 1))).alias("q"), F.lit(0).alias("side"), "i", "v")
    second = own.select(F.explode(F.sequence(F.lit(0), "b")).alias("p"), F.col("b").alias("q"), F.lit(1).alias("side"), "i", "v")

    def count(group):
        import pandas as pd

        a, b = (group[group["side"] == s].sort_values("i") for s in (0, 1))
        found: dict[float, int] = {}
        match = SequenceMatcher(None)
        for j, later in zip(b["i"], b["v"]):
            match.set_seq2(later)
            for i, earlier in zip(a["i"], a["v"]):
                if i >= j:
                    break
                match.set_seq1(earlier)
                x = match.ratio()
                found[x] = found.get(x, 0) + 1
        return pd.DataFrame({"x": list(found), "n": list(found.values())}).astype({"x": "float64", "n": "int64"})

    n = tasks(labels, blocks * (blocks + 1) // 2)
    each = first.unionByName(second).repartition(n, "p", "q").groupBy("p", "q").applyInPandas(count, "x double, n long")
    return each.groupBy("x").agg(F.sum("n").alias("n"))


def close(match: SequenceMatcher, earlier: str, bound: float) -> bool:
    """Whether the likeness reaches the bound; lengths, then counts of characters, often tell that it can't."""
    match.set_seq1(earlier)
    return match.real_quick_ratio() >= bound and match.quick_ratio() >= bound and match.ratio() >= bound


def takers(batch: DataFrame, bound: float) -> list[tuple[int, str]]:
    """Those of at most BATCH open labels that no earlier one of them takes."""

    def run(parts):
        import pandas as pd

        rows = sorted((i, v) for part in parts for i, v in zip(part["i"], part["v"]))
        match, free = SequenceMatcher(None), []
        for i, v in rows:
            match.set_seq2(v)
            if not any(close(match, w, bound) for _, w in free):
                free.append((i, v))
        yield pd.DataFrame(free, columns=["i", "v"])

    return [(r.i, r.v) for r in batch.select("i", "v").coalesce(1).mapInPandas(run, "i long, v string").collect()]


def taken(labels: DataFrame, free: list[tuple[int, str]], bound: float, n: int) -> DataFrame:
    """labels, with the last of these takers that takes each, if one does."""

    def run(parts):
        match = SequenceMatcher(None)
        last = sorted(free, reverse=True)
        for part in parts:
            found = []
            for j, v, own in zip(part["i"], part["v"], part["taker"]):
                match.set_seq2(v)
                found.append(next((i for i, w in last if i < j and close(match, w, bound)), own))
            part["taker"] = found
            yield part.astype({"taker": "Int64"})

    return labels.repartition(n).mapInPandas(run, LABEL)


def similar(labels: DataFrame, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """old, new for distinct labels (v): what each that is taken becomes."""
    known = ranked(labels)
    k = known.count()
    if k < 2:
        return known.select(F.col("v").alias("old"), F.col("v").alias("new")).limit(0)
    per = likeness_counts(known, k, block).select(F.lit(0).alias("i"), "x", "n")
    bound = profile.quantiles_by(per, [0.75])[0][0]
    n, done = tasks(known, -(-k // block)), -1
    while True:
        open_ = landing.land(known.where((F.col("taker").isNull()) & (F.col("i") > done)).orderBy("i").limit(batch), "open")
        last = open_.agg(F.max("i")).first()[0]
        if last is None:
            landing.drop(open_)
            break
        free = takers(open_, bound)
        landing.drop(open_)
        before, known = known, landing.land(taken(known, free, bound, n), "labels")
        landing.drop(before)
        done = last
    into = known.select(F.col("i").alias("taker"), F.col("v").alias("new"))
    return known.where("taker IS NOT NULL").select("taker", F.col("v").alias("old")).join(into, "taker").select("old", "new")
