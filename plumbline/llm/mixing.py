"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Targets. Sources weigh `weights`, repeating, in code point order, null last, and share all words of the corpus by
weight. A target stops at `cap` times its source's words; what is over is shared again by weight, until none is above.

Copies. A document has an expected number of copies: one factor for its whole source times its preference, `cap` at
most, so that the expected words of a source are its target. The preference is the number of its words, `full` at most:
a fragment of 5 words is taken a tenth as often as a text of 50 or more. The whole part of the expectation is allocated
for certain; its fraction is the document's inclusion probability p for one more copy.

Sampling. With u uniform, drawn from a digest of doc_id and text, documents of a source are ranked by their random odds
over their inclusion odds, q = u / (1 - u) / (p / (1 - p)), and taken from the least on until the words that the
certain copies leave open are used up: a sample of fixed size in words. At the cut, documents that don't fit are passed
over for later ones that do, PASSES times, and then the one that comes nearest to what is left closes the sample; so a
source misses its target by about half of a short document. Ranks are ordered by q / (1 + q), between 0 and 1.

Scale. Texts are read once, into a table of some bytes a row. No source is sorted as a whole: words are summed up by
buckets of the rank of about `per_bucket` documents, and only the bucket that the cut falls into is ordered. Sources
are ranked by ranges, and shared by aggregations on one row for each; they may be as many as there are documents.

Nulls, empties, ties: a null or empty text has no words and takes none; null is a source of its own; equal ranks go by
doc_id, then size; repeated rows are documents of their own; a null doc_id is drawn as an empty one; other columns are
ignored; an empty table gives no rows, and with no words at all all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (1, 2, 3)
CAP = 3
FULL = 50
PER_BUCKET = 5_000
PASSES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the digest that make u: 52 bits, which a double holds.
DIGITS = 13


def uniform(seed: str) -> Column:
    """A number in (0, 1) that depends on doc_id, text and seed alone."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    return (F.conv(F.substring(drawn, 1, DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def ranked(table: DataFrame, name: str) -> DataFrame:
    """table with `rank` from 0 by a column without repeats, null last: ranges are numbered, then rows in each."""
    cut = materialize(table.repartitionByRange(F.col(name).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    parts = cut.groupBy("part").agg(F.count("*").alias("rows"))  # a row for each partition
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col(name).asc_nulls_last())) - 1
    return cut.join(parts.select("part", before.alias("before")), "part").withColumn("rank", F.col("before") + inside).drop("part", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target. sources: source, source_size, one row each. Each round finds who is above, in one
    aggregation, and shares what they leave; who was above stays above."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = materialize(ranked(sources, "source").select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, known = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap * F.col("source_size")
        full, open_, n = weighed.agg(F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.count_if(above)).first()
        if n == known or not open_:
            break
        level, known = (total - cap * full) / open_, n
    return weighed.select("source", "source_size", F.least(F.lit(float(cap)) * F.col("source_size"), F.col("weight") * F.lit(level or 0.0)).alias("target"))


def expectations(classes: DataFrame, goals: DataFrame, cap: int = CAP, per_bucket: int = PER_BUCKET) -> DataFrame:
    """A row for each source and preference: copies for certain, inclusion probability p, and the source's open words
    (`rest`) and number of buckets. classes: source, prefer, words, rows; goals as of targets()."""
    both = classes.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    down = Window.partitionBy("source").orderBy(F.desc("prefer"))
    higher = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("prefer") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    one = both.withColumns({"higher": higher, "mass": mass})
    # the factor if all higher classes stand at the cap; the first class that stays under it is right
    factor = F.when(F.col("mass") > 0, (F.col("target") - cap * F.col("higher")) / F.col("mass"))
    one = one.withColumn("factor", factor)
    right = F.first(F.when(F.col("factor") * F.col("prefer") <= cap, F.col("factor")), ignorenulls=True)
    whole = Window.partitionBy("source").orderBy(F.desc("prefer")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = one.withColumn("expected", F.coalesce(F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), right.over(whole) * F.col("prefer"))), F.lit(float(cap))))
    one = one.withColumn("certain", F.floor("expected"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("certain") * F.col("words")).over(whole))
    buckets = F.ceil(F.sum("rows").over(whole) / F.lit(float(per_bucket)))
    return one.select("source", "prefer", "source_size", "target", "expected", "certain", (F.col("expected") - F.col("certain")).alias("p"), rest.alias("rest"), buckets.alias("buckets"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, full: int = FULL, per_bucket: int = PER_BUCKET, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, expected, p, place. docs: doc_id, text, source."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = materialize(docs.select("doc_id", "source", size.alias("size"), uniform(seed).alias("u")), "sizes")
    base = base.withColumn("prefer", F.least(F.greatest("size", F.lit(1)), F.lit(full)).cast("long"))
    classes = materialize(base.groupBy("source", "prefer").agg(F.sum("size").alias("words"), F.count("*").alias("rows")), "classes")
    goals = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    known = materialize(expectations(classes, goals, cap, per_bucket), "expectations")

    key = known.withColumnsRenamed({"source": "of", "prefer": "as"})
    placed = base.join(key, F.col("source").eqNullSafe(F.col("of")) & (F.col("prefer") == F.col("as"))).drop("of", "as")
    random, inclusion = F.col("u") * (1 - F.col("p")), (1 - F.col("u")) * F.col("p")  # q = random / inclusion
    placed = placed.withColumn("place", F.when(F.col("p") > 0, random / (random + inclusion)))
    placed = placed.withColumn("bucket", F.floor(F.col("place") * F.col("buckets")))

    filled = placed.where("bucket IS NOT NULL").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = materialize(filled.withColumn("before", upto).where("before <= rest AND before + words > rest").select(F.col("source").alias("of"), F.col("bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("open")), "cuts")
    # a source without a cut takes all its eligible documents
    met = placed.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    at = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    sure = met.where(~at).withColumn("more", F.when(F.col("bucket").isNull(), 0).when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), 1).otherwise(0))
    order, source = ["place", "doc_id", "size"], Window.partitionBy("source")
    edge = met.where(at).withColumns({"in": F.lit(False), "left": F.col("open")})
    for _ in range(PASSES):
        edge = edge.withColumn("can", ~F.col("in") & (F.col("size") <= F.col("left")))
        edge = edge.withColumn("run", F.sum(F.when(F.col("can"), F.col("size"))).over(source.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        edge = edge.withColumn("in", F.col("in") | (F.col("can") & (F.col("run") <= F.col("left"))))
        edge = edge.withColumn("left", F.col("open") - F.coalesce(F.sum(F.when(F.col("in"), F.col("size"))).over(source), F.lit(0)))
    miss = F.abs(F.col("left") - F.col("size"))
    nearest = F.row_number().over(source.orderBy("in", miss, *order)) == 1
    edge = edge.withColumn("more", F.when(F.col("in") | (nearest & (miss < F.col("left"))), 1).otherwise(0))
    out = ["doc_id", "source", "size", "source_size", "target", ((F.col("certain") + F.col("more")) * F.col("size")).alias("taken"), "expected", "p", "place"]
    return sure.select(*out).union(edge.select(*out))


def _passes() -> str:
    out = "i0 AS (SELECT *, FALSE AS taken, open AS remains FROM w WHERE edge)"
    for k in range(PASSES):
        out += (
            f", j{k} AS (SELECT *, NOT taken AND size <= remains AS can FROM i{k}), n{k} AS (SELECT * EXCLUDE (can, taken), taken OR (can AND sum(CASE WHEN can THEN size END) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) <= remains) AS taken FROM j{k}), "
            f"i{k + 1} AS (SELECT * EXCLUDE (remains), open - coalesce(sum(size) FILTER (taken) OVER (PARTITION BY source), 0) AS remains FROM n{k})"
        )
    return out


#: The same in DuckDB SQL, over each source as a whole.
SQL = rf"""
WITH b AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {DIGITS}) AS BIGINT) + 0.5::DOUBLE) / {float(16**DIGITS)!r}::DOUBLE AS u
  FROM documents),
d AS (SELECT *, least(greatest(size, 1), {FULL}) AS prefer FROM b),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s),
l AS (SELECT max((total - {CAP} * capped) / weights) AS level FROM r WHERE weight * ((total - {CAP} * capped) / weights) <= {CAP} * source_size),
t AS (SELECT source, source_size, CAST(least({CAP}::DOUBLE * source_size, weight * coalesce(level, 0)) AS DOUBLE) AS target FROM s, l),
c AS (SELECT d.source, prefer, any_value(source_size) AS source_size, any_value(target) AS target, sum(size) AS words, count(*) AS n FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, prefer),
f AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY prefer DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS higher,
    sum(prefer * words) OVER (PARTITION BY source ORDER BY prefer DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass FROM c),
a AS (SELECT source, arg_max((target - {CAP} * higher) / mass, prefer) AS factor FROM f WHERE mass > 0 AND (target - {CAP} * higher) / mass * prefer <= {CAP} GROUP BY source),
e AS (SELECT c.*, coalesce(least({CAP}::DOUBLE, greatest(0::DOUBLE, factor * prefer)), {CAP}::DOUBLE) AS expected FROM c LEFT JOIN a ON c.source IS NOT DISTINCT FROM a.source),
g AS (SELECT *, expected - floor(expected) AS p, greatest(0::DOUBLE, target - sum(floor(expected) * words) OVER (PARTITION BY source)) AS rest, ceil(sum(n) OVER (PARTITION BY source) / {PER_BUCKET}) AS buckets FROM e),
q AS (SELECT d.doc_id, d.source, d.size, source_size, target, expected, p, rest, buckets, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS place
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.prefer = g.prefer),
o AS (SELECT *, floor(place * buckets) AS bucket FROM q),
v AS (SELECT source, bucket, any_value(rest) AS rest, sum(size) AS words FROM o WHERE bucket IS NOT NULL GROUP BY source, bucket),
z AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v),
w AS (SELECT o.*, o.rest - before AS open, coalesce(before <= o.rest AND before + words > o.rest, FALSE) AS edge, o.bucket IS NOT NULL AND before + words <= o.rest AS sure
    FROM o LEFT JOIN z ON o.source IS NOT DISTINCT FROM z.source AND o.bucket = z.bucket),
{_passes()},
y AS (SELECT *, taken OR (row_number() OVER (PARTITION BY source ORDER BY taken, abs(remains - size), place, doc_id, size) = 1 AND abs(remains - size) < remains) AS more FROM i{PASSES}),
e2 AS (SELECT doc_id, source, size, source_size, target, expected, p, place, more FROM y UNION ALL SELECT doc_id, source, size, source_size, target, expected, p, place, sure FROM w WHERE NOT edge)
SELECT doc_id, source, size, source_size, target, CAST((floor(expected) + CASE WHEN more THEN 1 ELSE 0 END) * size AS BIGINT) AS taken, expected, p, place FROM e2
"""
