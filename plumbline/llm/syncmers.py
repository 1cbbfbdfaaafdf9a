"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is a sequence of tokens: lower-cased words, split at white space, where a character of a script
that writes without spaces is a word of its own. A k-mer is K = 3 tokens in a row; its inner substrings
are its tokens. It is a closed syncmer, and so an anchor, if the least of its inner hashes is the first or
the last. Whether a k-mer is chosen depends on it alone, so an edit elsewhere never moves an anchor, and
anchors match by position in both texts. Where a text has under FEW tokens, the closed syncmers of its
characters are anchors too, and the text as a whole, so no text with a character but white space is
without.

The fingerprint holds the SIZE anchors of least hash in the order of the text, each with the number of its
token (`positions`). likeness() is the estimate of shared among all anchors that two fingerprints give;
shift() is where the text of one stands in the other, by how far apart their common anchors lie. All
expressions run in the JVM, a row at a time: no text is exploded, and memory is bounded by one text.

The next document comes from a window over buckets of consecutive doc_id, cut at quantiles within
quantiles, so that a bucket has about `per_bucket` documents whatever their number; each bucket's first
row is also dealt to the bucket before it. A text is shuffled once.

Nulls, empties, ties: a null text is empty; an empty text, or one of white space, has an empty
fingerprint, of likeness 1 with another empty one and 0 with others; equal texts have equal fingerprints;
repeated rows have each their own result, and follow one another; a row without doc_id has no place in the
order: nothing follows it, so its edited text is its first half and near_next is 0 (1 if it is empty);
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
FEW = 16
SIZE = 64
PER_BUCKET = 5_000
#: Quantiles at each of the two levels of buckets.
LEVEL = 1_000
#: Blocks of scripts that write without spaces between words: Thai and Lao, Burmese, Khmer, Japanese, Chinese.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"


def let(x: Column, f) -> Column:
    """f(x), where x is worked out once, however often f uses it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def mers(hashes: Column) -> Column:
    """For each token the hash of the k-mer that begins there if it is a closed syncmer, else null."""
    return F.transform(hashes, lambda x, i: F.when(F.least(x, F.get(hashes, i + 2)) <= F.get(hashes, i + 1), F.when(i + K <= F.size(hashes), F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)))))


def anchors(text: Column) -> Column:
    """The anchors of a text as an array of hashes, null for tokens where none begins."""
    parted = let(F.lower(text), lambda low: F.when(low.rlike(UNSPACED), F.regexp_replace(low, f"({UNSPACED})", " $1 ")).otherwise(low))
    tokens = F.filter(F.split(parted, r"\s+"), lambda w: w != "")
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))

    def all_of(words: Column) -> Column:
        of_words = let(hashed(words), mers)
        whole = F.array_join(words, " ")
        letters = let(hashed(F.split(whole, "")), mers)
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) >= FEW, of_words).otherwise(F.concat(of_words, letters, F.array(F.xxhash64(whole))))

    return let(tokens, all_of)


def sketch(text: Column, size: int = SIZE) -> Column:
    """The `size` anchors of least hash as structs (position, anchor), each at its first place, in the order of the text."""

    def least(own: Column) -> Column:
        bound = F.get(F.sort_array(F.array_distinct(F.array_compact(own))), F.lit(size - 1))
        places = lambda top: F.array_compact(F.transform(own, lambda x, i: F.when(x.isNotNull() & (top.isNull() | (x <= top)), F.struct(i.alias("position"), x.alias("anchor")))))
        first = lambda found, all_: F.filter(found, lambda s, i: F.array_position(all_, s["anchor"]) == i + 1)
        return let(let(bound, places), lambda found: let(found.getField("anchor"), lambda all_: first(found, all_)))

    return let(anchors(text), least)


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """The share of the least `size` hashes of both sketches that are in each of them."""

    def share(x: Column, y: Column) -> Column:
        return let(F.slice(F.sort_array(F.array_union(x, y)), 1, size), lambda union: F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(x, y), union)) / F.size(union)))

    return let(F.struct(a.getField("anchor").alias("x"), b.getField("anchor").alias("y")), lambda both: share(both["x"], both["y"]))


def shift(a: Column, b: Column) -> Column:
    """How many tokens further on in b the common anchors stand, the median of them; null without any."""
    places = F.transform(a, lambda s: F.get(F.transform(F.filter(b, lambda t: t["anchor"] == s["anchor"]), lambda t: t["position"] - s["position"]), F.lit(0)))
    return let(F.sort_array(F.array_compact(places)), lambda d: F.get(d, ((F.size(d) - 1) / 2).cast("int")))


def printed(own: Column) -> Column:
    return F.array_join(F.transform(own, lambda s: F.lpad(F.lower(F.hex(s["anchor"])), 16, "0")), "")


def held(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns worked out here: no filter on them goes below this point."""
    packed = F.inline(F.array(F.struct(*names)))
    return df.select(*(c for c in df.columns if c not in names), packed)


def _below(bounds: Column, value: Column, steps: int) -> Column:
    """How many of the sorted bounds, under 2**steps of them, are at most the value; by halving."""
    halves = F.array(*(F.lit(1 << d) for d in reversed(range(steps))))
    return F.aggregate(halves, F.lit(0), lambda low, step: F.when((low + step <= F.size(bounds)) & (F.get(bounds, low + step - 1) <= value), low + step).otherwise(low))


def in_order(docs: DataFrame, per_bucket: int = PER_BUCKET, level: int = LEVEL) -> DataFrame:
    """docs with `first`, `bucket` and `guard`: buckets of consecutive doc_id, between quantiles (first) and quantiles
    within those (bucket). The first rows of a bucket stand once more, as guards, at the end of the one before it (the
    last, for the very first), so a window over a bucket sees what follows its last row. Rows without doc_id have
    buckets of their own, dealt by hash."""
    rows, n, least = docs.agg(F.count("*"), F.count("doc_id"), F.min("doc_id")).first()
    parts = max(1, -(-n // per_bucket))
    outer, inner = min(parts, level), -(-parts // level)
    quantiles = lambda k: F.array_sort(F.array_distinct(F.percentile_approx("doc_id", [i / k for i in range(1, k)], max(1_000, 10 * k))))
    found = docs.agg(quantiles(outer)).first()[0] if outer > 1 else []
    tops = F.array(*map(F.lit, found)).cast("array<bigint>")
    dealt = docs.withColumn("first", _below(tops, F.col("doc_id"), len(found).bit_length()))
    if inner > 1:
        cuts = dealt.where("doc_id is not null").groupBy("first").agg(quantiles(inner).alias("cuts"))
        along = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # over at most `level` rows
        cuts = cuts.withColumn("end", F.lag(F.size("cuts")).over(Window.orderBy("first"))).withColumn("end", F.coalesce("end", F.last(F.size("cuts")).over(along)))
        dealt = dealt.join(F.broadcast(cuts), "first", "left")  # at most `level` rows of `inner` numbers
    else:
        dealt = dealt.withColumns({"cuts": F.array().cast("array<bigint>"), "end": F.lit(0)})
    dealt = dealt.withColumn("bucket", _below(F.col("cuts"), F.col("doc_id"), inner.bit_length()))
    # bounds are values of doc_id, so a bucket but the very first begins with the rows that equal its bound
    place = lambda first, bucket, guard: F.struct(first.alias("first"), bucket.alias("bucket"), F.lit(guard).alias("guard"))
    own = place(F.col("first"), F.col("bucket"), False)
    places = (
        F.when(F.col("doc_id").isNull(), F.array(place(F.lit(-1), F.pmod(F.xxhash64("text"), F.lit(4 * -(-rows // per_bucket))).cast("int"), False)))
        .when(F.col("doc_id") == F.lit(least), F.array(own, place(F.lit(len(found)), F.col("end"), True)))
        .when((F.col("first") > 0) & (F.get(tops, F.col("first") - 1) == F.col("doc_id")), F.array(own, place(F.col("first") - 1, F.col("end"), True)))
        .when((F.col("bucket") > 0) & (F.get("cuts", F.col("bucket") - 1) == F.col("doc_id")), F.array(own, place(F.col("first"), F.col("bucket") - 1, True)))
        .otherwise(F.array(own))
    )
    return dealt.select(*docs.columns, F.inline(places))


def fingerprints(docs: DataFrame, size: int = SIZE, per_bucket: int = PER_BUCKET, level: int = LEVEL) -> DataFrame:
    """A row per document: its fingerprint, that of its edited text (the last half of its code points
    replaced by the beginning of the next document), and the likeness to that and to the next document."""
    rows = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), per_bucket, level)
    rows = held(rows.repartition("first", "bucket").withColumn("own", sketch(F.col("text"), size)), "own")
    follows = Window.partitionBy("first", "bucket").orderBy("guard", "doc_id", "text")
    after = lambda c, none: F.when(F.col("doc_id").isNull(), none).otherwise(F.lead(c).over(follows))
    rows = rows.select("doc_id", "text", "own", "guard", after("text", F.lit("")).alias("next_text"), after("own", F.array().cast(rows.schema["own"].dataType)).alias("next")).where("not guard")
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = held(rows.withColumn("edited", edited).drop("next_text"), "edited")
    rows = held(rows.withColumn("edited_own", sketch(F.col("edited"), size)), "edited_own")
    own, edited_own, following = F.col("own"), F.col("edited_own"), F.col("next")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(own).alias("fingerprint"),
        printed(edited_own).alias("edited_fingerprint"),
        likeness(own, edited_own, size).alias("near_edited"),
        likeness(own, following, size).alias("near_next"),
        own.getField("position").alias("positions"),
        edited_own.getField("position").alias("edited_positions"),
    )
