"""Sharding along a Hilbert curve over language, source and size.

Each dimension is quantised to 2**bits cells; a row's cell has an index on the curve, and rows sorted
by it are cut into runs of equal row counts, so a shard holds a compact region and files can be pruned
in all three dimensions. There are 2**(3 bits) cells at most, a fixed number.

Equal texts stand together: copies in several languages or sources all go to the cell of the one with the
smallest doc_id, and are neighbours there, so only the cuts between shards come between them.

The rank of a row is exact without one global sort: documents are read once, into a narrow table; rows
are counted by cell, and crowded cells are split by a hash of the text into parts of about `part_rows`. A
text of more copies than that is a part of its own, in pieces by doc_id. Cells are summed up along the
curve, parts within their cell, and a row's place within its part comes from a window over that part alone.
A cell, or a text, that holds a third of all rows is so dealt over many tasks.

Law `rows`: shard = floor(rank * shards / rows), so counts differ by one at most.

Nulls, empties, ties: a null text has no bytes (size 1); null language or source is a value of its
own; within a part rows go by text hash, then doc_id, so equal texts stand together; repeated rows
take a slot each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 16
BITS = 5
PART_ROWS = 5_000


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """The curve index of integer points (n, d) under 2**bits, by Gray code on rotated cubes."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            has = (x[i] & q) > 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(has, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve(spark, bits: int = BITS) -> DataFrame:
    """All cells (x, y, z) with their index h: 2**(3 bits) rows, whatever the data."""
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"x": grid[:, 0], "y": grid[:, 1], "z": grid[:, 2], "h": hilbert_index(grid, bits)}))


def assign(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, h, rank, shard, slot. docs: doc_id, text, lang, source."""
    spark = docs.sparkSession
    cells = 1 << bits
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    text = ["size", "text_crc32", "hash"]
    rows = materialize(
        docs.select(
            "doc_id",
            size.alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"),
            F.pmod(F.xxhash64("lang"), F.lit(cells)).alias("x"),
            F.pmod(F.xxhash64("source"), F.lit(cells)).alias("y"),
            F.least(F.floor(F.log2(size.cast("double")) * 2), F.lit(cells - 1)).cast("long").alias("z"),
        ),
        "rows",
    )
    # texts whose rows differ in cell go where their first row goes; texts of very many rows are parts of their own
    apart = (F.min("x") != F.max("x")) | (F.min("y") != F.max("y"))
    groups = rows.groupBy(*text).agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "x", "y")).alias("first"), apart.alias("apart")).where((F.col("copies") > part_rows) | F.col("apart"))
    groups = materialize(groups.select(*text, "copies", F.col("first.x").alias("x1"), F.col("first.y").alias("y1")), "groups")
    base = rows.join(groups, text, "left").withColumns({"x": F.coalesce("x1", "x"), "y": F.coalesce("y1", "y")})
    # the curve is a fixed table: 32768 rows for 5 bits
    base = materialize(base.join(F.broadcast(curve(spark, bits)), ["x", "y", "z"]).select("doc_id", *text, "copies", "h"), "cells")
    upto = lambda *by: Window.partitionBy(*by[:1]).orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, -1)
    per_cell = base.groupBy("h").agg(F.count("*").alias("cell_rows"))  # a row for each cell
    along = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.withColumn("first", F.coalesce(F.sum("cell_rows").over(along), F.lit(0))).withColumn("total", F.sum("cell_rows").over(Window.partitionBy()))
    per_cell = per_cell.withColumn("parts", F.ceil(F.col("cell_rows") / F.lit(part_rows)))
    many = F.col("copies") > part_rows
    parted = base.join(F.broadcast(per_cell), "h").withColumns(
        {
            "part": F.pmod(F.xxhash64(*text), F.col("parts")),
            "own": F.when(many, F.col("hash")),  # null, and first in order, for all other texts of the part
            "piece": F.when(many, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("copies") / F.lit(part_rows)))).otherwise(F.lit(0)),
        }
    )
    key = ["h", "part", "own", "piece"]
    counts = parted.groupBy(*key).agg(F.count("*").alias("rows"))
    before = counts.withColumn("before", F.coalesce(F.sum("rows").over(upto(*key)), F.lit(0))).drop("rows")  # within a cell
    before = before.withColumnsRenamed({k: f"{k}_" for k in key})
    placed = parted.join(before, F.expr(" AND ".join(f"{k} <=> {k}_" for k in key)))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy(*text, "doc_id")) - 1
    ranked = placed.withColumn("rank", F.col("first") + F.col("before") + inside)
    exact = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"(((rank * {shards}) div total) * total + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", "h", "rank", exact.cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"))
