"""What the operators share: reading tables, written intermediate tables, and rolling hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, only a local
    master may fall back on a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "/tmp/plumbline-checkpoints"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def free(name: str, df: DataFrame) -> str:
    """name, with underscores behind it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]):
    """Settings of the session that hold inside."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of queries that end inside are dropped at once, not at some later collection."""
    return configured(spark, {CLEANUP: "true"})


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of this application under the shared folder."""
    return f"{shared_dir(spark)}/plumbline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession):
    """Tables that materialize() writes inside are deleted at the end, but for those it writes with keep=True."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as a table under the shared folder and read it again: its lineage ends there, so a
    lost executor costs no more than a read, and its shuffle files can go. keep: beyond the innermost temporary()."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    for scope in _scopes[-2:-1] if keep else _scopes[-1:]:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    found, files = _file(spark, path)
    files.delete(found, True)


def drop(table: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        delete(table.sparkSession, path)


def drop_tables(spark: SparkSession) -> None:
    """Remove what this application has written under the shared folder. Results that still read it end."""
    delete(spark, f"{shared_dir(spark)}/plumbline-{spark.sparkContext.applicationId}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of text, if it is there."""
    found, files = _file(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if files.exists(found) else None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    found, files = _file(spark, path)
    out = files.create(found, True)
    out.write(bytearray(text.encode()))
    out.close()


#: Rows of texts that a task works on at a time.
SLICE = 1000


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of SLICE at most. Between Spark's batches, memory that Arrow and the C library hold
    unused is given back: workers stay for the tasks to come, and their share of an executor's memory with them."""
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), SLICE):
            yield batch.slice(lo, SLICE)
        del batch
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i under n at least."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, base in (("p", BASE), ("q", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"], _powers["q"]


class Rolling:
    """Hashes of any span of a token sequence in constant time, from prefix sums modulo 2**64."""

    def __init__(self, tokens: np.ndarray):
        self.n = len(tokens)
        p, self.q = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(tokens * p[: self.n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.q[start] + (end - start).astype(np.uint64))

    def grams(self, k: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The hash of each span of k tokens that starts in [lo, hi)."""
        hi = self.n - k + 1 if hi is None else hi
        return mix((self.sums[lo + k : hi + k] - self.sums[lo:hi]) * self.q[lo:hi] + np.uint64(k))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours, by doubling."""
    m, cur, size = len(v) - w + 1, v, 1
    while 2 * size <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return cur[:m] if size == w else np.minimum(cur[:m], cur[w - size : w - size + m])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of starts[i], starts[i] + 1, ... starts[i] + lengths[i] - 1, in one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
