"""Fill-in-middle documents by an index of distinct texts.

A text is cut into units, `[A-Za-z]+|[^A-Za-z]`, at two places drawn from its doc_id, and put together as prefix,
suffix, middle (psm) or suffix, prefix, middle (spm), or left plain.

The index has a row for each distinct text: the ends of its units, in code points, as an Elias-Fano list, made once
however many copies there are. select(k), the end of the k-th unit, reads the list without decoding it, so any number
of cuts with any seeds may be drawn from one index.

Rows are brought together by a 64-bit hash of the text. Rows of one hash share an entry only if the least and the
greatest of their texts, compared whole, are equal; otherwise the hash has no entry and its rows are cut on their own.
A hash of more than one row in SHARES, and of LEAST_SHARE rows at least, is dealt over shares by doc_id, each with an
entry of its own; there can be no more than SHARES of them, so they are broadcast. Texts are shuffled once: index and
documents read the same exchange, and only lists are moved to where the documents are.

Nulls, empties, ties: a null or empty text has no unit and is plain; a text that contains a marker is plain; repeated
rows each have their own, equal result; rows that are equal in doc_id and text stand in one share; a null doc_id draws
as an empty one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free

SHARES = 4096
LEAST_SHARE = 256
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, how many may be cut, and how many of these go suffix first.
CUT, SPM = 90, 20
ENTRY = "key long, share int, n long, chars long, low binary, high binary"
CUTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def ends(text: str) -> np.ndarray:
    """Where each unit ends, in code points: everywhere but between two letters."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    inside = letter[:-1] & letter[1:]
    return np.flatnonzero(np.append(~inside, True)[: len(points)]) + 1


@dataclass(frozen=True)
class EliasFano:
    """n rising numbers up to `chars`: their lower bits side by side, and of the rest a bit vector in which the k-th one
    stands at k plus its value; some 2 + log2(chars / n) bits a number."""

    n: int
    chars: int
    low: bytes
    high: bytes

    @property
    def width(self) -> int:
        return max(0, (self.chars // max(1, self.n)).bit_length() - 1)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, chars = len(values), int(values[-1]) if len(values) else 0
        width = cls(n, chars, b"", b"").width
        bits = (values[:, None] >> np.arange(width)) & 1
        high = np.zeros((chars >> width) + n + 1, dtype=np.uint8)
        high[(values >> width) + np.arange(n)] = 1
        return cls(n, chars, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def select(self, k: int) -> int:
        """The k-th number, from 1; 0 for k = 0."""
        if not k:
            return 0
        vector = np.frombuffer(self.high, dtype=np.uint8)
        ones = np.cumsum(np.bitwise_count(vector), dtype=np.int64)
        byte = int(np.searchsorted(ones, k))
        rank = k - (int(ones[byte - 1]) if byte else 0)
        at = 8 * byte + [i for i in range(8) if vector[byte] >> i & 1][rank - 1]
        first, width = (k - 1) * self.width, self.width
        chunk = int.from_bytes(self.low[first // 8 : (first + width) // 8 + 1], "little") >> first % 8
        return (at - (k - 1)) << width | chunk & ((1 << width) - 1)


def drawn(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def assemble(text: str, doc_id: int | None, entry: EliasFano, seed: str) -> tuple[str, int | None, int | None, str]:
    """form, characters of prefix and middle, output."""
    one, two, three, four = drawn(doc_id, seed)
    if not text or three % 100 >= CUT or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    a, b = sorted((one % (entry.n + 1), two % (entry.n + 1)))
    i, j = entry.select(a), entry.select(b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if four % 100 < SPM:
        return "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text, from what was made of it alone."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    one, two = head[len(PREFIX) :].split(SUFFIX if form == "psm" else PREFIX)
    return (one + middle + two) if form == "psm" else (two + middle + one)


def dealt(docs: DataFrame, hashed=F.xxhash64, least_share: int = LEAST_SHARE) -> DataFrame:
    """doc_id, text, key, share, dealt out by key and share."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", hashed(F.col("text")).cast("long"))
    limit = max(docs.count() // SHARES, least_share)
    hot = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(limit)).cast("int").alias("shares")).where("shares > 1")  # SHARES rows at most
    share = F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("shares"))).cast("int")
    return rows.join(F.broadcast(hot), "key", "left").select("doc_id", "text", "key", share.alias("share")).repartition("key", "share")


def index(rows: DataFrame) -> DataFrame:
    """The index of dealt() rows: an entry for each key and share whose rows have one text."""
    texts = rows.groupBy("key", "share").agg(F.min("text").alias("text"), (F.min("text") == F.max("text")).alias("one"), F.min("doc_id").alias("first"))

    def run(batches):
        for batch in batches:
            key, share, text, one = (batch.column(i).to_pylist() for i in range(4))
            made = [EliasFano.of(ends(t)) if same else None for t, same in zip(text, one)]
            kept = [(k, s, e.n, e.chars, e.low, e.high) for k, s, e in zip(key, share, made) if e is not None]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*kept)) or [()] * 6, kinds)], [x.split()[0] for x in ENTRY.split(", ")])

    # first keeps doc_id in the exchange, so that it is the one that the documents are read from
    return texts.select("key", "share", "text", "one", "first").mapInArrow(run, ENTRY)


def _made(docs: DataFrame, ddl: str, finish, seed: str, **options) -> DataFrame:
    rows = dealt(docs, **options)
    both = rows.join(index(rows).hint("merge"), ["key", "share"], "left").select("doc_id", "text", "n", "chars", "low", "high")

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, n, chars, low, high in zip(*(batch.column(i).to_pylist() for i in range(6))):
                entry = EliasFano(n, chars, low, high) if n is not None else EliasFano.of(ends(text))
                form, prefix, middle, output = assemble(text, doc_id, entry, seed)
                out.append((doc_id, entry.n, form, prefix, middle, *finish(output, form)))
            fields = [x.split() for x in ddl.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, (_, kind) in zip(list(zip(*out)) or [()] * len(fields), fields)], [n for n, _ in fields])

    return both.mapInArrow(run, ddl)


def cut(docs: DataFrame, seed: str = "1", **options) -> DataFrame:
    """doc_id, n units, form, prefix_chars, middle_chars, output text. docs: doc_id, text."""
    return _made(docs, CUTS, lambda output, form: (output,), seed, **options)


def digests(docs: DataFrame, seed: str = "1", **options) -> DataFrame:
    """cut(), with digests of the output and of the text that is made from it again in place of the output."""
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return _made(docs, RESULT, lambda output, form: (digest(output), digest(restored(output, form))), seed, **options)


def restore(made: DataFrame) -> DataFrame:
    """cut()'s rows with their text again, in a column `text`."""
    name = free("text", made)

    def run(batches):
        for batch in batches:
            at, form = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("output", "form"))
            yield batch.append_column(name, pa.array(map(restored, at, form), pa.string()))

    return made.mapInArrow(run, T.StructType([*made.schema.fields, T.StructField(name, T.StringType())]))


#: The same in DuckDB SQL.
SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, [CAST('0x' || substr(h, i, 8) AS BIGINT) for i in [1, 9, 17, 25]] AS d FROM t),
k AS (SELECT *, len(units) AS n, least(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) AS a, greatest(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM c),
x AS (SELECT *, strpos(output, '<P>') AS ap, strpos(output, '<S>') AS sp, strpos(output, '<M>') AS mp FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(output, 4, sp - 4) || substr(output, mp + 3) || substr(output, sp + 3, mp - sp - 3)
    ELSE substr(output, ap + 3, mp - ap - 3) || substr(output, mp + 3) || substr(output, 4, ap - 4) END) AS restored_sha256 FROM x
"""
