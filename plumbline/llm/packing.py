"""Packing by sum of squares: documents as token sequences into windows of 4096 tokens.

Each task packs its own documents online. A window has a fill level; the task keeps, for each level,
how many open windows stand there, in one array. A piece of s tokens goes to the level (or a new
window) that makes the sum of squared counts least: filling a window to the brim takes one from its
level; moving one from level h to h + s changes the sum by 2 (count[h + s] - count[h]) + 2. So no
level gathers many half-filled windows, and few are open at any time. A document longer than a window
fills whole windows first; what is left of it is placed as a piece.

At the end of a task the open windows are dissolved: pieces are cut and run together into full
windows, and the last rest becomes windows whose lengths are powers of two, which need no padding.
So no window is padded, whatever the number of tasks. There is no shuffle: a task that is lost is
packed again from its own input, to the same sequence ids (task number and a running number).

Nulls, empties, ties: a null or empty text is the end token alone; repeated rows are packed each by
itself; of equally good levels the fullest wins; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, ragged

WINDOW = 4096
END = 2
VOCABULARY = "word_bpe_49k.json"
#: A worker's memory of words already encoded is dropped beyond this many.
REMEMBERED = 400_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = found = len(self)
        return found


class Words:
    """Token ids of whole texts, each distinct word put through the tokenizer's merges once.

    The vocabulary's rules for texts in ASCII and Latin-1 letters are plain: lower case, then the
    pieces below, whose bytes stand for characters of the merges. Any other text (or one that spells a
    special token) goes through the tokenizer as a whole."""

    #: Fixed by the vocabulary file: its pieces, on lower-cased bytes.
    PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")
    OTHER = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]|<\\|")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        # a byte's character: itself where it prints, else the next free one from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.characters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.reset()

    def reset(self) -> None:
        self.at = _Numbered()
        self.known = 0
        self.flat, self.first = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def learn(self) -> None:
        """Encode the words numbered since the last call."""
        new = list(islice(self.at, self.known, None))
        if new:
            ids = np.array(self.merges.encode_batch_fast([b" ".join(new).decode("latin-1").translate(self.characters | {32: " "})], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            assert len(ends) == len(new) and ends[-1] == len(ids)
            self.first = np.concatenate([self.first, len(self.flat) + ends])
            self.flat = np.concatenate([self.flat, ids])
            self.known = len(self.at)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text with the end token behind them."""
        if len(self.at) > REMEMBERED:
            self.reset()
        parts = []
        for text in texts:
            if text and self.OTHER.search(text):
                parts.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32))
            else:
                words = self.PIECES.findall((text or "").lower().encode())
                parts.append(np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words)))
        self.learn()
        size = np.diff(self.first)
        return [np.append(x if x.dtype == np.uint32 else self.flat[ragged(self.first[x], size[x])], np.uint32(END)) for x in parts]


class Packer:
    """Sum-of-squares packing of one task's pieces. A piece: (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)  # of open windows by fill level
        self.open: list[list[list]] = [[] for _ in range(window)]  # the windows themselves
        self.next = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self.close([(doc_id, at, ids[at : at + self.window], n)])
            at += self.window
        if at < n:
            self.place((doc_id, at, ids[at:], n))

    def place(self, piece: tuple) -> None:
        s = len(piece[2])
        # level h moves to h + s; h = 0 opens a window, h + s = window closes one
        levels = np.flatnonzero(self.count[1 : self.window - s + 1]) + 1
        best, least = 0, 2 * self.count[s] + 1
        if len(levels):
            gain = 2 * (self.count[levels + s] - self.count[levels]) + 2
            full = levels + s == self.window
            gain[full] = 1 - 2 * self.count[levels[full]]
            k = len(gain) - 1 - int(np.argmin(gain[::-1]))
            if gain[k] <= least:
                best = int(levels[k])
        if best:
            pieces = self.open[best].pop()
            self.count[best] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if best + s == self.window:
            self.close(pieces)
        else:
            self.open[best + s].append(pieces)
            self.count[best + s] += 1

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Dissolve the open windows, fullest first, into full ones and powers of two."""
        rest = [p for level in reversed(self.open) for pieces in level for p in pieces]
        left = sum(len(p[2]) for p in rest)
        goal, pieces, has = 0, [], 0
        while rest or pieces:
            goal = goal or (self.window if left >= self.window else 1 << (left.bit_length() - 1))
            doc_id, start, ids, total = rest.pop()
            take = min(len(ids), goal - has)
            pieces.append((doc_id, start, ids[:take], total))
            if take < len(ids):
                rest.append((doc_id, start + take, ids[take:], total))
            has += take
            if has == goal:
                self.close(pieces)
                left -= goal
                goal, pieces, has = 0, [], 0
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0

    def drain(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([],) * 7)], SCHEMA.replace(" long", "").split(", "))


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """A row per piece; docs: doc_id, text; path: the tokenizer's vocabulary file."""

    def run(batches):
        from pyspark import TaskContext

        words, packer = Words(path), Packer(window)
        packer.next = TaskContext.get().partitionId() << 33
        for batch in in_slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(ids), 512):
                for doc_id, own in zip(ids[lo : lo + 512], words.encode(texts[lo : lo + 512])):
                    packer.add(doc_id, own)
            yield packer.drain()
        packer.finish()
        yield packer.drain()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
