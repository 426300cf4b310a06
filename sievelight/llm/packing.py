"""Packing token ids into windows: best-fit decreasing with a segment tree over remaining capacities.

Overlong documents are first cut into full windows.  The rest go, longest first, each to the tightest open window that
has room; a segment tree indexed by remaining capacity finds it.  At last, windows that are left partly empty are
emptied into the gaps of the others (cut where needed), so that a shard has one partly filled window at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, bpe

WINDOW = 1024
#: Ids of a shard, which is packed at once: the memory that a task needs.
SHARD_IDS = 8 << 20


class Capacities:
    """Open windows by remaining capacity 1..size: a binary tree of which capacities have any window."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, window: int, room: int) -> None:
        if room <= 0:
            return
        self.open[room].append(window)
        at = room + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at //= 2

    def tightest(self, need: int) -> int:
        """The least capacity >= need that has an open window, 0 if none."""
        at = need + self.leaves
        if self.any[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return 0

    def take(self, room: int) -> int:
        window = self.open[room].pop()
        at = room + self.leaves
        if not self.open[room]:
            self.any[at] = 0
            at //= 2
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
                at //= 2
        return window


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[list[list[tuple[int, int, int]]], Capacities]:
    """Best-fit decreasing: windows of pieces (document, start, length), and those that still have room.

    Documents of a window or more give full windows first; what is left of each goes, longest first, to the tightest window.
    """
    windows: list[list[tuple[int, int, int]]] = []
    full = lengths // window
    for doc in np.flatnonzero(full):
        windows += [[(int(doc), k * window, window)] for k in range(int(full[doc]))]
    rest = lengths - full * window
    order = np.argsort(-rest, kind="stable")
    tree = Capacities(window)
    for doc in order[: np.count_nonzero(rest)].tolist():
        need = int(rest[doc])
        room = tree.tightest(need)
        if room:
            at = tree.take(room)
        else:
            at, room = len(windows), window
            windows.append([])
        windows[at].append((doc, int(full[doc]) * window, need))
        tree.put(at, room - need)
    return windows, tree


def filled(windows: list[list[tuple[int, int, int]]], tree: Capacities) -> list[list[tuple[int, int, int]]]:
    """The windows with their gaps filled, from the fullest on, by what the emptiest hold: one has room at most.

    A document is cut only where it is taken out of one of the emptiest windows and no gap has room for it.
    """
    partly = sorted(((room, at) for room, ats in enumerate(tree.open) for at in ats), key=lambda x: (x[0], x[1]))
    lo, hi = 0, len(partly) - 1
    while lo < hi:
        gap, into = partly[lo]
        source = windows[partly[hi][1]]
        while gap and source:
            doc, start, n = source.pop()
            cut = min(gap, n)
            windows[into].append((doc, start + n - cut, cut))
            if cut < n:
                source.append((doc, start, n - cut))
            gap -= cut
        if gap:
            partly[lo] = (gap, into)
            hi -= 1
        else:
            lo += 1
    return [w for w in windows if w]


def pack(df: DataFrame, vocabulary: bpe.Vocabulary, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Every document ends with end_id; a null or empty text is that id alone.  Each task packs what it reads, in shards of
    about SHARD_IDS ids, so nothing is shuffled; sequence ids hold the task's number and are unique.  Rows that repeat,
    and null ids, are packed like any other.  A text is never dropped or shortened.
    """
    blocks.session_limits(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def emit(docs: list, coded: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        packed = filled(*best_fit(np.fromiter(map(len, coded), np.int64, len(coded)) // 4, window))
        out: list[list] = [[] for _ in range(7 + with_ids)]
        for k, pieces in enumerate(packed):
            offset = 0
            for doc, start, n in pieces:
                ids = memoryview(coded[doc])[4 * start : 4 * (start + n)]
                for col, x in zip(out, (docs[doc], start, n, zlib.crc32(ids), len(coded[doc]) // 4, first + k, offset, *([bytes(ids)] if with_ids else [])), strict=True):
                    col.append(x)
                offset += n
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(out)], names), first + len(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache = vocabulary.cache()
        first = TaskContext.get().partitionId() << 40
        docs, coded, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc)
                coded.append(bpe.encode_text(cache, text) + end)
                held += len(coded[-1]) // 4
                if held >= SHARD_IDS:
                    part, first = emit(docs, coded, first)
                    yield part
                    docs, coded, held = [], [], 0
        if docs:
            yield emit(docs, coded, first)[0]
        docs, coded = [], []
        blocks.release()

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else ""))
