"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a piece wherever it equals block size - 1 modulo the block size; each piece
gives one character, so an edit changes few characters.  A fingerprint has the signatures for a block size and its double;
two fingerprints are compared at a block size that both have, by the edit distance of their signatures.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

WINDOW = 7
LEAST_BLOCK = 3
#: Characters of a signature at most; a block size is chosen so that at least half as many are likely.
LENGTH = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Signatures that share no run of so many characters are unlike, if both are as long.
COMMON = 7
_PART = 1 << 20


def rolling(data: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte of `data`, which follows the bytes `before` (less than a window at the start)."""
    x = np.concatenate([np.zeros(WINDOW - len(before), np.uint32), before.astype(np.uint32), data.astype(np.uint32)])
    n = len(data)
    total, weighted, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for back in range(WINDOW):
        part = x[WINDOW - back : WINDOW - back + n]
        total += part
        weighted += np.uint32(WINDOW - back) * part
        mixed ^= part << np.uint32(5 * back)
    return total + weighted + mixed


def triggers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(end of piece, largest doubling k) where the hash triggers at block size LEAST_BLOCK * 2**k."""
    ends, powers = [], []
    raw = np.frombuffer(data, np.uint8)
    for a in range(0, len(raw), _PART):
        h = rolling(raw[a : a + _PART], raw[max(0, a - WINDOW) : a]) + np.uint32(1)
        at = np.flatnonzero((h % np.uint32(LEAST_BLOCK) == 0) & (h != 0))
        low = h[at] & (np.uint32(0) - h[at])  # the lowest bit that is set
        ends.append(at + a + 1)
        powers.append(np.round(np.log2(low)).astype(np.int64))
    return (np.concatenate(ends), np.concatenate(powers)) if ends else (np.array([], np.int64), np.array([], np.int64))


def _signature(data: memoryview, ends: np.ndarray) -> str:
    """One character for each piece; what lies after LENGTH - 1 pieces is the last."""
    cuts = [0, *ends[: LENGTH - 1].tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    return "".join(ALPHABET[zlib.crc32(data[a:b]) & 63] for a, b in zip(cuts, cuts[1:], strict=False))


def fingerprint(text: str) -> str:
    """block size:signature:signature at the double block size; "3::" for an empty text."""
    data = text.encode("utf-8", "surrogatepass")
    ends, powers = triggers(data)
    k = 0
    while LEAST_BLOCK * 2**k * LENGTH < len(data):
        k += 1
    while k and np.count_nonzero(powers >= k) < LENGTH // 2 - 1:
        k -= 1
    view = memoryview(data)
    return f"{LEAST_BLOCK * 2**k}:{_signature(view, ends[powers >= k])}:{_signature(view, ends[powers >= k + 1])}"


def _squeezed(s: str) -> str:
    """Runs of more than three equal characters cut to three: they say little."""
    return "".join(c for i, c in enumerate(s) if i < 3 or not c == s[i - 1] == s[i - 2] == s[i - 3])


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _likeness(a: str, b: str) -> float:
    """1 less the edit distance (a change counts as two edits) over both lengths; 0 without a common run, except for short signatures."""
    a, b = _squeezed(a), _squeezed(b)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if min(len(a), len(b)) < COMMON:
        return 2 * common_length(a, b) / (len(a) + len(b))
    runs = {a[i : i + COMMON] for i in range(len(a) - COMMON + 1)}
    if not any(b[i : i + COMMON] in runs for i in range(len(b) - COMMON + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(f: str, g: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where no block size is common."""
    if f == g:
        return 1.0
    (n, a, a2), (m, b, b2) = f.split(":"), g.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(_likeness(a, b), _likeness(a2, b2))
    if n == 2 * m:
        return _likeness(a, b2)
    return _likeness(a2, b) if m == 2 * n else 0.0


def edited(text: str, other: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many of the other text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compare_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they and the next document's are.

    Next is by ascending doc_id (null first; rows that share a doc_id: by their text), after the last the first; a lone
    document is its own next.  Null texts count as empty.  Documents are dealt by ranges of doc_id; the least row of each
    range also goes to the range before it.
    """
    blocks.session_limits(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    _, n_bytes = blocks.extent(rows, "text")
    cuts = blocks.splitters(rows, "doc_id", blocks.bucket_count(n_bytes))
    firsts = _firsts(rows, cuts)
    present = sorted(firsts)
    before = {b: present[i - 1] for i, b in enumerate(present)}
    least = {firsts[b]: before[b] for b in present}

    def assign(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        ids = blocks.ids_of(table)
        yield from blocks.by_bucket(np.searchsorted(cuts, ids, side="right"))
        for i in np.flatnonzero(np.isin(ids, list(least))):
            # A bucket number below zero marks the row that follows a range.
            yield -1 - least[int(ids[i])], np.array([i])

    def score(table: pa.Table) -> pa.Table:
        own, next_rows = [], []
        for number, block in zip(table.column("bucket").to_pylist(), table.column("block"), strict=True):
            got = blocks.unpack(block.as_buffer())
            (own if number >= 0 else next_rows).extend(zip(blocks.ids_of(got).tolist(), got.column("text").to_pylist(), strict=True))
        own.sort()
        own.append(min(next_rows))
        out: list[list] = [[] for _ in range(7)]
        prints = [fingerprint(t) for _, t in own]
        for (doc, text), (_, other), mine, theirs in zip(own, own[1:], prints, prints[1:], strict=False):
            new = edited(text, other)
            its = fingerprint(new)
            for col, x in zip(out, (None if doc == np.iinfo(np.int64).min else doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mine, its, likeness(mine, its), likeness(mine, theirs)), strict=True):
                col.append(x)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = blocks.deal(rows, assign)
    at = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    return dealt.withColumn("range", at).groupBy("range").applyInArrow(blocks.releasing(score), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _firsts(rows: DataFrame, cuts: np.ndarray) -> dict[int, int]:
    """The least doc_id of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            ids = blocks.ids_of(pa.Table.from_batches([batch]))
            for b, at in blocks.by_bucket(np.searchsorted(cuts, ids, side="right")):
                found[b] = min(found.get(b, int(ids[at].max())), int(ids[at].min()))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["b", "first"])

    got = rows.select("doc_id").mapInArrow(run, "b int, first long").groupBy("b").agg(F.min("first")).collect()
    return {r[0]: r[1] for r in got}
