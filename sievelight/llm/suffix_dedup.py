"""Removal of byte strings that an earlier document already has, by range-partitioned sparse suffixes.

A byte goes if it lies in a string of `width` bytes that also starts in a document with a smaller doc_id.  Of all suffixes only
those at anchors are sorted: the anchor of a string is the place, among its first width - K + 1, whose next K bytes have the
least hash, so equal strings have their anchor at the same place.  What is known of a string is then an anchor's suffix, and
some bytes before it.

Buckets of documents, ranges of hashes, ranges of suffixes and parts of strings send each other messages, one shuffle a round:

1. Hashes of anchors, sorted and delta-coded by each bucket of documents, meet by ranges of the hash; a bit comes back for
   each: whether other documents have it too.  Only such anchors can matter.
2. Their suffixes, with the bytes before them, are range-partitioned by their leading bytes with splitters of a sample that grows with
   the number of ranges.  Within a bucket equal ones are sent once.
3. Each range sorts its suffixes by multikey quicksort on eight bytes at a time, and what lies before them likewise; longest common
   prefixes of neighbours give classes of equal strings, and each string's least doc_id.  A bit for each string goes back.
4. Strings whose suffixes begin as a splitter does may go on across the boundary, however many ranges their prefix fills.  They meet
   by a 128-bit hash, and a bit goes back to those that have an earlier document in another range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

WIDTH = 50
#: Bytes that an anchor's hash covers.
K = 26
#: Bytes of a sort key: those from the anchor on, and those before it in reverse.
KEY = WIDTH + WIDTH - K
#: Bytes whose windows are hashed at once.
CHUNK = 1 << 19
#: Raw bytes of a bucket of documents, and so, about, of anchors that a range compares; buckets for each range of hashes.
BUCKET_BYTES = 5 << 20
BUCKETS_PER_RANGE = 4
#: Sampled suffixes for each range, and the documents that they are drawn from at least.
SAMPLE_PER_RANGE = 24
SAMPLE_DOCS = 2_000
#: Below so many rows a part of a multikey quicksort is sorted at once.
SMALL = 2_048
#: Kinds of messages.
BITS, PLACES, SEGMENTS, MASKS, EDGES, MORE = range(6)
MESSAGE = "to int, from int, kind int, block binary"

_B = 0x9E3779B97F4A7C15
_POW = [np.uint64(pow(_B, n, 1 << 64)) for n in range(65)]


def _hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on, by doubling."""
    n, done, size = len(x) - k + 1, 0, 1
    level, out = x.astype(np.uint64) + np.uint64(1), None
    while True:
        if k & size:
            part = level[done : done + n]
            out = part.copy() if out is None else out * _POW[size] + part
            done += size
        size *= 2
        if size > k:
            break
        level = level[: len(level) - size // 2] * _POW[size // 2] + level[size // 2 :]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """The first place of the least key among w from each place on."""
    best, at, size = keys, np.arange(len(keys), dtype=np.int32), 1
    while size < w:
        step = min(size, w - size)
        right = best[step:] < best[: len(best) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        best = np.minimum(best[step:], best[: len(best) - step])
        size += step
    return at


class Anchors:
    """Of some documents: for each anchor its document, hash, place, and the first and last string that it is the anchor of."""

    def __init__(self, docs: list[bytes], width: int = WIDTH, k: int = K):
        found: list[tuple[np.ndarray, ...]] = []
        group: list[tuple[int, int, int]] = []
        held = 0
        for i, doc in enumerate(docs):
            for a in range(0, len(doc) - width + 1, CHUNK):
                b = min(a + CHUNK, len(doc) - width + 1)
                group.append((i, a, b))
                held += b - a + width - 1
                if held >= CHUNK:
                    found.append(self._scan(docs, group, width, k))
                    group, held = [], 0
        if group:
            found.append(self._scan(docs, group, width, k))
        kinds = (np.int64, np.uint64, np.int64, np.int64, np.int64)
        self.doc, self.hash, self.at, self.lo, self.hi = (np.concatenate(c) if found else np.array([], t) for c, t in zip(zip(*found, strict=True) if found else [()] * 5, kinds, strict=True))

    @staticmethod
    def _scan(docs: list[bytes], group: list[tuple[int, int, int]], width: int, k: int) -> tuple[np.ndarray, ...]:
        x = np.frombuffer(b"".join(docs[i][a : b + width - 1] for i, a, b in group), np.uint8)
        h = _hashes(x, k)
        least = _least((h >> np.uint64(32)).astype(np.uint32), width - k + 1)
        sizes = np.array([b - a for _, a, b in group])
        base = np.concatenate([[0], np.cumsum(sizes + width - 1)[:-1]])
        part = np.repeat(np.arange(len(group)), sizes)
        places = np.arange(len(part)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + base[part]
        anchor = least[places]
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]))
        last = np.concatenate([first[1:], [len(part)]]) - 1
        own = part[first]
        shift = np.array([a for _, a, _ in group])[own] - base[own]
        doc = np.array([i for i, _, _ in group])[own]
        return doc, h[anchor[first]], anchor[first] + shift, places[first] + shift, places[last] + shift


def _shorten(h: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of the hashes, mixed once more: those of anchors are the least of many, so mostly small."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(64 - bits)


def _code(sorted_values: np.ndarray) -> bytes:
    """Rising integers as differences, a plane for each of their bytes."""
    d = np.diff(sorted_values, prepend=np.uint64(0))
    size = 4 if not len(d) or d.max() < 1 << 32 else 8
    planes = d.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _decode(blob: bytes) -> np.ndarray:
    size = blob[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.uint64), dtype=np.uint64)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian words by multikey quicksort: rows are parted by a pivot of one word; the equal ones go on with
    the next word."""
    n, width = words.shape
    order = np.arange(n)
    parts = [(0, n, 0)] if width else []
    while parts:
        lo, hi, k = parts.pop()
        rows = order[lo:hi]
        if hi - lo <= SMALL or k == width - 1:
            order[lo:hi] = rows[np.lexsort(words[rows, k:].T[::-1])]
            continue
        word = words[rows, k]
        some = word[:: max(1, len(word) // 63)]
        pivot = np.partition(some, len(some) // 2)[len(some) // 2]
        less, equal = word < pivot, word == pivot
        order[lo:hi] = np.concatenate([rows[less], rows[equal], rows[~(less | equal)]])
        x, y = lo + int(less.sum()), lo + int(less.sum() + equal.sum())
        parts += [(a, b, j) for a, b, j in ((lo, x, k), (x, y, k + 1), (y, hi, k)) if b - a > 1]
    return order


def _matrix(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, columns: int, step: int) -> np.ndarray:
    """Rows of bytes from `start` on, forwards or backwards, zero after `length`; padded to whole words."""
    out = np.zeros((len(start), -(-columns // 8) * 8), np.uint8)
    place = np.arange(columns)
    for a in range(0, len(start), 20_000):
        s, n = start[a : a + 20_000, None], length[a : a + 20_000, None]
        at = np.clip(s + step * place, 0, max(0, len(buffer) - 1))
        out[a : a + 20_000, :columns] = np.where(place < n, buffer[at], 0)
    return out


def _common(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row has in common with the one before (0 for the first)."""
    if not len(rows):
        return np.array([], np.int64)
    differ = rows[1:] != rows[:-1]
    n = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.concatenate([[0], n])


def earlier(segments: list[bytes], before: np.ndarray, docs: np.ndarray, edge: np.ndarray | None = None, width: int = WIDTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each segment, a bit for each of its strings: whether another segment has it for a smaller doc_id; and (segment, string)
    of all strings of segments at an `edge`.

    A segment has `before` bytes before its anchor; string number o starts o bytes after its own start.
    """
    n = len(segments)
    masks = np.zeros(n, np.uint32)
    buffer = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, n)
    after = sizes - before
    at_edge: list[tuple[np.ndarray, np.ndarray]] = []
    if n > 1:
        anchor = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + before
        right = _matrix(buffer, anchor, after, width, 1)
        left = _matrix(buffer, anchor - 1, before, width - k, -1)
        by_right, by_left = (multikey_order(m.view(">u8").astype(np.uint64)) for m in (right, left))
        common_right, common_left = _common(right[by_right]), _common(left[by_left])
        place_right, place_left = np.empty(n, np.int64), np.empty(n, np.int64)
        place_right[by_right], place_left[by_left] = np.arange(n), np.arange(n)
    for d in range(width - k + 1):
        has = np.flatnonzero((before >= d) & (after >= width - d))
        if edge is not None:
            at_edge.append(((own := has[edge[has]]), before[own] - d))
        if len(has) < 2:
            continue
        key = np.cumsum(common_right < width - d)[place_right[has]] * (n + 1) + np.cumsum(common_left < d)[place_left[has]]
        order = np.lexsort((docs[has], key))
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        least = docs[has][order][np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = has[order][least < docs[has][order]]
        masks[hit] |= np.uint32(1) << (before[hit] - d).astype(np.uint32)
    found = [np.concatenate(x) for x in zip(*at_edge, strict=True)] if at_edge else [np.array([], np.int64)] * 2
    return masks, found[0], found[1]


def meet(strings: list[bytes], docs: np.ndarray) -> np.ndarray:
    """Which strings also are there with a smaller doc_id."""
    which = np.unique(np.array(strings, f"S{len(strings[0])}") if strings else np.array([], "S1"), return_inverse=True)[1]
    least = np.full(which.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs)
    return least[which] < docs


class Bucket:
    """A bucket's documents in a fixed order, with their anchors."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str):
        rows = blocks.rejoined(table)
        ids = blocks.ids_of(rows, id_col)
        texts = rows.column(text_col).cast(pa.string()).cast(pa.binary()).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i] or b""))
        self.rows, self.ids = rows.take(pa.array(order, pa.int64())), ids[order]
        self.docs = [texts[i] or b"" for i in order]

    @cached_property
    def anchors(self) -> Anchors:
        return Anchors(self.docs)

    def hashes(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, which of them each anchor has, and which occur under more than one doc_id here."""
        distinct, which = np.unique(_shorten(self.anchors.hash, bits), return_inverse=True)
        ids = self.ids[self.anchors.doc]
        lo, hi = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(lo, which, ids)
        np.maximum.at(hi, which, ids)
        return distinct, which, lo < hi

    def shared(self, bits: int, ranges: int, replies: dict[int, bytes]) -> np.ndarray:
        """The anchors that other doc_ids have too."""
        distinct, which, several = self.hashes(bits)
        r = _ranges(distinct, bits, ranges)
        for part, blob in replies.items():
            at = np.flatnonzero(r == part)
            several[at] |= np.unpackbits(np.frombuffer(blob, np.uint8), count=len(at)).astype(bool)
        return np.flatnonzero(several[which])

    def segments(self, at: np.ndarray) -> Segments:
        """What is known of the strings of these anchors."""
        a = self.anchors
        doc, place, lo, hi = a.doc[at], a.at[at], a.lo[at], a.hi[at]
        before = place - lo
        docs, marks = self.docs, [bytes([i]) for i in range(WIDTH)]
        index: dict[bytes, int] = {}
        which = np.fromiter((index.setdefault(docs[d][x : y + WIDTH] + marks[n], len(index)) for d, x, y, n in zip(doc.tolist(), lo.tolist(), hi.tolist(), before.tolist(), strict=True)), np.int64, len(doc))
        # Documents are in ascending order of their ids, so a segment's first place has its least doc_id.
        first = np.unique(which, return_index=True)[1]
        return Segments(list(index), before[first], self.ids[doc[first]], doc, lo, hi, which)


@dataclass
class Segments:
    """Distinct segments (bytes, with the bytes before the anchor as a last one) with their least doc_id, and each place of them."""

    keys: list[bytes]
    before: np.ndarray
    least: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    which: np.ndarray

    def routes(self, cuts: np.ndarray) -> np.ndarray:
        """The range of suffixes that each segment belongs to."""
        if not len(cuts) or not self.keys:
            return np.zeros(len(self.keys), np.int64)
        # Most are told by their first bytes; the others, and those with zeros there, by the whole key.
        before = self.before.tolist()
        heads, ends = np.array([k[n : n + 8] for k, n in zip(self.keys, before, strict=True)], "S8"), cuts.astype("S8")
        out, upto = np.searchsorted(ends, heads, side="left"), np.searchsorted(ends, heads, side="right")
        close = np.flatnonzero(out != upto)
        out[close] = np.searchsorted(cuts, np.array([sort_key(self.keys[i][:-1], before[i]) for i in close.tolist()], f"S{KEY}"), side="right")
        return out


def sort_key(segment: bytes, before: int) -> bytes:
    """The bytes from the anchor on, filled up with zeros, then those before it in reverse."""
    return segment[before : before + WIDTH].ljust(WIDTH, b"\0") + segment[:before][::-1]


def at_edges(segments: list[bytes], before: np.ndarray, part: int, cuts: np.ndarray) -> np.ndarray:
    """Which segments of a range begin as a splitter at its ends does."""
    ends = {bytes(c)[:K].ljust(K, b"\0") for c in cuts[max(0, part - 1) : part + 1]}
    return np.fromiter((s[n : n + K] in ends for s, n in zip(segments, before.tolist(), strict=True)), bool, len(segments))


def _ranges(h: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """The range of each shortened hash; hashes are even, so ranges are."""
    low = max(0, bits - 32)
    return ((h >> np.uint64(low)) * np.uint64(ranges) >> np.uint64(bits - low)).astype(np.int64)


def sampled_cuts(rows: DataFrame, id_col: str, text_col: str, n_rows: int, n_bytes: int, ranges: int) -> np.ndarray:
    """ranges - 1 splitters of sort keys, from about SAMPLE_PER_RANGE anchors for each range; a key counts as often as it is likely
    to be sent, which is once for a bucket at most (there are as many buckets as ranges).

    Documents are drawn by a hash of id and text, SAMPLE_DOCS or more so that they have 32 times the anchors that are wanted,
    and anchors evenly from each.  What comes to the driver grows with the number of ranges, so with the root of a large input.
    """
    if ranges < 2:
        return np.array([], f"S{KEY}")
    wanted, anchors = SAMPLE_PER_RANGE * ranges, max(1, n_bytes // 13)
    share = min(1.0, max(32 * wanted / anchors, SAMPLE_DOCS / max(1, n_rows)))
    every = max(1, int(share * anchors / wanted))
    drawn = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))
    sample = rows.filter(drawn).select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = 0
        for batch in batches:
            docs = [t or b"" for t in pa.Table.from_batches([batch]).column("text").cast(pa.binary()).to_pylist()]
            a = Anchors(docs)
            at = np.arange(skip, len(a.at), every)
            skip = (skip - len(a.at)) % every
            out = [sort_key(docs[d][lo : hi + WIDTH], p - lo) for d, p, lo, hi in zip(a.doc[at].tolist(), a.at[at].tolist(), a.lo[at].tolist(), a.hi[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["key"])

    got = np.array([bytes(r[0]) for r in sample.mapInArrow(run, "key binary").collect()], f"S{KEY}")
    keys, times = np.unique(got, return_counts=True)
    weight = np.cumsum(np.minimum(times * max(1.0, anchors / max(1, len(got))), ranges))
    return keys[np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)] if len(keys) else keys


def _messages(to: list, sender: int, kind: int, sent: list[bytes]) -> pa.Table:
    n = len(sent)
    return pa.table({"to": pa.array(to, pa.int32()), "from": pa.array([sender] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "block": pa.array(sent, pa.binary())})


def _said(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """(sender, block) of the messages of a kind."""
    return [(r["from"], r["block"]) for r in table.to_pylist() if r["kind"] == kind]


def _removed(df: DataFrame, id_col: str, text_col: str, whole_characters: bool) -> DataFrame:
    """df's columns, numbered, with n_bytes, n_removed, n_spans and kept."""
    spark = df.sparkSession
    blocks.session_limits(spark)
    names = df.columns
    rows = df.select(*blocks.numbered(names))
    id_at, text_at = (f"c_{names.index(c)}" for c in (id_col, text_col))
    n_rows, n_bytes = blocks.extent(rows, text_at)
    n_buckets = blocks.bucket_count(n_bytes, BUCKET_BYTES, 16)
    n_ranges, n_parts = -(-n_buckets // BUCKETS_PER_RANGE), n_buckets
    bits = min(60, max(32, math.ceil(math.log2(n_bytes / 13 + 2)) + 14))
    cuts = sampled_cuts(rows, id_at, text_at, n_rows, n_bytes, n_parts)
    labels = blocks.even_labels(spark, n_buckets + n_ranges + 2 * n_parts)
    buckets, ranges, suffixes, strings = np.split(labels, np.cumsum([n_buckets, n_ranges, n_parts]))

    def assign(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        ids = blocks.ids_of(table, id_at).astype(np.uint64)
        h = ((ids ^ (ids >> np.uint64(31))) * np.uint64(_B)) >> np.uint64(33)
        yield from blocks.by_bucket(buckets[(h % np.uint64(n_buckets)).astype(np.int64)])

    def ask(table: pa.Table) -> pa.Table:
        h = Bucket(table, id_at, text_at).hashes(bits)[0]
        r = _ranges(h, bits, n_ranges)
        edges = np.searchsorted(r, np.arange(n_ranges + 1))
        parts = [i for i in range(n_ranges) if edges[i] < edges[i + 1]]
        return _messages([ranges[i] for i in parts], table.column("bucket")[0].as_py(), BITS, [_code(h[edges[i] : edges[i + 1]]) for i in parts])

    def answer(table: pa.Table) -> pa.Table:
        lists = [_decode(b) for b in table.column("block").to_pylist()]
        every = np.concatenate(lists)
        every.sort()
        several = np.unique(every[1:][every[1:] == every[:-1]])
        bitmaps = []
        for h in lists:
            at = np.searchsorted(several, h)
            bitmaps.append(np.packbits(several[np.minimum(at, len(several) - 1)] == h if len(several) else np.zeros(len(h), bool)).tobytes())
        return _messages(table.column("from").to_pylist(), table.column("to")[0].as_py(), BITS, bitmaps)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _messages([], 0, 0, [])
        if left.num_rows:
            own, b = left.column("bucket")[0].as_py(), Bucket(left, id_at, text_at)
            number = {int(x): i for i, x in enumerate(ranges)}
            found = b.segments(b.shared(bits, n_ranges, {number[f]: x for f, x in _said(right, BITS)}))
            route = found.routes(cuts)
            if len(found.keys):
                places = pa.table({"doc": pa.array(found.doc, pa.int32()), "lo": pa.array(found.lo, pa.int32()), "more": pa.array(found.hi - found.lo, pa.uint8()), "which": pa.array(found.which, pa.int32())})
                kept = pa.table({"least": pa.array(found.least), "route": pa.array(suffixes[route], pa.int32())})
                parts = list(blocks.by_bucket(route))
                sent = [blocks.pack(pa.table({"segment": pa.array([found.keys[i][:-1] for i in at.tolist()], pa.binary()), "before": pa.array(found.before[at], pa.uint8()), "doc": pa.array(found.least[at])})) for _, at in parts]
                out = pa.concat_tables([_messages([own, own], own, PLACES, [blocks.pack(places), blocks.pack(kept)]), _messages([suffixes[i] for i, _ in parts], own, SEGMENTS, sent)])
        return out

    def compare(table: pa.Table) -> pa.Table:
        """A range's segments; messages to buckets go on as they are."""
        if table.column("kind")[0].as_py() != SEGMENTS:
            return table
        label = table.column("to")[0].as_py()
        part = int(np.flatnonzero(suffixes == label)[0])
        got = [blocks.unpack(b.as_buffer()) for b in table.column("block")]
        full = pa.concat_tables(got)
        segments, before, docs = full.column("segment").to_pylist(), full.column("before").to_numpy().astype(np.int64), full.column("doc").to_numpy()
        masks, owner, string = earlier(segments, before, docs, at_edges(segments, before, part, cuts) if len(cuts) else None)
        starts = np.concatenate([[0], np.cumsum([g.num_rows for g in got])])
        senders = table.column("from").to_pylist()
        out = [_messages(senders, label, MASKS, [zstandard.ZstdCompressor(level=1).compress(masks[a:b].tobytes()) for a, b in zip(starts, starts[1:], strict=False)])]
        if len(owner):
            keys = [hashlib.blake2b(segments[i][o : o + WIDTH], digest_size=16).digest() for i, o in zip(owner.tolist(), string.tolist(), strict=True)]
            message = np.searchsorted(starts, owner, side="right") - 1
            edge = pa.table({"key": pa.array(keys, pa.binary()), "doc": docs[owner], "bucket": pa.array(np.array(senders, np.int32)[message]), "route": pa.array(np.full(len(owner), label, np.int32)), "at": pa.array((owner - starts[message]).astype(np.int32)), "string": pa.array(string.astype(np.uint8))})
            to = np.fromiter((int.from_bytes(k[:7], "little") % n_parts for k in keys), np.int64, len(keys))
            some = [(strings[i], blocks.pack(edge.take(pa.array(at)))) for i, at in blocks.by_bucket(to)]
            out.append(_messages([i for i, _ in some], label, EDGES, [x for _, x in some]))
        return pa.concat_tables(out)

    def across(table: pa.Table) -> pa.Table:
        """Strings from both sides of boundaries; messages to buckets go on as they are."""
        if table.column("kind")[0].as_py() != EDGES:
            return table
        edge = pa.concat_tables([blocks.unpack(b.as_buffer()) for b in table.column("block")])
        hit = edge.filter(pa.array(meet([k + b"\1" for k in edge.column("key").to_pylist()], edge.column("doc").to_numpy())))
        parts = list(blocks.by_bucket(hit.column("bucket").to_numpy()))
        sent = [blocks.pack(hit.select(["route", "at", "string"]).take(pa.array(at))) for _, at in parts]
        return _messages([i for i, _ in parts], table.column("to")[0].as_py(), MORE, sent)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Bucket(left, id_at, text_at)
        place, owner = _hits(b, right)
        edges = np.searchsorted(owner, np.arange(len(b.docs) + 1))
        n_removed, n_spans, kept = [], [], []
        for i, doc in enumerate(b.docs):
            removed, spans, out, end = 0, 0, [], 0
            if edges[i] < edges[i + 1]:
                s = place[edges[i] : edges[i + 1]]
                first = np.concatenate([[True], s[1:] > s[:-1] + WIDTH])
                lo = s[first]
                hi = np.concatenate([s[:-1][first[1:]], s[-1:]]) + WIDTH
                for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                    out.append(doc[end:x])
                    removed, spans, end = removed + y - x, spans + 1, y
            n_removed.append(removed)
            n_spans.append(spans)
            kept.append(b"".join([*out, doc[end:]]) if out else doc)
        if whole_characters:
            kept = [k.decode("utf-8", "ignore").encode() if n else k for k, n in zip(kept, n_removed, strict=True)]
        cols = {f"c_{i}": b.rows.column(f"c_{i}") for i in range(len(names))}
        return pa.table(cols | {"n_bytes": pa.array([len(d) for d in b.docs], pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    round_of = lambda rows, f: rows.groupBy("to").applyInArrow(blocks.releasing(f), MESSAGE)
    dealt = blocks.deal(rows, assign)
    bitmaps = round_of(dealt.groupBy("bucket").applyInArrow(blocks.releasing(ask), MESSAGE), answer)
    sent = dealt.groupBy("bucket").cogroup(bitmaps.groupBy("to")).applyInArrow(blocks.releasing(send), MESSAGE)
    masks = round_of(round_of(sent, compare), across)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return dealt.groupBy("bucket").cogroup(masks.groupBy("to")).applyInArrow(blocks.releasing(finish), ", ".join([*kinds, "n_bytes long, n_removed long, n_spans long, kept binary"]))


def _hits(b: Bucket, messages: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where strings of a bucket's documents start that an earlier document has, and whose they are, in order."""
    held = [blocks.unpack(x) for _, x in _said(messages, PLACES)]
    if not held:
        return np.array([], np.int64), np.array([], np.int64)
    if "least" in held[0].column_names:
        held.reverse()
    (doc, lo, more, which), (least, route) = ([c.to_numpy().astype(np.int64) for c in t.columns] for t in held)
    masks = np.zeros(len(least), np.uint32)
    order = np.argsort(route, kind="stable")
    first = {int(r): int(i) for r, i in zip(*np.unique(route[order], return_index=True), strict=True)}
    for sender, block in _said(messages, MASKS):
        got = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint32)
        masks[order[first[sender] : first[sender] + len(got)]] = got
    for _, block in _said(messages, MORE):
        extra = blocks.unpack(block)
        start = np.fromiter((first[r] for r in extra.column("route").to_pylist()), np.int64, extra.num_rows)
        np.bitwise_or.at(masks, order[start + extra.column("at").to_numpy()], np.uint32(1) << extra.column("string").to_numpy().astype(np.uint32))
    mask = np.where(least[which] < b.ids[doc], np.uint32(0xFFFFFFFF), masks[which])
    some = np.flatnonzero(mask)
    times = more[some] + 1
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    hit = (np.repeat(mask[some], times) >> step.astype(np.uint32)) & np.uint32(1) == 1
    return (np.repeat(lo[some], times) + step)[hit], np.repeat(doc[some], times)[hit]


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """All columns of df with the kept bytes and what was removed: n_bytes, n_removed, n_spans long, kept binary.

    Null texts count as empty; a null doc_id is less than all others; rows that share a doc_id don't match each other.  A
    document shorter than the width stays as it is.  Columns n_bytes, n_removed, n_spans, kept of df are replaced.
    With whole_characters, bytes of a character that a cut leaves incomplete are left out of `kept`.
    """
    made = ("n_bytes", "n_removed", "n_spans", "kept")
    own = [F.col(f"c_{i}").alias(c) for i, c in enumerate(df.columns) if c not in made]
    return _removed(df, id_col, text_col, whole_characters).select(*own, *made)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the sha256 of the kept bytes."""
    out = dedup(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the kept bytes as its texts, its other columns as they are, whatever their names; no row goes, a text may become empty.

    What a cut leaves of a character goes as well; a text that loses nothing stays as it is, null too.
    """
    old = F.col(f"c_{df.columns.index(text_col)}")
    text = F.when(F.col("n_removed") == 0, old).otherwise(F.col("kept").cast("string"))
    out = _removed(df, id_col, text_col, whole_characters=True)
    return out.select(*[text.alias(c) if c == text_col else F.col(f"c_{i}").alias(c) for i, c in enumerate(df.columns)])
