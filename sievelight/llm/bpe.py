"""Byte-level BPE by overlapping chunks.

Texts are cut at places where any pre-tokeniser scan is back in step whatever came before: before a space that
follows a non-space.  No match of the pre-token pattern contains a non-space followed by white space, so such a place
always is a pre-token boundary, and what lies between two of them encodes on its own.  Encoded pieces are
remembered, since words repeat.  A text that holds the string of an added token (`<|endoftext|>`) is encoded as a whole.

Long texts are cut into overlapping chunks that are scanned in parallel; two neighbours are stitched at the first
boundary that both saw in their overlap, away from the left one's cut end.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import itertools
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

Encoder = Callable[[str], list[int]]

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: A match can depend on so many characters after its end (white space before a word, and the contractions).
LOOKAHEAD = 3
#: Documents above this are spread: their chunks are rows of their own, dealt to all tasks.
SPREAD_CHARS = 1 << 20
#: Characters of text whose pieces are told apart at once.
SLICE_CHARS = 4 << 20

# Fixed value: the pre-token pattern that the rules for pieces hold for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_IRREGULAR = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
_LINES = re.compile(r"\S+(?:\n\S+)+")
#: ASCII marks at the end of a piece.
_MARKS = re.compile(r"[!-/:-@\[-`{-~]+\Z")
_MARK_CHARS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the rest for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary file: a tokenizers JSON file, or ranks for tiktoken with their pre-token pattern."""

    path: str
    pattern: str = ""

    def encoders(self) -> tuple[Encoder, Encoder]:
        """Encode any text as the library does by default, and, faster, one pre-token; ranks have no special tokens."""
        if self.pattern:
            if self.pattern != PATTERN:
                raise ValueError("texts are cut into pieces by rules for another pre-token pattern")
            import tiktoken

            coder = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=read_ranks(self.path), special_tokens={})
            return coder.encode_ordinary, coder._encode_single_piece
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        model, letters = whole.model, _byte_letters()
        space = letters[ord(" ")]

        def word(text: str) -> list[int]:
            mapped = text.replace(" ", space) if text.isascii() else text.encode().decode("latin-1").translate(letters)
            return [t.id for t in model.tokenize(mapped)]

        return (lambda text: whole.encode(text, add_special_tokens=False).ids), word

    def added(self) -> tuple[str, ...]:
        """The strings of added tokens: a text that holds one isn't cut, as the library finds them before all else."""
        if self.pattern:
            return ()
        with open(self.path, encoding="utf-8") as f:
            return tuple(t["content"] for t in json.load(f).get("added_tokens") or [])

    def cache(self) -> PieceCache:
        """This process's cache: Python workers serve many tasks."""
        if self not in _CACHES:
            # The caches hold strings and bytes only: looking for cycles among them every few hundred tokens costs a fifth.
            gc.set_threshold(200_000, 20, 100)
            _CACHES[self] = PieceCache(*self.encoders(), self.added())
        return _CACHES[self]


_CACHES: dict[Vocabulary, PieceCache] = {}


def pieces(text: str) -> list[str]:
    """The text, cut before each space after a non-space; the space itself is left out of the piece it begins."""
    return _CUT.split(text) if _IRREGULAR.search(text) else text.split(" ")


class Recent(dict):
    """What `make` gives for a key, remembered; `older` has what an earlier one remembered."""

    def __init__(self, make: Callable[[str], bytes], older: dict | None = None):
        self.make, self.older = make, older or {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value

    def turned(self, limit: int) -> Recent:
        """This one until it has `limit` keys, then a new one that still can look into it."""
        if len(self) < limit:
            return self
        self.older = {}
        return Recent(self.make, self)


class PieceTable:
    """What `make` gives for strings, remembered in Arrow arrays: a whole array of strings is looked up at once."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int):
        self.make, self.limit = make, limit
        self.keys, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def of(self, strings: pa.StringArray) -> pa.LargeBinaryArray:
        """The value of each string; the strings differ from each other."""
        at = pc.index_in(strings, value_set=self.keys)
        unknown = pc.is_null(at)
        fresh = strings.filter(unknown)
        made = pa.array(self.make(fresh.to_pylist()), pa.large_binary())
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[unknown.to_numpy(zero_copy_only=False)] = len(self.keys) + np.arange(len(fresh))
        values = pa.concat_arrays([self.ids, made]).take(pa.array(place))
        if len(self.keys) + len(fresh) > self.limit:
            # Only these strings stay.
            self.keys, self.ids, fresh, made = self.keys[:0], self.ids[:0], strings, values
        short = pc.less_equal(pc.binary_length(fresh), 64)
        fresh, made = fresh.filter(short)[: self.limit], made.filter(short)[: self.limit]
        self.keys, self.ids = pa.concat_arrays([self.keys, fresh]), pa.concat_arrays([self.ids, made])
        return values


class PieceCache:
    """Ids of pieces as little-endian unsigned 32-bit integers, by the piece without its leading space.

    The place between a letter or digit and a following mark is a pre-token boundary as well, so a piece's last marks are
    looked up apart from what stands before them, and so are the lines of a piece.
    """

    def __init__(self, encode: Encoder, encode_word: Encoder, added: tuple[str, ...] = (), limit: int = 400_000):
        self.encode, self.encode_word, self.added, self.limit = encode, encode_word, added, limit
        self.marks = Recent(lambda marks: array("I", encode(marks)).tobytes())
        self.known = Recent(self._piece)
        self.starts = Recent(self._start)
        self.table = PieceTable(lambda pieces: list(map(self._piece, pieces)), limit)

    def _turn(self) -> None:
        """Between texts: what hasn't been used for long goes."""
        self.known, self.starts, self.marks = self.known.turned(self.limit), self.starts.turned(self.limit // 8), self.marks.turned(20_000)

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return array("I", self.encode_word(" " + piece)).tobytes()
        # A line end between two non-spaces is a pre-token of its own, and the next line begins without a space.
        if _LINES.fullmatch(piece):
            first, *lines = piece.split("\n")
            return self.known[first] + b"".join(self.marks["\n"] + self.starts[x] for x in lines)
        last = _MARKS.search(piece)
        if last and last.start() and piece[last.start() - 1].isalnum():
            return self.known[piece[: last.start()]] + self.marks[last[0]]
        return array("I", self.encode(" " + piece)).tobytes()

    def _start(self, piece: str) -> bytes:
        last = _MARKS.search(piece)
        if last and last.start() and piece[last.start() - 1].isalnum():
            return self.starts[piece[: last.start()]] + self.marks[last[0]]
        return array("I", (self.encode_word if piece.isalpha() else self.encode)(piece)).tobytes()

    def holds_added(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def text_ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.holds_added(text):
            return array("I", self.encode(text)).tobytes()
        self._turn()
        first, *rest = pieces(text)
        return self.starts[first] + b"".join(map(self.known.__getitem__, rest))

    def _plain(self, text: str) -> bool:
        """Whether the text is cut at every single space, and isn't too long to be cut at once."""
        return len(text) <= SPREAD_CHARS and not _IRREGULAR.search(text) and not self.holds_added(text)

    def _unlike(self, pieces: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of pieces that differ from each other, joined from those of what stands before the last marks and of these marks."""
        bare = pc.utf8_rtrim(pieces, characters=_MARK_CHARS)
        ends = pc.utf8_slice_codeunits(bare, -1).dictionary_encode()
        sound = np.array([c.isalnum() for c in ends.dictionary.to_pylist()], bool)[ends.indices.to_numpy()]
        stem = pc.if_else(pa.array(sound), bare, pieces).dictionary_encode()
        sizes = (pc.subtract(pc.binary_length(pieces), pc.binary_length(bare)).to_numpy() * sound).astype(np.int64)
        upto = np.cumsum(sizes)
        offsets = np.frombuffer(pieces.buffers()[1], "<i4", len(pieces) + 1, 4 * pieces.offset)
        at = np.repeat(offsets[1:] - upto, sizes) + np.arange(sizes.sum())
        chars = np.frombuffer(pieces.buffers()[2], np.uint8)[at] if len(at) else np.array([], np.uint8)
        marks = pa.StringArray.from_buffers(len(pieces), pa.py_buffer(np.concatenate([[0], upto]).astype("<i4")), pa.py_buffer(chars)).dictionary_encode()
        tails = pa.array([self.marks[m] if m else b"" for m in marks.dictionary.to_pylist()], pa.large_binary())
        return pc.binary_join_element_wise(self.table.of(stem.dictionary).take(stem.indices), tails.take(marks.indices), pa.scalar(b"", pa.large_binary()))

    def several(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; those that are plain are cut at once, and each of their pieces is looked up once for all."""
        self._turn()
        plain = [self._plain(t) for t in texts]
        cut = pc.split_pattern(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.string()), " ")
        edge, parts = cut.offsets.to_numpy(), cut.flatten()
        first = np.zeros(len(parts), bool)
        first[edge[:-1]] = True
        begin = [self.starts[x] for x in parts.filter(pa.array(first)).to_pylist()]
        rest = parts.filter(pa.array(~first)).dictionary_encode()
        codes = np.empty(len(parts), np.int64)
        codes[first], codes[~first] = len(rest.dictionary) + np.arange(len(begin)), rest.indices.to_numpy()
        ids = pa.concat_arrays([self._unlike(rest.dictionary), pa.array(begin, pa.large_binary())]).take(pa.array(codes))
        at, held = np.frombuffer(ids.buffers()[1], "<i8")[edge].tolist(), memoryview(ids.buffers()[2] or b"")
        coded = iter([bytes(held[a:b]) for a, b in itertools.pairwise(at)])
        return [next(coded) if p else encode_text(self, t) for t, p in zip(texts, plain, strict=True)]

    def chunk_ids(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Where each piece starts, the ids before it, and all ids."""
        self._turn()
        parts = pieces(text)
        ids = [array("I", self.encode(parts[0])).tobytes(), *map(self.known.__getitem__, parts[1:])]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        sizes[1:] += 1
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.concatenate([[0], np.cumsum(counts)[:-1]]), b"".join(ids)


def chunk_spans(n: int, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, int]]:
    """(start, end) of overlapping chunks that cover n characters."""
    return [(a, min(n, a + chunk + overlap)) for a in range(0, max(n, 1), chunk)]


def stitch(cache: PieceCache, chunks: list[tuple[int, str, tuple[np.ndarray, np.ndarray, bytes] | None]]) -> bytes:
    """Ids of the whole text from (start, text, encoded chunk) in order of start.

    At each seam the left chunk's pieces are kept up to the first boundary that both chunks have in the overlap and that
    is at least LOOKAHEAD characters away from the left one's end.  Where an overlap holds no such boundary (one run longer than
    it), the right chunk is appended to the left and scanned again from the last kept boundary.
    """
    out: list[bytes] = []
    start, text, coded = chunks[0]
    coded = coded or cache.chunk_ids(text)
    kept = 0  # ids of the present chunk that earlier output holds
    for nxt, more, its in chunks[1:]:
        its = its or cache.chunk_ids(more)
        left, right = coded[0] + start, its[0][1:] + nxt
        both = np.intersect1d(left[left <= start + len(text) - LOOKAHEAD], right)
        if len(both):
            at = both[0]
            upto = coded[1][np.searchsorted(left, at)]
            out.append(coded[2][4 * kept : 4 * upto])
            kept = its[1][np.searchsorted(its[0] + nxt, at)]
            start, text, coded = nxt, more, its
        else:
            sure = left[left <= start + len(text) - LOOKAHEAD]
            at = int(sure[-1]) if len(sure) else start
            upto = coded[1][np.searchsorted(left, at)]
            if upto >= kept:
                out.append(coded[2][4 * kept : 4 * upto])
                text, start, kept = text[at - start :] + more[start + len(text) - nxt :], at, 0
            else:
                text = text + more[start + len(text) - nxt :]
            coded = cache.chunk_ids(text)
    out.append(coded[2][4 * kept :])
    return b"".join(out)


def encode_text(cache: PieceCache, text: str | None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> bytes:
    if not text or len(text) <= chunk + overlap or cache.holds_added(text):
        return cache.text_ids(text or "")
    return stitch(cache, [(a, text[a:b], None) for a, b in chunk_spans(len(text), chunk, overlap)])


def encode_texts(cache: PieceCache, texts: Iterable[str | None], size: int = SLICE_CHARS) -> Iterator[bytes]:
    """What encode_text gives for each text, by slices of about `size` characters."""
    run, held = [], 0
    for text in texts:
        run.append(text or "")
        held += len(run[-1])
        if held >= size:
            yield from cache.several(run)
            run, held = [], 0
    yield from cache.several(run)


def encode(df: DataFrame, text_col: str, vocabulary: Vocabulary, keep: list[str], ids_col: str = "ids", spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """The columns `keep` and the token ids (binary, little-endian unsigned 32-bit) of each whole text.

    Null and empty texts give no ids.  Rows may repeat; each is encoded.  Documents above spread_chars are cut into chunk
    rows, dealt to all tasks, and stitched in a group of their own, unless they hold an added token's string.
    """
    blocks.session_limits(df.sparkSession)
    spec = df.select(*keep).schema
    rows = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in spec.fields]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = vocabulary.cache()
        for batch in batches:
            ids = [encode_text(cache, t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], [*keep, ids_col])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                key = hashlib.sha256(blocks.pack(batch.slice(i, 1))).hexdigest()
                row = blocks.pack(batch.slice(i, 1).select(keep)) if keep else b""
                for k, (a, b) in enumerate(chunk_spans(len(text))):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int32()), pa.array([a], pa.int64()), pa.array([text[a:b]]), pa.array([row if not k else b""], pa.binary())], ["_key", "_k", "_start", "_chunk", "_row"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = vocabulary.cache()
        for batch in batches:
            coded = [cache.chunk_ids(t) for t in batch.column(3).to_pylist()]
            more = [pa.array([x.astype("<i8").tobytes() if k < 2 else x for x in col], pa.binary()) for k, col in enumerate(zip(*coded, strict=True))] if coded else [pa.array([], pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_at", "_before", "_ids"])

    def join(table: pa.Table) -> pa.Table:
        cache = vocabulary.cache()
        got = sorted(table.to_pylist(), key=lambda r: r["_k"])
        ids = stitch(cache, [(r["_start"], r["_chunk"], (np.frombuffer(r["_at"], "<i8"), np.frombuffer(r["_before"], "<i8"), r["_ids"])) for r in got])
        return blocks.unpack(got[0]["_row"]).append_column(ids_col, pa.array([ids], pa.binary()))

    out = ", ".join([*fields, f"`{ids_col}` binary"])
    longer = F.length("_text") > spread_chars
    for token in vocabulary.added():
        longer = longer & ~F.contains("_text", F.lit(token))
    few = rows.filter(~F.coalesce(longer, F.lit(False))).mapInArrow(short, out)
    # A repeated long row would share its key: it is told apart by a number within its partition.
    chunks = rows.filter(longer).mapInArrow(cut, "_key string, _k int, _start long, _chunk string, _row binary")
    chunks = chunks.withColumn("_key", F.concat_ws("/", "_key", F.row_number().over(_by_chunk()).cast("string")))
    many = chunks.repartition("_key", "_k").mapInArrow(scan, "_key string, _k int, _start long, _chunk string, _row binary, _at binary, _before binary, _ids binary")
    return few.unionByName(many.groupBy("_key").applyInArrow(blocks.releasing(join), out))


def _by_chunk():
    from pyspark.sql import Window

    return Window.partitionBy("_key", "_k").orderBy("_start")


def decoder(path: str) -> Callable[[bytes], bytes]:
    """Raw bytes of ids; what isn't valid UTF-8 by itself stays as it is."""
    table = [b""] * (1 + max((ranks := read_ranks(path)).values()))
    for token, i in ranks.items():
        table[i] = token
    return lambda ids: b"".join(map(table.__getitem__, array("I", ids)))


def digests(df: DataFrame, ranks_path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """n_tokens, sha256 of the decimal ids joined by spaces and of the decoded bytes."""
    spec = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(ranks_path)
        text: dict[int, str] = {}
        for batch in batches:
            n, a, b = [], [], []
            for raw in batch.column(len(keep)).to_pylist():
                ids = array("I", raw)
                for i in set(ids).difference(text):
                    text[i] = str(i)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(text.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(decode(raw)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(a), pa.array(b)], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    out = [f"`{f.name}` {f.dataType.simpleString()}" for f in spec.fields]
    return df.select(*keep, ids_col).mapInArrow(run, ", ".join([*out, "n_tokens long, ids_sha256 string, decoded_sha256 string"]))
