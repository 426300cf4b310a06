"""Token ids on disk: each document compressed by itself with a shared zstandard dictionary.

A store is a folder of `tokens-NNNNNN.bin`, in ascending doc_id order, and `<hash>.dict`.  A file holds

    magic 8 | version, id width, two reserved: 4 bytes | dictionary's sha256 32 | documents n: u64
    doc_id i64 x n | ids u32 x n | offsets u64 x (n + 1) | payloads

where payload k, from offsets[k] to offsets[k + 1] after the header, is one zstandard frame of document k's ids as
unsigned little-endian integers of the id width.  Header and index are read once for a file, and then a document is one range
read of its frame.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, bpe

MAGIC = b"SLTOKEN1"
HEADER = 8 + 4 + 32 + 8
#: The dictionary's size and the bounded sample that it is trained on.
DICT_BYTES = 32 << 10
DICT_DOCS = 600
DICT_IDS = 2_000
#: Compressed bytes that are read and decoded at once.
READ_BYTES = 1 << 20
#: Below so many samples there is nothing that a trained dictionary could generalise.
LEAST_SAMPLES = 20


def train_dictionary(df: DataFrame, vocabulary: bpe.Vocabulary, width: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", docs: int = DICT_DOCS) -> bytes:
    """A dictionary from at most DICT_IDS ids, anywhere in the text, of `docs` documents by a hash of their ids.

    The samples are arrays of the store's id width.  Where they are too few or too alike for zstandard to train on, the dictionary
    is what they hold, as plain content; without any text it is the end id.
    """
    size = 4 * DICT_IDS
    # Ids alone are ranked first: a rank of texts would send the driver as many texts from every task.
    picked = [r.id for r in df.filter(F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("place"), F.col(id_col).alias("id")).orderBy("place", "id").limit(docs).collect()]
    # Where in the text is another hash's matter than which documents.
    start = (1 + F.pmod(F.xxhash64(id_col, F.lit("start")), F.greatest(F.length(text_col) - size, F.lit(0)) + 1)).cast("int")
    rows = df.filter(F.col(id_col).isin(picked) & (F.octet_length(text_col) > 0)).select(F.col(id_col).alias("id"), F.substring(F.col(text_col), start, F.lit(size)).alias("cut"))
    texts = sorted(r.cut for r in rows.limit(2 * docs).collect())
    cache = vocabulary.cache()
    samples = []
    for text in texts:
        ids = np.frombuffer(cache.text_ids(text), "<u4").astype(f"<u{width}")
        at = zlib.crc32(text.encode()) % max(1, len(ids) - DICT_IDS + 1)
        samples.append(ids[at : at + DICT_IDS].tobytes())
    return dictionary_of(samples, np.array([end_id] * 8, f"<u{width}").tobytes())


def dictionary_of(samples: list[bytes], end: bytes) -> bytes:
    """Trained on the samples, or, if that fails, their last bytes and `end`."""
    if len(samples) >= LEAST_SAMPLES:
        with contextlib.suppress(zstandard.ZstdError):
            return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    return b"".join([*samples, end])[-DICT_BYTES:]


def file_bytes(doc_ids: np.ndarray, ids: list[bytes], dictionary: bytes, width: int) -> bytes:
    """A store file; ids are little-endian unsigned 32-bit."""
    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
    payloads = [press.compress(np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes()) for x in ids]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in payloads])]).astype("<u8")
    head = MAGIC + bytes([1, width, 0, 0]) + hashlib.sha256(dictionary).digest() + np.uint64(len(ids)).astype("<u8").tobytes()
    return b"".join([head, doc_ids.astype("<i8").tobytes(), np.array([len(x) // 4 for x in ids], "<u4").tobytes(), offsets.tobytes(), *payloads])


class TokenFile:
    """Reads one file of a store; `read(start, size)` gives a range of its bytes."""

    def __init__(self, read: Callable[[int, int], bytes], dictionary: bytes):
        head = read(0, HEADER)
        if head[:8] != MAGIC or head[8] != 1:
            raise ValueError("not a token file")
        if head[12:44] != hashlib.sha256(dictionary).digest():
            raise ValueError("another dictionary wrote this file")
        self.read, self.width, n = read, head[9], int(np.frombuffer(head[44:52], "<u8")[0])
        index = read(HEADER, 8 * n + 4 * n + 8 * (n + 1))
        self.doc_ids = np.frombuffer(index[: 8 * n], "<i8")
        self.counts = np.frombuffer(index[8 * n : 12 * n], "<u4").astype(np.int64)
        self.offsets = np.frombuffer(index[12 * n :], "<u8").astype(np.int64)
        self.base = HEADER + len(index)
        self.press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def several(self, a: int, b: int) -> list[np.ndarray]:
        """Ids of the documents from place a up to b, with one range read."""
        held = memoryview(self.read(self.base + int(self.offsets[a]), int(self.offsets[b] - self.offsets[a])))
        at = (self.offsets[a : b + 1] - self.offsets[a]).tolist()
        frames = [self.press.decompress(held[x:y], max_output_size=max(1, self.width * n)) for x, y, n in zip(at, at[1:], self.counts[a:b].tolist(), strict=False)]
        return [np.frombuffer(raw, f"<u{self.width}").astype("<u4") for raw in frames]

    def document(self, doc_id: int) -> list[np.ndarray]:
        """Ids of each row of that id."""
        a, b = np.searchsorted(self.doc_ids, [doc_id, doc_id + 1]).tolist()
        return self.several(a, b) if a < b else []


@contextlib.contextmanager
def opened(uri: str, dictionary: bytes) -> Iterator[TokenFile]:
    """A file of a store, by range reads of it."""
    fs, path = blocks.filesystem(uri)
    with fs.open_input_file(path) as f:
        yield TokenFile(lambda start, size: f.read_at(size, start), dictionary)


def write(df: DataFrame, uri: str, vocabulary: bpe.Vocabulary, end_id: int, vocabulary_size: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int, int]]:
    """Write all documents below `uri` in ascending doc_id order; (file, documents, ids, bytes) of each file in that order.

    Null ids come first and are stored as the least 64-bit integer; null texts count as empty; rows with one doc_id keep
    their text's order.  A file goes to its final name only when it is whole, so a repeated task does no harm.
    """
    blocks.session_limits(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    _, n_bytes = blocks.extent(rows, "text")
    cuts = blocks.splitters(rows, "doc_id", blocks.bucket_count(n_bytes))
    width, end = 2 if vocabulary_size <= 1 << 16 else 4, np.array([end_id], "<u4").tobytes()
    dictionary = train_dictionary(rows, vocabulary, width, end_id)
    key = hashlib.sha256(dictionary).hexdigest()
    fs, path = blocks.filesystem(uri)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{key}.dict") as f:
        f.write(dictionary)

    def store(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        docs = blocks.rejoined(table).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        doc_ids = blocks.ids_of(docs)
        order = np.argsort(doc_ids, kind="stable")
        texts = docs.column("text")
        ids = [x + end for x in bpe.encode_texts(vocabulary.cache(), (texts[int(k)].as_py() for k in order))]
        data = file_bytes(doc_ids[order], ids, dictionary, width)
        name = f"tokens-{bucket:06d}.bin"
        at, folder = blocks.filesystem(uri)
        from pyspark import TaskContext

        own = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
        with at.open_output_stream(own) as f:
            f.write(data)
        at.move(own, f"{folder}/{name}")
        return pa.table({"file": [name], "docs": [len(ids)], "ids": [sum(map(len, ids)) // 4], "bytes": [len(data)]})

    dealt = blocks.deal(rows, lambda t: blocks.by_bucket(np.searchsorted(cuts, blocks.ids_of(t), side="right")))
    files = dealt.groupBy("bucket").applyInArrow(blocks.releasing(store), "file string, docs long, ids long, bytes long").collect()
    return sorted((r.file, r.docs, r.ids, r.bytes) for r in files)


def read(spark: SparkSession, uri: str, files: list[tuple[str, int, int, int]], with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, if asked for)."""
    fs, path = blocks.filesystem(uri)
    (info,) = [x for x in fs.get_file_info(_selector(path)) if x.path.endswith(".dict")]
    with fs.open_input_file(info.path) as f:
        dictionary = f.read()
    before = [0, *itertools.accumulate(f[2] for f in files)]
    listing = spark.createDataFrame([(f[0], b) for f, b in zip(files, before, strict=False)], "file string, before long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(f"{uri}/{file}", dictionary) as held:
                    starts = start + np.concatenate([[0], np.cumsum(held.counts)[:-1]]) if len(held.counts) else []
                    for a, b in runs(held.offsets):
                        ids = held.several(a, b)
                        least = held.doc_ids[a:b] == np.iinfo(np.int64).min
                        cols = [pa.array(held.doc_ids[a:b], mask=least), pa.array(starts[a:b], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                        if with_ids:
                            cols.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return listing.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def runs(offsets: np.ndarray, most: int = 500, size: int = READ_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents (from, up to) of at most `most` documents and `size` bytes, or of one document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, min(a + most, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1))
        yield a, b
        a = b


def _selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path)
