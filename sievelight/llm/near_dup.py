"""Near duplicates by ProbMinHash over weighted word shingles, with banding, exact verification and components.

Each five-word shingle, weighted by its count, is a Poisson process of that rate; arrivals fall into registers at random and
a register keeps its first.  A shingle stops once its next arrival is later than all registers' first ones, so long texts
cost little more than one arrival a shingle.  Registers of two texts agree with the chance of their probability Jaccard.

Texts with the same shingles are one node.  Nodes that share a band meet its least node; each such pair is verified by the exact
probability Jaccard, and linked at the threshold.  Bands that still hold several components have all their pairs
across components looked at, so that no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

WORDS = 5
SIMILARITY = 0.8
REGISTERS = 64
ROWS = 4
#: Members of a pivot, or of a block of a band, that a task handles at once.
MEMBERS = 256
BLOCK = 1_024
#: Pairs across components are verified from this estimate on: four standard errors below the threshold.
ESTIMATE = 0.6

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def shingles(text: str, words: WordHashes, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the text's n-word shingles and their counts; fewer words make one shingle, none make none."""
    found = text.lower().split()
    if not found:
        return np.array([], np.uint64), np.array([], np.int64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * _MIX + h[k : len(h) - size + 1 + k])
    return np.unique(out, return_counts=True)


def sketches(lists: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures, a row of register contents (32 bits of a shingle's hash) for each list."""
    m, n = registers, len(lists)
    doc = np.repeat(np.arange(n), [len(h) for h, _ in lists])
    h = np.concatenate([h for h, _ in lists]) if n else np.array([], np.uint64)
    w = np.concatenate([c for _, c in lists]).astype(float) if n else np.array([], float)
    first, kept = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    t, arrival = np.zeros(len(h)), 0
    while len(h):
        r = _mix(h + np.uint64(int(_MIX) * (2 * arrival + 1) & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((r >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / w
        at = doc * m + (_mix(r ^ _MIX) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, t)
        won = t == first[at]
        kept[at[won]] = h[won]
        alive = t < first.reshape(n, m).max(1)[doc]
        doc, h, w, t, arrival = doc[alive], h[alive], w[alive], t[alive], arrival + 1
    return (kept >> np.uint64(32)).astype(np.uint32).reshape(n, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    (ha, xa), (hb, yb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    all_h = np.union1d(ha, hb)
    x, y = np.zeros(len(all_h)), np.zeros(len(all_h))
    x[np.searchsorted(all_h, ha)] = xa
    y[np.searchsorted(all_h, hb)] = yb
    common = (x > 0) & (y > 0)
    if x.max() == y.max() == 1:
        return float(common.sum() / len(all_h))
    ratio = np.divide(y, x, out=np.full(len(x), np.inf), where=x > 0)
    order = np.argsort(ratio, kind="stable")
    low, high = np.cumsum(x[order]), np.concatenate([np.cumsum(y[order][::-1])[::-1], [0]])
    upto = np.searchsorted(ratio[order], ratio[common], side="right")  # those whose ratio isn't above
    return float((1 / (low[upto - 1] / x[common] + high[upto] / y[common])).sum())


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _node(found: tuple[np.ndarray, np.ndarray]) -> bytes:
    return hashlib.blake2b(found[0].tobytes() + found[1].astype("<i8").tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, node (of the shingles; null without words) and signature of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            found = [shingles(t or "", words) for t in batch.column(1).to_pylist()]
            some = [i for i, (h, _) in enumerate(found) if len(h)]
            signatures = sketches([found[i] for i in some])
            nodes: list = [None] * len(found)
            rows: list = [None] * len(found)
            for k, i in enumerate(some):
                nodes[i], rows[i] = _node(found[i]), signatures[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "node", "signature"])
        words.clear()
        blocks.release()

    return docs.mapInArrow(run, "doc_id long, node binary, signature binary")


def bands(nodes: DataFrame) -> DataFrame:
    """(band long, its place int, node) for each of a node's bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(x.shape[1], dtype=np.uint64), x.shape[:2])
            for k in range(ROWS):
                key = _mix(key * _MIX + x[:, :, k])
            node = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), x.shape[1])))
            place = pa.array(np.tile(np.arange(x.shape[1], dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), place, node], ["band", "place", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "band long, place int, node binary")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b): those whose exact probability Jaccard reaches `similarity`.

    b's texts are gathered by a, at most about MEMBERS at a time, with a's own text once for each such part.
    """
    many = F.ceil(F.col("n") / MEMBERS).cast("int")
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", many.alias("parts"))
    sizes = blocks.settle(sizes, "pivots")
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    left = pairs.join(sizes, "a").select("a", part.alias("part"), "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("member")), "b")
    own = sizes.join(texts.select(F.col("node").alias("a"), F.col("text").alias("own")), "a")
    right = own.select(F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("share"), "own")

    def check(members: pa.Table, pivot: pa.Table) -> pa.Table:
        words = WordHashes()
        out = []
        if pivot.num_rows:
            own = shingles(pivot.column("own")[0].as_py(), words)
            for b, text in zip(members.column("b").to_pylist(), members.column("member").to_pylist(), strict=True):
                if probability_jaccard(own, shingles(text, words)) >= similarity:
                    out.append(b)
            a = pivot.column("pivot")[0].as_py()
        return pa.table({"a": pa.array([a] * len(out) if out else [], pa.binary()), "b": pa.array(out, pa.binary())})

    return left.groupBy("a", "part").cogroup(right.groupBy("pivot", "share")).applyInArrow(blocks.releasing(check), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the links (a, b); the label is the component's least node.

    Labels move along links and to their label's own label, until none changes.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = blocks.settle(both, "links")
    labels = blocks.settle(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        heard = blocks.settle(heard, "heard")
        moved = labels.join(heard.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "heard").alias("next"))
        moved = blocks.settle(moved, "moved")
        jump = moved.select(F.col("node").alias("next"), F.col("next").alias("further"))
        new = moved.join(jump, "next").select("node", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("changed"))
        new = blocks.settle(new, "labels")
        labels = new.select("node", "label")
        if new.filter("changed").isEmpty():
            return labels


def _across(mixed: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different labels, from rows (band, place, node, label, signature, text, n).

    Each pair of labels' members that meet in a band is looked at in the first band that they share, and verified exactly if
    their signatures agree enough, until something in the block has linked their labels.  A large band is cut into blocks, and
    each two of them meet in a task.  What comes out are only links that join labels, a forest for each block.
    """
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    rows = mixed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    rows = rows.select("band", "place", "node", "label", "signature", "text", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def link(table: pa.Table) -> pa.Table:
        i, j, place = (table.column(c)[0].as_py() for c in ("i", "j", "place"))
        x = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(table.num_rows, -1, ROWS)
        nodes, own = table.column("node").to_pylist(), table.column("own").to_numpy()
        labels = np.unique(np.array([v.hex() for v in table.column("label").to_pylist()]), return_inverse=True)[1]
        joined = np.arange(labels.max() + 1)  # the label that each label has come to
        words = WordHashes()
        lists = [shingles(t, words) for t in table.column("text").to_pylist()]
        plain = [frozenset(h.tolist()) if c.max(initial=1) == 1 else None for h, c in lists]

        def alike(k: int, c: int) -> bool:
            p, q = plain[k], plain[c]
            if p is None or q is None:
                return probability_jaccard(lists[k], lists[c]) >= similarity
            most, least = max(len(p), len(q)), min(len(p), len(q))
            if least < similarity * most:
                return False
            both = len(p & q)
            return both >= similarity * (most + least - both)

        a, b = [], []
        for k in np.flatnonzero(own == i).tolist():
            at = np.arange(k + 1, table.num_rows) if i == j else np.flatnonzero(own == j)
            at = at[joined[labels[at]] != joined[labels[k]]]
            same = x[at] == x[k]
            first = same.all(2).argmax(1) == place
            agree = same.mean((1, 2))
            at, agree = at[first & (agree >= ESTIMATE)], agree[first & (agree >= ESTIMATE)]
            for c in at[np.argsort(-agree, kind="stable")].tolist():
                mine, its = joined[labels[k]], joined[labels[c]]
                if mine != its and alike(k, c):
                    joined[joined == its] = mine
                    a.append(nodes[k])
                    b.append(nodes[c])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.groupBy("band", "i", "j").applyInArrow(blocks.releasing(link), "a binary, b binary")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_class (rows of the class) and copy (whether a class has more).

    Texts are classed together if a chain of links of probability Jaccard >= similarity joins them; equal shingles always
    do.  A text without words (null, empty, blank) is a class of its own, and so is a row without an id (its class_id is null).
    Rows that repeat are in one class, each with its own row.
    """
    blocks.session_limits(df.sparkSession)
    docs = _texts(df, id_col, text_col)
    rows = blocks.settle(sketch(docs), "sketches")
    nodes = rows.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("signature").alias("signature"), F.count(F.lit(1)).alias("n"))
    nodes = blocks.settle(nodes, "nodes")
    met = bands(nodes)
    pivots = blocks.settle(met.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "bands")
    shared = blocks.settle(met.join(pivots, "band"), "shared")
    stars = blocks.settle(shared.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = shared.select("node").distinct().join(nodes.select("node", "doc_id"), "node")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:  # rows may share an id: only the node's own text will do
            ok = [_node(shingles(t or "", words)) == n for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))
        words.clear()
        blocks.release()

    texts = docs.filter("doc_id IS NOT NULL").join(wanted, "doc_id").select("node", "text").mapInArrow(same, "node binary, text string").dropDuplicates(["node"])
    texts = blocks.settle(texts, "texts")
    links = blocks.settle(_verified(stars, texts, similarity), "verified")
    labels = components(links)
    label = F.coalesce("label", "node")
    tagged = blocks.settle(shared.join(labels, "node", "left").select("band", "place", "node", "n", label.alias("label")), "tagged")
    split = blocks.settle(tagged.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band"), "split")
    rest = tagged.join(split, "band").join(nodes.select("node", "signature"), "node").join(texts, "node")
    more = blocks.settle(_across(rest, similarity), "across")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    full = blocks.settle(nodes.join(labels, "node", "left").select("node", "doc_id", "n", label.alias("label")), "classes")
    heads = blocks.settle(full.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("n_class")), "heads")
    placed = blocks.settle(full.join(heads, "label").select("node", "class_id", "n_class"), "placed")
    ids = rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    known = ids.filter("node IS NOT NULL").join(placed, "node").select("doc_id", "class_id", "n_class")
    alone = ids.filter("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_class"))
    return known.unionByName(alone).withColumn("copy", F.coalesce(F.col("doc_id") != F.col("class_id"), F.lit(False)))


def distinct(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df, unchanged, that are their class's least doc_id; rows that share that id all stay."""
    dropped = classes(df, id_col, text_col, similarity).filter("copy").select(F.col("doc_id").alias("__dropped")).distinct()
    return df.join(blocks.settle(dropped, "dropped"), F.col(id_col) == F.col("__dropped"), "left_anti")
