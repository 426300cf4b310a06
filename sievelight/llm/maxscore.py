"""Exact top-k inner-product search by MaxScore over sharded dimensions.

Each shard keeps its vectors dimension by dimension, as postings with the least and the greatest value of each.  For a query,
a dimension can add no more than its bound; dimensions are taken by falling bound, and those at the end whose
bounds together stay below the k-th best score so far are non-essential: they can't lift a vector that the essential
ones leave too low.  Essential postings are traversed for a block of vectors at a time; the others are probed only for vectors
that may still reach the threshold.  Shards' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

#: Vectors of a shard and queries of a part, so what a task holds: every shard meets every part, and the vectors are shuffled once for each
#: part of the queries, the queries once for each shard.
SHARD_ROWS = 32_768
QUERY_ROWS = 16_384
#: Vectors of a shard at least, where there are too few shards for all tasks.
LEAST_SHARD_ROWS = 4_096
BLOCK = 2_048
PROBE = 8


class Shard:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.postings = ids[order], np.ascontiguousarray(rows[order].T)
        self.least, self.most = (self.postings.min(1), self.postings.max(1)) if len(ids) else (np.zeros(rows.shape[1], rows.dtype),) * 2

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best but the query's own id, by falling score and rising id."""
        bound = np.maximum(q * self.least, q * self.most)
        order = np.argsort(-bound, kind="stable")
        after = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # what the dimensions from here on can add
        ids, scores, threshold = np.array([], np.int64), np.array([], q.dtype), None
        for a in range(0, len(self.ids), BLOCK):
            at = np.flatnonzero(self.ids[a : a + BLOCK] != query_id) + a
            # The least number of essential dimensions: the rest alone can't reach the threshold.
            essential = len(q) if threshold is None else max(1, int(np.searchsorted(-after, -threshold, side="right")))
            essential = min(essential, len(q))
            e = order[:essential]
            part = q[e] @ self.postings[e, a : a + BLOCK]
            part = part[at - a]
            done = essential
            while threshold is not None:
                alive = part + after[done] >= threshold
                at, part = at[alive], part[alive]
                if done >= len(q) or not len(at):
                    break
                more = order[done : done + PROBE]
                part = part + q[more] @ self.postings[np.ix_(more, at)]
                done += len(more)
            if done < len(q) and len(at):
                more = order[done:]
                part = part + q[more] @ self.postings[np.ix_(more, at)]
            ids, scores = np.concatenate([ids, self.ids[at]]), np.concatenate([scores, part])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                threshold = scores[-1]
        return ids, scores


def quantized(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and floor(scale * x) of them; shorter ones are filled up with zeros."""
    got = [None if v is None or any(x is None for x in v) else np.floor(scale * np.array(v, float)) for v in vectors.to_pylist()]
    ok = np.array([v is not None and bool(np.isfinite(v).all()) for v in got], bool)
    kept = [v for v, x in zip(got, ok, strict=True) if x]
    out = np.zeros((len(kept), max(map(len, kept), default=0)))
    for row, v in zip(out, kept, strict=True):
        row[: len(v)] = v
    return ok, out


def search(df: DataFrame, is_query: Column, k: int, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best by the integer inner product of floor(scale * x).

    Rows whose vector is null, or has a null or non-finite component, and rows with a null id take no part.  All other rows but
    those with the query's own id are candidates; equal scores go by the smaller id, repeated candidates are repeated;
    of queries that share an id the one with the least vector counts.
    """
    blocks.session_limits(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("id IS NOT NULL AND v IS NOT NULL")
    n, wanted = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, parts = max(1, -(-n // SHARD_ROWS), min(tasks, n // LEAST_SHARD_ROWS)), max(1, -(-wanted // QUERY_ROWS))

    def numbers(table: pa.Table) -> pa.Table:
        ok, x = quantized(table.column("v"), scale)
        return pa.table({"id": table.column("id").filter(pa.array(ok)), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    def deal(frame: DataFrame, count: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = numbers(pa.Table.from_batches([batch]))
                hashed = (table.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for b, at in blocks.by_bucket((hashed % np.uint64(count)).astype(np.int64)):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blocks.pack(table.take(pa.array(at)))], pa.binary())], ["bucket", "block"])

        return frame.select("id", "v").mapInArrow(run, "bucket int, block binary")

    def array(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        got = blocks.rejoined(table)
        if got is None or not got.num_rows:
            return np.array([], np.int64), np.zeros((0, 0))
        vectors = [np.frombuffer(x) for x in got.column("x").to_pylist()]
        out = np.zeros((len(vectors), max(map(len, vectors))))
        for row, v in zip(out, vectors, strict=True):
            row[: len(v)] = v
        return got.column("id").to_numpy(), out

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, x), (query_ids, q) = array(left), array(right)
        width = max(x.shape[1], q.shape[1])
        x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
        # Doubles are exact as long as no sum can leave their integers.
        if len(x) and len(q) and width * np.abs(x).max() * np.abs(q).max() >= 2**53:
            x, q = x.astype(np.int64), q.astype(np.int64)
        shard, out = Shard(ids, x), [[], [], []]
        first: dict[int, np.ndarray] = {}
        for i, v in zip(query_ids.tolist(), q, strict=True):
            if i not in first or tuple(v) < tuple(first[i]):
                first[i] = v
        for i, v in first.items():
            found, scores = shard.top(i, v, k)
            for col, c in zip(out, ([i] * len(found), found.tolist(), [int(s) for s in scores]), strict=True):
                col.extend(c)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    spread = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    left = deal(rows, shards).select(F.col("bucket").alias("shard"), spread("part", parts), "block")
    right = deal(rows.filter("q"), parts).select(spread("shard", shards), F.col("bucket").alias("part"), "block")
    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
