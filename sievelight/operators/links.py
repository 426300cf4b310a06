"""The link graph: resolving wiki links, neighbours, and traversal by hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import held

DIRECTIONS = ("forward", "backward", "both")


def resolve(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Links (source_file_id, target_file_id, link_type, confidence) of (source_file_id, target) among (file_id, rel_path).

    A target is a path, a path without .md, or the end of one, in that order; of several the least id.  All three are
    equi-joins: ends are joined by the last part.  Links to the file itself and unresolved ones go.
    """
    wanted = targets.select("source_file_id", "target", F.regexp_extract("target", "[^/]*$", 0).alias("_base"))
    known = files.select("file_id", "rel_path", F.regexp_extract("rel_path", "[^/]*$", 0).alias("_base"))
    exact = wanted.join(known.drop("_base"), F.col("rel_path") == F.col("target")).withColumn("_way", F.lit(0))
    note = wanted.join(known.drop("_base"), F.col("rel_path") == F.concat("target", F.lit(".md"))).withColumn("_way", F.lit(1))
    ends = known.select("file_id", "rel_path", F.explode(F.array_distinct(F.array("_base", F.regexp_replace("_base", r"\.md$", "")))).alias("_base"))
    end = wanted.join(ends, "_base").filter(F.endswith("rel_path", F.concat(F.lit("/"), "target")) | F.endswith("rel_path", F.concat(F.lit("/"), "target", F.lit(".md")))).withColumn("_way", F.lit(2))
    cols = ["source_file_id", "target", "file_id", "_way"]
    ways = exact.select(cols).unionByName(note.select(cols)).unionByName(end.select(cols))
    best = ways.groupBy("source_file_id", "target").agg(F.min_by("file_id", F.struct("_way", "file_id")).alias("target_file_id"))
    kept = best.filter(F.col("source_file_id") != F.col("target_file_id"))
    return kept.select("source_file_id", "target_file_id", F.lit("wikilink").alias("link_type"), F.lit(1.0).alias("confidence")).distinct()


def edges(links: DataFrame, direction: str) -> DataFrame:
    """(file_id, neighbour_id, direction, link_type): links seen from their start, their end, or both."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    out = links.select(F.col("source_file_id").alias("file_id"), F.col("target_file_id").alias("neighbour_id"), F.lit("forward").alias("direction"), "link_type")
    back = links.select(F.col("target_file_id").alias("file_id"), F.col("source_file_id").alias("neighbour_id"), F.lit("backward").alias("direction"), "link_type")
    return out if direction == "forward" else back if direction == "backward" else out.unionByName(back)


def related(links: DataFrame, chunks: DataFrame, file_id: int, direction: str, limit: int, where: Column | None = None) -> DataFrame:
    """Chunks of a file's neighbours, forward links first; the filter holds for chunks, not for the links."""
    near = edges(links, direction).filter(F.col("file_id") == file_id).select(F.col("neighbour_id").alias("file_id"), "direction", "link_type")
    found = near.join(chunks if where is None else chunks.filter(where), "file_id")
    return found.orderBy(F.when(F.col("direction") == "forward", 0).otherwise(1), "file_id", "chunk_id").limit(limit)


def _hops(links: DataFrame, origin: int, direction: str, depth: int, frontier: int) -> DataFrame:
    """(from_id, file_id, direction, link_type, hop): edges that leave each hop's frontier.

    A file is in one frontier at most; a hop's frontier has at most `frontier` files, the least ids, which the driver holds.
    """
    all_edges = edges(links, direction)
    here = links.sparkSession.createDataFrame([(origin,)], "file_id long")
    visited, found = here, None
    for hop in range(1, depth + 1):
        left = all_edges.join(F.broadcast(here), "file_id").select(F.col("file_id").alias("from_id"), F.col("neighbour_id").alias("file_id"), "direction", "link_type", F.lit(hop).alias("hop"))
        found = left if found is None else found.unionByName(left)
        fresh = left.select("file_id").distinct().join(visited, "file_id", "left_anti")
        visited = visited.unionByName(fresh)
        here = held(fresh.orderBy("file_id").limit(frontier))
    return found


def multi_hop(links: DataFrame, chunks: DataFrame, origin: int, direction: str, limit: int, depth: int = 1, where: Column | None = None, frontier: int = 50) -> DataFrame:
    """One chunk of each file within `depth` hops, nearest first; the origin itself is left out."""
    depth = min(max(depth, 1), 3)
    reached = _hops(links, origin, direction, depth, frontier).filter(F.col("file_id") != origin)
    first = reached.groupBy("file_id").agg(F.min_by(F.struct("hop", "direction", "link_type"), F.struct("hop", F.when(F.col("direction") == "forward", 0).otherwise(1))).alias("_e")).select("file_id", "_e.*")
    rows = first.join(chunks if where is None else chunks.filter(where), "file_id")
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file_id").orderBy("chunk_id"))).filter("_n = 1").drop("_n")
    return one.orderBy("hop", "file_id").limit(limit)


def link_counts(links: DataFrame, files: DataFrame, chunks: DataFrame, origin: int, direction: str, depth: int = 1, frontier: int = 50) -> DataFrame:
    """rel_path, direction, link_type, chunk_count, hop: each neighbour at its earliest hop; the origin can come back at hop 2."""
    depth = min(max(depth, 1), 3)
    reached = _hops(links, origin, direction, depth, frontier)
    sizes = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    first = reached.groupBy("file_id", "direction").agg(F.min("hop").cast("int").alias("hop"), F.min("link_type").alias("link_type"))
    return first.join(files.select("file_id", "rel_path"), "file_id").join(sizes, "file_id").select("rel_path", "direction", "link_type", "chunk_count", "hop").orderBy("hop", F.col("chunk_count").desc(), "rel_path", "direction")


def graph_rerank(results: DataFrame, links: DataFrame, chunks: DataFrame, boost: float, inject: bool, related_limit: int = 6) -> DataFrame:
    """Knowledge results (chunk_id, file_id, score, ...) re-scored by the links of the three best.

    Results whose file is a neighbour get the boost; with `inject` up to two neighbours' files that have no result
    join with 0.92 of the last score and the boost.  Each seed counts its first `related_limit` chunks, forward first.
    """
    cols = results.columns
    order = Window.orderBy(F.round("score", 9).desc(), "chunk_id")
    ranked = results.withColumn("_rank", F.row_number().over(order))
    seeds = ranked.filter("_rank <= 3").select(F.col("file_id").alias("seed"), "_rank")
    near = edges(links, "both").join(F.broadcast(seeds), F.col("file_id") == F.col("seed")).select("_rank", F.col("neighbour_id").alias("file_id"), F.when(F.col("direction") == "forward", 0).otherwise(1).alias("_way"))
    linked = near.join(chunks.select("file_id", "chunk_id", "title", "content"), "file_id")
    place = F.row_number().over(Window.partitionBy("_rank").orderBy("_way", "file_id", "chunk_id"))
    linked = linked.withColumn("_place", place).filter(F.col("_place") <= related_limit)
    first = linked.groupBy("file_id").agg(F.min_by(F.struct("chunk_id", "title", "content"), F.struct("_rank", "_place")).alias("_c"))
    files = first.select("file_id", F.lit(True).alias("graph_neighbor"))
    out = results.join(F.broadcast(files), "file_id", "left").withColumn("graph_neighbor", F.coalesce("graph_neighbor", F.lit(False)))
    out = out.withColumn("graph_boost", F.when(F.col("graph_neighbor"), boost).otherwise(0.0)).withColumn("score", F.col("score") + F.col("graph_boost"))
    if inject:
        floor = out.agg((F.min("score") * 0.92).alias("_floor"))
        extra = first.join(results.select("file_id"), "file_id", "left_anti").orderBy("file_id").limit(2).join(F.broadcast(floor))
        extra = extra.select("file_id", "_c.*", (F.col("_floor") + boost).alias("score"), F.lit(boost).alias("graph_boost"), F.lit(True).alias("graph_neighbor"))
        known = {f.name: f.dataType for f in out.schema.fields}
        extra = extra.select(*[F.col(c) if c in extra.columns else F.lit(None).cast(known[c]).alias(c) for c in [*cols, "graph_neighbor", "graph_boost"] if c in known])
        out = out.select(extra.columns).unionByName(extra)
    return out
