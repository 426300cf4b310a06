"""Building an index: sources, chunks, postings and their statistics."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking


@dataclass
class Index:
    """A corpus as DataFrames.

    chunks: chunk_id, source_id, label, title, content, content_type, line_start, line_end, and any of embedding, metadata,
    file_id, rel_path.  `words` is what counts as a chunk's words; in a knowledge corpus the content type doesn't.
    """

    chunks: DataFrame
    knowledge: bool = False
    stem: bool = False
    postings: DataFrame | None = None
    #: One row (n, avgdl) that belongs to the postings, if it was saved with them.
    stats: DataFrame | None = None
    #: The postings of some terms of a kept table, which reads no others.
    lookup: Callable[[list[str]], DataFrame] | None = None

    @property
    def fuse_key(self) -> list[str]:
        return ["chunk_id"] if self.knowledge else ["source_id", "title"]

    def indexed_columns(self) -> list[str]:
        return ["title", "content"] if self.knowledge else ["title", "content", "content_type"]

    def folded(self) -> Column:
        return T.fold(F.concat_ws(" ", *self.indexed_columns()))

    def words(self) -> Column:
        return T.tokens(F.concat_ws(" ", *self.indexed_columns()))

    def build_postings(self) -> DataFrame:
        """(term, chunk_id, tf, dl) with one row for each distinct term of a chunk; partial counts come before the shuffle."""
        rows = self.chunks.select("chunk_id", self.words().alias("words")).withColumn("dl", F.size("words"))
        found = rows.select("chunk_id", "dl", F.explode("words").alias("term"))
        if self.stem:
            from ..functions import porter

            found = found.join(porter.stems(found), "term").select("chunk_id", "dl", F.col("stem").alias("term"))
        return found.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))

    def with_postings(self) -> Index:
        return Index(self.chunks, self.knowledge, self.stem, self.build_postings())


    def save(self, path: str, buckets: int = 256) -> None:
        """Write chunks, postings and statistics; postings lie in a folder for each bucket of terms, sorted by term.

        A query then reads the folders of its terms, and in them the row groups whose range holds a term.
        """
        self.chunks.write.parquet(f"{path}/chunks")
        rows = self.build_postings().withColumn("term_bucket", term_bucket(F.col("term"), buckets))
        # A bucket goes to one task unless it is large: Spark splits rebalanced partitions by size.
        rows.hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "term").write.partitionBy("term_bucket").parquet(f"{path}/postings")
        lengths = self.chunks.select(F.size(self.words()).alias("dl"))
        lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.lit(buckets).alias("buckets"), F.lit(self.knowledge).alias("knowledge"), F.lit(self.stem).alias("stem")).write.parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        stats = spark.read.parquet(f"{path}/stats")
        kind = stats.first()
        return cls(spark.read.parquet(f"{path}/chunks"), kind.knowledge, kind.stem, spark.read.parquet(f"{path}/postings"), stats)

    def postings_of(self, terms: list[str]) -> DataFrame:
        """The postings of some terms: of saved ones, only from their folders."""
        if self.lookup is not None:
            return self.lookup(terms)
        found = self.postings.filter(F.col("term").isin(*terms))
        if self.stats is not None and "term_bucket" in self.postings.columns:
            n = self.stats.first().buckets
            found = found.filter(F.col("term_bucket").isin(*{zlib.crc32(t.encode()) % n for t in terms}))
        return found

    def corpus_stats(self) -> DataFrame:
        if self.stats is not None:
            return self.stats.select("n", "avgdl")
        if "dl" in self.chunks.columns:
            return self.chunks.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        return self.chunks.select(F.size(self.words()).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def chunk_documents(docs: DataFrame, id_col: str, label: Column, text_col: str = "text", content_type: str | None = None) -> DataFrame:
    """Chunks of documents; a given content type replaces what the chunk's own lines say."""
    rows = docs.select(F.col(id_col).alias("source_id"), label.alias("label"), F.col(text_col).alias("text"))
    found = chunking.chunk(rows, ["source_id", "label"])
    kind = F.lit(content_type) if content_type else F.when(F.col("is_code"), "code").otherwise("prose")
    return found.select(F.concat_ws("/", F.col("source_id").cast("string"), F.col("place").cast("string")).alias("chunk_key"), F.xxhash64("source_id", "place").alias("chunk_id"), "source_id", "label", "title", "content", kind.alias("content_type"), "is_code", "line_start", "line_end")


def sources(chunks: DataFrame, indexed_at: Column) -> DataFrame:
    """One row for each source with its counts of chunks and of code chunks."""
    return chunks.groupBy("source_id", "label").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"), F.count(F.when(F.col("is_code"), 1)).cast("int").alias("code_chunk_count")).withColumn("indexed_at", indexed_at)


def whole_documents(docs: DataFrame, id_col: str = "doc_id", label_col: str = "source", text_col: str = "text", content_type: str = "prose") -> DataFrame:
    """One chunk for each document."""
    lines = F.size(T.lines_of(F.col(text_col)))
    return docs.select(
        F.col(id_col).cast("long").alias("chunk_id"), F.col(id_col).cast("long").alias("source_id"), F.col(label_col).alias("label"), F.concat(F.lit("document "), F.col(id_col).cast("string")).alias("title"),
        F.col(text_col).alias("content"), F.lit(content_type).alias("content_type"), F.lit(1).alias("line_start"), lines.alias("line_end"),
    )


def content_characters(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("content_chars"))


def orphans(chunks: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Chunks whose source isn't there."""
    return chunks.join(sources.select(key), key, "left_anti")


def chunks_of(chunks: DataFrame, label: str, limit: int) -> DataFrame:
    """A source's first chunks in their order."""
    return chunks.filter(F.col("label") == label).orderBy("source_id", "line_start", "chunk_id").limit(limit)


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks that have no embedding yet."""
    return chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti")
