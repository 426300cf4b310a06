"""Incremental synchronisation: what changed between what is stored and what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def diff(present: DataFrame, stored: DataFrame, key: str = "rel_path") -> DataFrame:
    """(key, status): added, updated, removed or unchanged, by the content's hash alone."""
    a, b = present.select(key, F.col("content_hash").alias("_new")), stored.select(key, F.col("content_hash").alias("_old"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def contents(rows: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(data_hash, first_id, n): each distinct content, its first row and how often it occurs."""
    return rows.groupBy(content_hash(F.col(text_col)).alias("data_hash")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n"))


def counters(changes: DataFrame) -> DataFrame:
    """Files scanned, added, updated, removed and unchanged."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return changes.agg(F.count(F.when(F.col("status") != "removed", 1)).alias("scanned"), *[count(s) for s in ("added", "updated", "removed", "unchanged")])


def source_totals(sources: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_count and chunk_count of each source, 0 where it has none."""
    f = files.groupBy("source_id").agg(F.count(F.lit(1)).alias("file_count"))
    c = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    out = sources.drop("file_count", "chunk_count").join(f, "source_id", "left").join(c, "source_id", "left")
    return out.withColumn("file_count", F.coalesce("file_count", F.lit(0))).withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def stale(sources: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    """Sources never synced, or not for so many minutes."""
    passed = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("last_sync")) / 60)
    return sources.withColumn("is_stale", F.coalesce(passed >= minutes, F.lit(True)))


def glob_pattern(glob: str) -> str:
    """A gitignore-like glob as a regular expression on paths: without a slash it matches at any depth."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^(?:{'' if '/' in glob.rstrip('/') else '(?:.*/)?'}{out})$"


def ignored(rel_path: Column, rules: list[tuple[str, str]]) -> Column | None:
    """Whether rules (folder, line of its .gitignore) exclude a file; the last that matches counts, and ! takes back.

    A pattern with a slash before its end is matched from its folder, others at any depth below; a match of a folder holds for all in it.
    """
    out = None
    for folder, line in rules:
        back, pattern = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        anchored, plain = "/" in pattern.rstrip("/"), pattern.strip("/")
        if not plain:
            continue
        import re

        inner = glob_pattern(plain if not anchored else f"./{plain}")[1:-1].replace(re.escape("./"), "", 1)
        below = "(/.*)" if pattern.endswith("/") else "(/.*)?"
        hit = F.regexp_like(rel_path, F.lit(f"^{re.escape(folder + '/') if folder else ''}{inner}{below}$"))
        out = F.when(hit, F.lit(not back)).otherwise(F.lit(False) if out is None else out)
    return out


def source_for_path(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, label): the first source by label whose path is a start of it and whose glob, if any, matches the rest.

    Sources are the configured folders, so they are broadcast by their own size limit.
    """
    rel = F.substring(F.col("path"), F.length("base") + 2, F.length("path"))
    match = F.startswith(F.col("path"), F.concat("base", F.lit("/"))) & (F.col("pattern").isNull() | F.regexp_like(rel, F.col("pattern")))
    found = paths.join(sources.select("label", "base", "pattern"), match)
    return found.groupBy("path").agg(F.min("label").alias("label"))


def latest_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def remove(source_id: int, sources: DataFrame, files: DataFrame, chunks: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables without a source, its files, their chunks, and links from or to them."""
    gone = files.filter(F.col("source_id") == source_id).select("file_id")
    kept = links.join(gone, F.col("source_file_id") == F.col("file_id"), "left_anti").join(gone, F.col("target_file_id") == F.col("file_id"), "left_anti")
    other = F.col("source_id") != source_id
    return sources.filter(other), files.filter(other), chunks.filter(other), kept
