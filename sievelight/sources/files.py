"""Reading folders, single texts and fetched pages as documents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown
from ..operators import sync

DOCUMENT = "path string, rel_path string, text string, size_bytes long, content_hash string, indexed_at timestamp"


def read_folder(spark: SparkSession, path: str, glob: str | None = None, hidden: bool = False, ignore: list[str] | None = None) -> DataFrame:
    """Texts below a folder: path, rel_path, text, size_bytes, content_hash, indexed_at.

    Files that are empty, have a zero byte in their first kilobyte, or aren't UTF-8 are passed over; so are hidden ones
    unless they are asked for, and what the folder's .gitignore files, or `ignore`, exclude.  Globs are matched at any depth.
    """
    return texts_of(listed(spark, path, glob, hidden, ignore))


def listed(spark: SparkSession, path: str, glob: str | None = None, hidden: bool = False, ignore: list[str] | None = None) -> DataFrame:
    """The files of read_folder before their content is looked at: path, rel_path, content, size_bytes, indexed_at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    odd, rules = _unlisted(spark, path)
    rows = _placed(files.select("path", "modificationTime", "length", "content").unionByName(odd), path)
    if not hidden:
        rows = rows.filter(~F.regexp_like("rel_path", F.lit(r"(^|/)\.")))
    if glob:
        rows = rows.filter(F.regexp_like("rel_path", F.lit(sync.glob_pattern(glob))))
    out = sync.ignored(F.col("rel_path"), rules + [("", p) for p in ignore or []])
    return rows if out is None else rows.filter(~out)


def _placed(files: DataFrame, path: str) -> DataFrame:
    base = path.rstrip("/").removeprefix("file:").rstrip("/")
    at = F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:/+(?=/)|^file:", "")
    rel = F.substring(at, len(base) + 2, 1 << 20)
    return files.select(at.alias("path"), rel.alias("rel_path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("indexed_at"))


def read_one(spark: SparkSession, path: str, rel_path: str) -> DataFrame:
    """One file of a folder, as read_folder gives it, without a look at the others; no row if it isn't there."""
    at = f"{path.rstrip('/')}/{rel_path}"
    if not _exists(spark, at):
        return spark.createDataFrame([], DOCUMENT)
    files = spark.read.format("binaryFile").load(at) if not any(p[:1] in "._" for p in rel_path.split("/")) else _unlisted(spark, path, rel_path)[0]
    return texts_of(_placed(files.select("path", "modificationTime", "length", "content"), path))


def _exists(spark: SparkSession, path: str, folder: bool = False) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(where) and fs.getFileStatus(where).isDirectory() == folder


def is_folder(spark: SparkSession, path: str) -> bool:
    return _exists(spark, path, True)


def _unlisted(spark: SparkSession, path: str, only: str | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Files that Spark's listing leaves out: those whose name, or a folder's on the way, begins with a dot or an underscore, and empty ones.

    Their names are listed by the driver, what they hold is read by the tasks.  And the rules of all .gitignore files, the outermost first.
    """
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))
    infos = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else []
    names = {os.path.relpath(x.path, root): x for x in infos if x.type == fs.FileType.File}
    odd = [x for name, x in names.items() if (x.size == 0 or any(part[:1] in "._" for part in name.split("/"))) and only in (None, name)]
    rules: list[tuple[str, str]] = []
    for name in sorted((n for n in names if os.path.basename(n) == ".gitignore"), key=lambda n: (n.count("/"), n)):
        with store.open_input_file(names[name].path) as f:
            lines = f.read().decode("utf-8", "ignore").splitlines()
        rules += [(os.path.dirname(name), x.rstrip()) for x in lines if x.strip() and not x.startswith("#")]
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    rows = [(scheme + x.path, x.mtime.replace(tzinfo=None) if x.mtime else None, x.size) for x in odd]
    frame = spark.createDataFrame(rows, "path string, modificationTime timestamp, length long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                at, where = fs.FileSystem.from_uri(name)
                with at.open_input_file(where) as f:
                    content = pa.array([f.read()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, content], [*batch.schema.names, "content"])

    return frame.repartition(max(1, min(len(rows), 64))).mapInArrow(read, "path string, modificationTime timestamp, length long, content binary"), rules


def texts_of(rows: DataFrame) -> DataFrame:
    """Decode binary rows (content) that are text."""
    zero = F.contains(F.substring("content", 1, 1024), F.lit(b"\x00"))
    kept = rows.filter((F.octet_length("content") > 0) & ~zero & F.is_valid_utf8(F.col("content").cast("string")))
    text = F.col("content").cast("string")
    return kept.select("path", "rel_path", text.alias("text"), "size_bytes", F.sha2("content", 256).alias("content_hash"), "indexed_at")


def read_text(spark: SparkSession, label: str, text: str) -> DataFrame:
    return spark.createDataFrame([(label, text)], "label string, text string")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as a document whose label is its name."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("label"), F.col("value").alias("text"))


def fetched_pages(pages: DataFrame, url_col: str = "url", body_col: str = "html", type_col: str | None = None) -> DataFrame:
    """Already fetched bodies as documents labelled by their URL: HTML as Markdown, other bodies as they are."""
    kind = F.col(type_col) if type_col else F.lit(None).cast("string")
    return pages.select(F.col(url_col).alias("label"), markdown.page_text(F.col(body_col), kind).alias("text"))
