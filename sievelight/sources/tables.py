"""Tables as folders of immutable parts; numbered manifests say which parts are the current version."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest-"


class Table:
    """A table below a folder of any file system that Spark reaches.

    A write adds a part, then a manifest with the next number, which lists the parts of the new version: `key <tab> folder` a line.
    Parts and manifests are never changed, and a manifest gets its name only when it is whole, so a write that fails anywhere
    changes nothing, appends included.  Readers take the manifest with the highest number.  Of two writers at once the
    later one wins.  Old parts and manifests stay until `vacuum`.

    With `by`, a column, rows lie in a folder for each of its values, a part's key; a read, or a write, can then be of some keys alone.
    `sort` is a column by which their files are sorted, so that row groups can be passed over.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, by: str | None = None, sort: str | None = None):
        self.spark, self.root, self.schema, self.by, self.sort = spark, f"{root.rstrip('/')}/{name}", schema, by, sort

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        Path, fs = self._fs()
        root = Path(self.root)
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in names if n.startswith(MANIFEST))

    def version(self) -> str | None:
        """The current manifest's name."""
        found = self._manifests()
        return found[-1] if found else None

    def parts(self) -> list[tuple[str, str]]:
        """(key, folder) of the current version."""
        name = self.version()
        if name is None:
            return []
        Path, fs = self._fs()
        stream = fs.open(Path(f"{self.root}/{name}"))
        try:
            lines = bytes(stream.readAllBytes()).decode().splitlines()
        finally:
            stream.close()
        return [tuple(line.split("\t")) for line in lines]

    def read(self, keys: Iterable | None = None) -> DataFrame:
        """The current rows, or those of some keys."""
        wanted = None if keys is None else {str(k) for k in keys}
        folders = [f"{self.root}/{folder}" for key, folder in self.parts() if wanted is None or key in wanted]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _write(self, df: DataFrame) -> list[tuple[str, str]]:
        """Write a part; its (key, folder)."""
        name = uuid.uuid4().hex
        kinds = self.spark.createDataFrame([], self.schema).schema
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in kinds.fields], *([F.col(self.by).cast("string").alias("part_key")] if self.by else []))
        if not self.by:
            rows.write.parquet(f"{self.root}/{name}")
            return [("", name)]
        # A key goes to one task unless it is large: Spark splits rebalanced partitions by size.
        rows.hint("rebalance", "part_key").sortWithinPartitions("part_key", *([self.sort] if self.sort else [])).write.partitionBy("part_key").parquet(f"{self.root}/{name}")
        Path, fs = self._fs()
        folders = [x.getPath().getName() for x in fs.listStatus(Path(f"{self.root}/{name}")) if x.isDirectory()]
        return [(f.removeprefix("part_key="), f"{name}/{f}") for f in sorted(folders) if f.startswith("part_key=")]

    def _publish(self, parts: list[tuple[str, str]]) -> None:
        Path, fs = self._fs()
        last = self.version()
        number = int(last.split("-")[1]) + 1 if last else 1
        name = f"{number:012d}-{uuid.uuid4().hex}"
        new = Path(f"{self.root}/.{name}")
        stream = fs.create(new, True)
        stream.write(bytearray("".join(f"{k}\t{f}\n" for k, f in parts).encode()))
        stream.close()
        if not fs.rename(new, Path(f"{self.root}/{MANIFEST}{name}")):
            raise OSError(f"can't publish a version of {self.root}")

    def overwrite(self, df: DataFrame) -> None:
        self._publish(self._write(df))

    def append(self, df: DataFrame) -> DataFrame:
        """The rows, as they were written."""
        new = self._write(df)
        self._publish(self.parts() + new)
        folders = [f"{self.root}/{folder}" for _, folder in new]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame, keys: Iterable) -> None:
        """The rows of some keys anew; the parts of all others stay as they are, unread."""
        gone = {str(k) for k in keys}
        kept = [(k, f) for k, f in self.parts() if k not in gone]
        self._publish(kept + self._write(df))

    def drop(self, keys: Iterable) -> None:
        gone = {str(k) for k in keys}
        self._publish([(k, f) for k, f in self.parts() if k not in gone])

    def compact(self, most: int = 64) -> None:
        """Rewrite the keys, or the table, that many small appends have left in more than `most` folders."""
        counts: dict[str, int] = {}
        for key, _ in self.parts():
            counts[key] = counts.get(key, 0) + 1
        many = [k for k, n in counts.items() if n > most]
        if many and self.by:
            self.replace(self.read(many), many)
        elif many:
            self.overwrite(self.read())

    def vacuum(self) -> None:
        """Remove manifests and parts that aren't current."""
        Path, fs = self._fs()
        current = self.version()
        kept = {folder.split("/")[0] for _, folder in self.parts()} | {current}
        for status in fs.listStatus(Path(self.root)) if current else []:
            if status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)


def write_report(lines: DataFrame, path: str) -> None:
    """A text report, one file of lines in order."""
    lines.coalesce(1).write.mode("overwrite").text(path)
