"""Session events: deduplication, retention and the resume snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings


def priority(tool: Column) -> Column:
    return F.when(tool.isin("Bash", "Read", "Write", "Edit"), 2).when(tool == "Agent", 3).otherwise(1)


def distinct_events(events: DataFrame) -> DataFrame:
    """The first event of each content, by its hash; repeats are combined before the shuffle."""
    hashed = events.withColumn("data_hash", F.sha2("data", 256))
    cols = [c for c in hashed.columns if c != "data_hash"]
    return hashed.groupBy("data_hash").agg(F.min_by(F.struct(*cols), F.struct("created_at", "event_id")).alias("_e")).select("_e.*", "data_hash")


def recent(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(F.col("priority").desc(), F.col("created_at").desc(), F.col("event_id").desc()).limit(limit)


def retained(events: DataFrame, most: int = 500, session: str | None = None) -> DataFrame:
    """The `most` events of highest priority, the latest first among equals; of each session, if one is named."""
    if session is None:
        return recent(events, most)
    order = Window.partitionBy(session).orderBy(F.col("priority").desc(), F.col("created_at").desc(), F.col("event_id").desc())
    return events.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def categories(events: DataFrame) -> DataFrame:
    """category, n, latest, priority: how many events, that of the highest priority and latest time first."""
    name = F.coalesce("category", F.lit("general"))
    return events.groupBy(name.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.max_by("created_at", F.struct("priority", "created_at")).alias("latest"), F.max("priority").alias("priority"))


def snapshot(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The sections of a resume snapshot that fit its size, in order, and how many categories don't.

    At most `snapshot_events` events have categories, so the running size is over a short list.
    """
    cats = categories(recent(events, settings.snapshot_events))
    text = F.concat(F.lit("### "), "category", F.lit("\n- "), F.col("n").cast("string"), F.lit(" events (latest: "), F.date_format("latest", "yyyy-MM-dd HH:mm:ss"), F.lit(")\n\n"))
    order = Window.orderBy(F.col("priority").desc(), "category")
    head = len("## Session Resume\n\n")
    rows = cats.withColumn("section", text).withColumn("place", F.row_number().over(order))
    size = F.sum(F.octet_length("section")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + head
    return rows.withColumn("size", size).withColumn("fits", F.col("size") <= settings.snapshot_bytes)


def snapshot_text(events: DataFrame, settings: Settings = Settings()) -> str:
    rows = snapshot(events, settings).orderBy("place").collect()
    if not rows:
        return "No session events recorded."
    fits = [r.section for r in rows if r.fits]
    left = f"... [{len(rows) - len(fits)} more categories]\n" if len(fits) < len(rows) else ""
    return "## Session Resume\n\n" + "".join(fits) + left
