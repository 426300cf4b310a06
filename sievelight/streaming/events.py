"""Streaming forms: events without repeats, bounded sessions, running alerts and write-through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import events, policy


def read_hook_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Tool calls as they come in: JSON documents in a folder."""
    schema = "tool_name string, tool_input struct<file_path: string, command: string, url: string>, tool_response string, event_id long, created_at timestamp"
    return spark.readStream.schema(schema).json(folder)


def read_events(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(folder)


def distinct_stream(rows: DataFrame, watermark: str | None = None) -> DataFrame:
    """The first event of each content; contents are remembered for ever, or, if a watermark is given, for as long as that."""
    hashed = rows.withColumn("data_hash", F.sha2("data", 256))
    if watermark is None:
        return hashed.dropDuplicates(["data_hash"])
    return hashed.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["data_hash"])


def retained_stream(rows: DataFrame, sink: Callable[[DataFrame, int], None], most: int = 500, session: str | None = None):
    """Each micro-batch without repeats and cut to what is retained, given to the sink."""

    def one(batch: DataFrame, number: int) -> None:
        sink(events.retained(events.distinct_events(batch), most, session), number)

    return rows.writeStream.foreachBatch(one)


def alert_stream(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(session, threshold, used): the highest threshold that each session's running tokens newly reach.

    The state of a session is its sum and the highest threshold that fired.
    """
    budget, thresholds = settings.budget_tokens, settings.thresholds

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used, fired = state.get if state.exists else (0, 0)
        out = []
        for batch in batches:
            for n in batch.sort_values("returned_at")["token_estimate"].tolist():
                used += int(n)
                reached = max((t for t in thresholds if used * 100 // budget >= t), default=0)
                if reached > fired:
                    fired = reached
                    out.append((key[0], reached, used))
        state.update((used, fired))
        yield pd.DataFrame(out, columns=["session", "threshold", "used"])

    return rows.groupBy("session").applyInPandasWithState(step, "session string, threshold int, used long", "used long, fired int", "append", "NoTimeout")


def write_through(rows: DataFrame, reindex: Callable[[list[str]], None]):
    """Files that calls wrote are indexed anew, a micro-batch at a time; a batch's distinct paths are a short list."""

    def one(batch: DataFrame, number: int) -> None:
        paths = policy.written_paths(F.col("tool_name"), F.col("tool_input.file_path"), F.col("tool_input.command"), F.col("tool_response"))
        found = batch.select(F.explode(paths).alias("path")).distinct().orderBy("path")
        reindex([r.path for r in found.toLocalIterator()])

    return rows.writeStream.foreachBatch(one)
