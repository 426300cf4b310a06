"""Search memory: which run showed what, and what is learnt from results that were used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("normalized_query", "profile")


def learned(credits: DataFrame) -> DataFrame:
    """The memory after all credits (normalized_query, profile, learned_query, hints, winners, credited_at), applied in order.

    The last query counts; a hint stays until another replaces it; successes are counted.
    """
    hints = ["learned_source_hint", "learned_filter_hint", "winning_source_label", "winning_file_path"]
    order = F.struct("credited_at", "run_id")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in hints]
    return credits.groupBy(*KEYS).agg(F.max_by("learned_query", order).alias("learned_query"), *last, F.count(F.lit(1)).alias("success_count"), F.max("credited_at").alias("last_success"))


def upsert(memory: DataFrame, credits: DataFrame) -> DataFrame:
    """Memory with new credits: new values first, old ones where there is no new one."""
    new = learned(credits)
    old = memory.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in memory.columns if c not in KEYS])
    rows = new.join(old, list(KEYS), "full_outer")
    cols = [F.coalesce(c, f"_{c}").alias(c) for c in memory.columns if c not in (*KEYS, "success_count", "last_success")]
    count = (F.coalesce("success_count", F.lit(0)) + F.coalesce("_success_count", F.lit(0))).alias("success_count")
    return rows.select(*KEYS, *cols, count, F.greatest("last_success", "_last_success").alias("last_success"))


def latest_run(runs: DataFrame, hits: DataFrame, by: str) -> DataFrame:
    """The latest run that showed each source label, or each file path."""
    rows = hits.filter(F.col(by).isNotNull()).select("run_id", by).join(runs, "run_id")
    return rows.groupBy(by).agg(F.max_by(F.struct(*[c for c in rows.columns if c != by]), F.struct("created_at", "run_id")).alias("_r")).select(by, "_r.*")


def latest_query(runs: DataFrame) -> DataFrame:
    """The latest run of each normalized query."""
    order = Window.partitionBy("normalized_query").orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    return runs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def lookup(memory: DataFrame, normalized_query: str, profile: str) -> DataFrame:
    return memory.filter((F.col("normalized_query") == normalized_query) & (F.col("profile") == profile))


def credit(run: DataFrame, winning_label: Column, winning_path: Column, at: Column) -> DataFrame:
    """A credit for runs whose result was read or followed."""
    return run.select("normalized_query", "profile", F.col("effective_query").alias("learned_query"), F.col("source_hint").alias("learned_source_hint"), F.col("filter_hint").alias("learned_filter_hint"), winning_label.alias("winning_source_label"), winning_path.alias("winning_file_path"), at.alias("credited_at"), "run_id")
