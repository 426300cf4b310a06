"""The ledger of what was shown: totals, relevance of sources, advice and budget alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings


def tokens_of(n_bytes: Column) -> Column:
    return F.floor(n_bytes / 4).cast("long")


def breakdown(ledger: DataFrame) -> DataFrame:
    """label, tokens, access_count, last_access of each source; a source is one group, summed before the shuffle."""
    return ledger.groupBy(F.col("source_label").alias("label")).agg(F.sum("token_estimate").alias("tokens"), F.sum("access_count").cast("long").alias("access_count"), F.max("returned_at").alias("last_access")).orderBy(F.col("tokens").desc(), "label")


def totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.coalesce(F.sum("token_estimate"), F.lit(0)).cast("long").alias("total_tokens"), F.countDistinct("source_label").alias("source_count"))


def relevance(sources: DataFrame, as_of: Column, settings: Settings = Settings()) -> DataFrame:
    """breakdown() with relevance: recency and frequency, less staleness beyond the limit.

    The most accesses are one row that is joined to all sources.
    """
    top = sources.agg(F.greatest(F.max("access_count"), F.lit(1)).alias("_most"))
    minutes = F.greatest(F.unix_timestamp(as_of) - F.unix_timestamp("last_access"), F.lit(0)) / 60.0
    minutes = F.coalesce(minutes, F.lit(999.0))
    over = F.when(minutes > settings.stale_minutes, F.least(minutes - settings.stale_minutes, F.lit(60.0)) / 60.0).otherwise(0.0)
    score = settings.recency_weight / (1 + minutes / 10) + settings.frequency_weight * F.col("access_count") / F.col("_most") - settings.staleness_weight * over
    level = F.when(F.col("relevance") > 0.6, "high").when(F.col("relevance") > 0.3, "mid").otherwise("low")
    return sources.join(F.broadcast(top)).withColumn("relevance", score).drop("_most").withColumn("level", level)


def keep_and_drop(scored: DataFrame, keep: int = 3, drop: int = 3) -> DataFrame:
    """The most relevant sources to keep, and of the others the least relevant to drop: (label, tokens, relevance, advice).

    Both lists are short, and found without ranking all sources in one place.
    """
    best = scored.orderBy(F.round("relevance", 9).desc(), "label").limit(keep).withColumn("advice", F.lit("keep"))
    rest = scored.join(F.broadcast(best.select("label")), "label", "left_anti")
    worst = rest.orderBy(F.round("relevance", 9), F.col("label").desc()).limit(drop).withColumn("advice", F.lit("drop"))
    return best.select("label", "tokens", "access_count", "relevance", "advice").unionByName(worst.select("label", "tokens", "access_count", "relevance", "advice"))


def savings(advice: DataFrame) -> DataFrame:
    return advice.agg(F.coalesce(F.sum(F.when(F.col("advice") == "drop", F.col("tokens"))), F.lit(0)).cast("long").alias("savings"))


def crossings(ledger: DataFrame, settings: Settings = Settings(), session: str | None = None, order: tuple[str, ...] = ("returned_at", "chunk_id")) -> DataFrame:
    """Rows at which the running share of the budget first reaches a threshold: with the highest one that is newly reached.

    One running sum for each session; without a session the whole ledger is one, which is a single budget's worth of rows.
    """
    own = Window.partitionBy(*([session] if session else [])).orderBy(*order)
    used = F.sum("token_estimate").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pct = F.floor(used * 100 / settings.budget_tokens).cast("int")
    level = F.lit(0)
    for t in settings.thresholds:
        level = F.when(F.col("pct") >= t, t).otherwise(level)
    rows = ledger.withColumn("used", used).withColumn("pct", pct).withColumn("threshold", level)
    return rows.withColumn("_before", F.coalesce(F.lag("threshold").over(own), F.lit(0))).filter(F.col("threshold") > F.col("_before")).drop("_before")


def visibility(indexed: DataFrame, shown: DataFrame) -> DataFrame:
    """Bytes indexed and shown, saved tokens, the shares (0 without input), and whether too little was seen."""
    a = indexed.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes_indexed"))
    b = shown.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes_returned"))
    rows = a.join(F.broadcast(b))
    saved = F.greatest(F.col("bytes_indexed") - F.col("bytes_returned"), F.lit(0))
    share = lambda x: F.when(F.col("bytes_indexed") > 0, x / F.col("bytes_indexed")).otherwise(0.0)
    out = rows.withColumn("tokens_saved", F.floor(saved / 4).cast("long")).withColumn("savings_ratio", share(saved)).withColumn("visibility_ratio", share(F.col("bytes_returned")))
    return out.withColumn("too_little_seen", (F.col("bytes_indexed") > 10_000) & (F.col("visibility_ratio") < 0.05))


def alert_text(threshold: int, used: int, settings: Settings, sources: list, keep: list, drop: list) -> str:
    """What is said when a threshold is reached; the lists are short (label, tokens, relevance) rows."""
    labels = lambda rows: ", ".join(r.label for r in rows)
    if threshold == 40:
        return f"[context 40%: {used}/{settings.budget_tokens} tokens across {len(sources)} sources]"
    if threshold == 60:
        return f"[context 60%: top consumers are {', '.join(f'{r.label} ({r.tokens}t)' for r in sources[:3])}. Search rather than read again.]"
    if threshold == 70:
        return f"[context 70%: drop {labels(drop)}. Relevance: {', '.join(f'{r.label} ({r.relevance:.2f})' for r in keep)}.]"
    if threshold == 80:
        return f"[context 80%: COMPACT. Keep {labels(keep)}. Drop {labels(drop)}. Saves {sum(r.tokens for r in drop)} tokens.]"
    return f"[context 90%: CRITICAL, compact now. {max(0, settings.budget_tokens - used)} tokens remain. Most valuable: {labels(keep)}.]"


def recommendation(ledger: DataFrame, as_of: Column, settings: Settings = Settings()) -> str:
    """Advice before compaction, in Markdown; what comes to the driver is six rows and totals."""
    used = totals(ledger).first()
    if not used.source_count:
        return "No tracked sources."
    advice = keep_and_drop(relevance(breakdown(ledger), as_of, settings)).collect()
    line = lambda r: f"- **{r.label}**: {r.tokens}t, {r.access_count} accesses, relevance {r.relevance:.2f}"
    keep, drop = ([line(r) for r in advice if r.advice == a] for a in ("keep", "drop"))
    saved = sum(r.tokens for r in advice if r.advice == "drop")
    return "\n".join(["## Budget", "", f"- Tokens used: {used.total_tokens}/{settings.budget_tokens}", f"- Sources: {used.source_count}", "", "## Keep", "", *keep, "", "## Drop", "", *drop, "", f"Saves {saved} tokens"])
