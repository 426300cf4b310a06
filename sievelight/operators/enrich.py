"""Metadata of notes: frontmatter, wiki links and folders."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def frontmatter(text: str | None) -> str:
    """The YAML mapping between leading `---` lines, as JSON; {} for anything else."""
    import yaml

    body = (text or "").lstrip()
    inner, closed, _ = body[3:].partition("\n---")
    if not body.startswith("---") or not closed:
        return "{}"
    try:
        found = yaml.safe_load(inner.strip() or "null")
    except yaml.YAMLError:
        return "{}"
    return json.dumps(found, default=str, ensure_ascii=False) if isinstance(found, dict) else "{}"


def frontmatter_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(frontmatter)

    return run(text)


def wikilinks(text: Column) -> Column:
    """Distinct link targets, without aliases, in order of their first place."""
    inner = F.regexp_extract_all(text, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(inner, lambda x: F.trim(F.element_at(F.split(x, r"\|"), 1))), lambda x: x != ""))


def folder_tags(path: Column, base: str = "") -> Column:
    """The folders between the base and the file; none outside the base."""
    base = base.rstrip("/")
    rel = F.substring(path, F.lit(len(base) + 2), F.length(path)) if base else F.ltrim(path, F.lit("/"))
    parts = F.filter(F.split(rel, "/"), lambda x: x != "")
    inside = F.startswith(path, F.lit(base + "/")) if base else F.lit(True)
    return F.when(inside & (F.size(parts) > 1), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))


KNOWN = ("frontmatter", "wikilinks", "folder_tags")


def metadata(names: list[str], text: Column, path: Column, base: str = "") -> Column:
    """The chosen enrichments as one JSON object without empty ones; unknown names are told and passed over."""
    for name in names:
        if name not in KNOWN:
            log.warning("unknown enrichment %r is ignored", name)
    parts = []
    if "frontmatter" in names:
        found = frontmatter_json(text)
        parts.append(F.when(found != "{}", F.concat(F.lit('"frontmatter":'), found)))
    for name, value in (("wikilinks", wikilinks(text)), ("folder_tags", folder_tags(path, base))):
        if name in names:
            parts.append(F.when(F.size(value) > 0, F.concat(F.lit(f'"{name}":'), F.to_json(value))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("{}")


def enrich(df: DataFrame, names: list[str], text_col: str, path_col: str, base: str = "") -> DataFrame:
    return df.withColumn("metadata", metadata(names, F.col(text_col), F.col(path_col), base))


def enrich_by(df: DataFrame, function: Callable[[str, str], dict], text_col: str, path_col: str) -> DataFrame:
    """Metadata by a function of one's own, of a text and its path, a batch at a time."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(function(t, p), ensure_ascii=False) for t, p in zip(texts, paths, strict=True)])

    return df.withColumn("metadata", run(text_col, path_col))
