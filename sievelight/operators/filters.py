"""The metadata filter language: `key:value` words that all must hold."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEY = re.compile(r"[\w-]+")


@dataclass(frozen=True)
class Predicate:
    kind: str  # source, tag, folder or field
    key: str
    value: str


def parse(text: str | None) -> list[Predicate]:
    """Words without a colon, with an empty side, or with an odd key are passed over."""
    found = []
    for word in (text or "").split():
        key, colon, value = word.partition(":")
        if not colon or not key or not value:
            continue
        if key in ("source", "tag", "folder"):
            found.append(Predicate(key, key, value))
        elif _KEY.fullmatch(key):
            found.append(Predicate("field", key, value))
    return found


def text_field(metadata: Column, key: str) -> Column:
    """A frontmatter field that is a string, null for other types: numbers and booleans never equal a text."""
    value = F.try_variant_get(F.try_parse_json(metadata), f"$.frontmatter['{key}']", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))


def has_member(metadata: Column, path: str, value: str) -> Column:
    """Whether a JSON array at the path holds the text; false if it is absent or no array."""
    return F.coalesce(F.array_contains(F.from_json(F.get_json_object(metadata, path), "array<string>"), value), F.lit(False))


def condition(predicates: list[Predicate], metadata: Column, label: Column) -> Column | None:
    """All predicates as one column, None if there are none."""
    parts = []
    for p in predicates:
        if p.kind == "source":
            parts.append(label == p.value)
        elif p.kind == "tag":
            parts.append(has_member(metadata, "$.frontmatter.tags", p.value))
        elif p.kind == "folder":
            parts.append(has_member(metadata, "$.folder_tags", p.value))
        else:
            parts.append(F.coalesce(text_field(metadata, p.key) == p.value, F.lit(False)))
    return reduce(lambda a, b: a & b, parts) if parts else None


def session(label: str | None = None, source_id: int | None = None, content_type: str | None = None) -> Column | None:
    """Session filters: part of a label (any case; % and _ are wildcards), a source, a content type."""
    parts = []
    if label is not None:
        parts.append(F.col("label").ilike(f"%{label}%"))
    if source_id is not None:
        parts.append(F.col("source_id") == source_id)
    if content_type is not None:
        parts.append(F.col("content_type") == content_type)
    return reduce(lambda a, b: a & b, parts) if parts else None
