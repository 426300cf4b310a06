"""Text functions as native column expressions; lengths are UTF-8 bytes unless said otherwise."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that are a base letter with marks, and their base letters."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), *_accents())


def tokens(text: Column) -> Column:
    """Folded words: maximal runs of letters and digits."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def count_words(folded: Column) -> Column:
    """How many words a folded text has."""
    return F.regexp_count(folded, F.lit(r"[\p{L}\p{N}]+"))


def count_word(folded: Column, word: str) -> Column:
    """How often a folded text has a word (of letters and digits)."""
    whole = rf"{word}(?<![\p{{L}}\p{{N}}]{word})(?![\p{{L}}\p{{N}}])"
    return F.when(F.contains(folded, F.lit(word)), F.regexp_count(folded, F.lit(whole))).otherwise(0)


def query_tokens(query: str) -> list[str]:
    """The same for a query held by the driver."""
    table = str.maketrans(*_accents())
    return [w for w in re.findall(r"[^\W_]+", query.lower().translate(table))]


def sanitize(query: Column) -> Column:
    """Letters, digits, _ and - stay, other runs become one space."""
    return F.trim(F.regexp_replace(query, r"[^\p{L}\p{N}_-]+", " "))


def sanitize_query(query: str) -> str:
    return re.sub(r"[^\w-]+", " ", query).strip()


def normalize_query(query: Column) -> Column:
    """Lower-case words with one space between them."""
    return F.array_join(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""), " ")


def count_of(words: Column, word: str | Column) -> Column:
    """How often a word occurs among words."""
    return F.size(F.filter(words, lambda w: w == word))


def occurrences(text: Column, phrase: Column) -> Column:
    """How often a phrase occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("long")


def first_byte(text: Column, word: str) -> Column:
    """Byte offset of a word's first occurrence, null if it doesn't occur."""
    at = F.locate(word, text)
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _head(text: Column, n: int) -> Column:
    """The longest whole-character start of at most n bytes, cut at its last newline if that is past the middle."""
    # What is left of a character that the cut goes through reads as replacement characters.
    raw = F.substring(text.cast("binary"), F.lit(1), F.lit(n))
    whole = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\ufffd+$", "")
    line = F.substring_index(whole, "\n", -1)
    kept = F.octet_length(whole) - F.octet_length(line) - 1
    return F.when(F.contains(whole, F.lit("\n")) & (kept > n // 2), F.substring(whole, F.lit(1), F.length(whole) - F.length(line) - 1)).otherwise(whole)


def preview(text: Column, n: int) -> Column:
    """The first n bytes, ended at a line if one ends past the middle, with a note of the whole size."""
    size = F.octet_length(text)
    return F.when(size <= n, text).otherwise(F.concat(_head(text, n), F.lit("\n\n... [truncated, "), size.cast("string"), F.lit(" bytes total]")))


def head_and_tail(text: Column, n: int, head_ratio: float) -> Column:
    """The first and the last bytes of an output, n in all, with a note of what is left out between them."""
    head = int(n * head_ratio)
    tail = n - head
    size = F.octet_length(text)
    start = _head(text, head)
    raw = F.substring(text.cast("binary"), size - tail + 1, F.lit(tail))
    end = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "^\ufffd+", "")
    first_line = F.substring_index(end, "\n", 1)
    past = F.octet_length(first_line)
    end = F.when(F.contains(end, F.lit("\n")) & (past < tail // 2), F.substring(end, F.length(first_line) + 2, F.length(end))).otherwise(end)
    left_out = size - F.octet_length(start) - F.octet_length(end)
    return F.when(size <= n, text).otherwise(F.concat(start, F.lit("\n\n... ["), left_out.cast("string"), F.lit(" bytes omitted] ...\n\n"), end))


def snippet(text: Column, n: int) -> Column:
    """At most n characters, cut at the last space before, with dots."""
    start = F.substring(text, 1, n)
    cut = F.when(F.contains(start, F.lit(" ")), F.regexp_replace(start, r"(?s) [^ ]*$", "")).otherwise(start)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("...")))


def shortened(text: Column, n: int = 500) -> Column:
    """At most n characters, the last three of them dots."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def adaptive(text: Column, threshold: int = 8192, n: int = 3072) -> Column:
    """The whole text up to the threshold, else a preview."""
    return F.when(F.octet_length(text) <= threshold, text).otherwise(preview(text, n))


def lines_of(text: Column) -> Column:
    """Lines, without the empty one that a final newline would leave; none for an empty text."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def line_range(start: Column, end: Column) -> Column:
    return F.when(start > 0, F.format_string(" (lines %d-%d)", start, end)).otherwise(F.lit(""))
