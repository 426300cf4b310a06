"""Splitting texts into titled, line-addressed chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Sizes in bytes, and what marks lines of code.
MOST = 4096
LEAST = 256
HEADINGS = ("# ", "## ", "### ", "#### ")
NOT_MARKDOWN_STARTS = ("<script", "<style", "<html", "<!DOCTYPE", "import ", "from ", "package ", "use ")
FUNCTION_STARTS = ("function ", "def ", "fn ", "pub fn ", "class ")
BOUNDARY_STARTS = (
    "function ", "function(", "public function ", "private function ", "protected function ", "static function ", "async function ",
    "class ", "abstract class ", "trait ", "interface ", "def ", "async def ", "fn ", "pub fn ", "pub(crate) fn ", "impl ", "pub struct ", "pub enum ",
    "<script", "<style", "</script>", "</style>", "<?php", "@media", "@keyframes",
)
CODE_STARTS = ("fn ", "pub ", "let ", "const ", "import ", "from ", "def ", "class ", "//", "/*", "#", "{", "}")


def _starts(line: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(line, F.lit(p))
    return found


def _ends(line: Column, suffixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for s in suffixes:
        found = found | F.endswith(line, F.lit(s))
    return found


def content_kind(text: Column) -> Column:
    """'markdown', 'code' or 'plain' by the shares of headings, bullets, fences and code endings among the lines."""
    lines = F.transform(T.lines_of(text), F.trim)
    count = lambda test: F.size(F.filter(lines, test))
    bullet = lambda x: _starts(x, ("- ", "* ")) & ~F.contains(x, F.lit("{")) & ~F.contains(x, F.lit(";"))
    marks = count(lambda x: _starts(x, HEADINGS) | F.startswith(x, F.lit("```")) | bullet(x))
    against = count(lambda x: F.contains(x, F.lit("<?php")) | _starts(x, NOT_MARKDOWN_STARTS)) + count(lambda x: _ends(x, (";", "{")))
    endings, filled = count(lambda x: _ends(x, (";", "{", "}"))), count(lambda x: x != "")
    function = F.exists(lines, lambda x: _starts(x, FUNCTION_STARTS) | F.contains(x, F.lit("function(")) | F.contains(x, F.lit("function (")))
    pair = lambda a, b: F.contains(text, F.lit(a)) & F.contains(text, F.lit(b))
    markdown = (marks > 0) & (marks / F.greatest(F.size(lines), F.lit(1)) > 0.02) & (against <= marks * 2)
    tags = F.contains(text, F.lit("<?php")) | F.contains(text, F.lit("<?=")) | pair("<script", "</script>") | pair("<style", "</style>")
    code = tags | ((filled > 0) & ((endings / F.greatest(filled, F.lit(1)) > 0.4) | (function & (endings > 5))))
    return F.when(markdown, "markdown").when(code, "code").otherwise("plain")


def code_share(text: Column) -> Column:
    """Share of lines that look like code (0 without lines)."""
    lines = F.transform(T.lines_of(text), F.trim)
    code = F.size(F.filter(lines, lambda x: _starts(x, CODE_STARTS) | _ends(x, (";", "{"))))
    return F.when(F.size(lines) > 0, code / F.size(lines)).otherwise(0.0)


def is_code(text: Column) -> Column:
    return F.contains(text, F.lit("```")) | (code_share(text) > 0.6)


@dataclass(frozen=True)
class Piece:
    title: str
    content: str
    line_start: int
    line_end: int

    @property
    def is_code(self) -> bool:
        lines = [x.strip() for x in _lines(self.content)]
        return "```" in self.content or (bool(lines) and sum(x.startswith(CODE_STARTS) or x.endswith((";", "{")) for x in lines) / len(lines) > 0.6)


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p.removesuffix("\r") for p in parts]


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def _within(text: str) -> tuple[str, str]:
    """A longest start of at most MOST bytes that ends between characters, and the rest."""
    start = text.encode("utf-8", "surrogatepass")[:MOST].decode("utf-8", "ignore")
    return start, text[len(start) :]


def by_lines(piece: Piece) -> Iterator[Piece]:
    """An oversized piece cut between lines, and within a line that is oversized itself."""
    held, part, at = "", 0, piece.line_start
    lines = _lines(piece.content)
    number = piece.line_start - 1
    for number, line in enumerate(lines, piece.line_start):
        if held and _size(held) + _size(line) + 1 > MOST:
            part += 1
            yield Piece(f"{piece.title} (part {part})", held, at, max(number - 1, at))
            held, at = "", number
        held = f"{held}\n{line}" if held else line
        while _size(held) > MOST:
            start, held = _within(held)
            part += 1
            yield Piece(f"{piece.title} (part {part})", start, at, number)
            at = number
    if held:
        yield Piece(f"{piece.title} (part {part + 1})" if part else piece.title, held, at, number)


def by_paragraphs(piece: Piece) -> Iterator[Piece]:
    """A section as it is if it is small enough, else packed paragraph by paragraph."""
    if _size(piece.content) <= MOST:
        yield piece
        return
    paragraphs = piece.content.split("\n\n")
    if len(paragraphs) == 1:
        yield from by_lines(piece)
        return
    held, part, passed, at = "", 0, 0, piece.line_start
    for paragraph in paragraphs:
        if held and _size(held) + _size(paragraph) + 2 > MOST:
            part += 1
            found = Piece(f"{piece.title} (part {part})", held, at, max(piece.line_start + passed - 1, at))
            yield from by_lines(found) if _size(held) > MOST else (found,)
            held, at = "", piece.line_start + passed
        held = f"{held}\n\n{paragraph}" if held else paragraph
        passed += len(_lines(paragraph)) + 2
    if held:
        found = Piece(f"{piece.title} (part {part + 1})" if part else piece.title, held, at, piece.line_end)
        yield from by_lines(found) if _size(held) > MOST else (found,)


def markdown_sections(text: str) -> Iterator[Piece]:
    """Sections that begin at lines with # outside fences."""
    title, held, at, fenced = "(untitled)", [], 1, False
    lines = _lines(text)
    for number, line in enumerate(lines, 1):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif line.startswith("#") and not fenced:
            if held:
                yield Piece(title, "\n".join(held), at, number - 1)
            title, held, at = line.lstrip("#").strip(), [], number
        held.append(line)
    if held:
        yield Piece(title, "\n".join(held), at, len(lines))


def is_boundary(line: str) -> bool:
    line = line.strip()
    arrow = line.startswith(("const ", "let ")) and ("=> {" in line or "= function" in line)
    return line.startswith(BOUNDARY_STARTS) or line == "?>" or arrow


def _label(line: str) -> str:
    return line if len(line) <= 60 else line[:57] + "..."


def code_sections(text: str) -> Iterator[Piece]:
    """Sections that begin at a structural line once at least LEAST bytes are gathered."""
    held, size, at, title = [], 0, 1, None
    lines = _lines(text)

    def named() -> str:
        return title or next((_label(x.strip()) for x in held[:5] if len(x.strip().encode()) > 2), "code-section")

    for number, line in enumerate(lines, 1):
        boundary = is_boundary(line)
        if boundary and size >= LEAST:
            yield Piece(named(), "\n".join(held), at, number - 1)
            held, size, at, title = [], 0, number, None
        if boundary and title is None:
            title = _label(line.strip())
        held.append(line)
        size += _size(line) + 1
    if held:
        yield Piece(named(), "\n".join(held), at, len(lines))


def plain_sections(text: str) -> Iterator[Piece]:
    """Paragraphs, trimmed, packed up to MOST bytes; only the last section is cut if it is oversized.

    A paragraph that is oversized by itself stays whole when another follows.
    """
    held, count, passed, at = "", 0, 0, 1
    for paragraph in text.split("\n\n"):
        body = paragraph.strip()
        if not body:
            continue
        if held and _size(held) + _size(body) + 2 > MOST:
            count += 1
            yield Piece(f"section-{count}", held, at, max(passed - 1, at))
            held, at = "", passed + 1
        held = f"{held}\n\n{body}" if held else body
        passed += len(_lines(paragraph)) + 2
    if held:
        found = Piece(f"section-{count + 1}", held, at, max(len(_lines(text)), at))
        yield from by_lines(found) if _size(held) > MOST else (found,)


def pieces(text: str, kind: str) -> list[Piece]:
    if kind == "plain":
        return list(plain_sections(text))
    sections = markdown_sections(text) if kind == "markdown" else code_sections(text)
    found = [p for s in sections for p in by_paragraphs(s)]
    return found or [Piece("(untitled)" if kind == "markdown" else "code", text, 1, max(1, len(_lines(text))))]


OUT = "title string, content string, is_code boolean, line_start int, line_end int"


def chunk(df: DataFrame, keep: list[str], text_col: str = "text", id_col: str = "chunk_id") -> DataFrame:
    """The columns `keep` with each text's chunks: their place, title, content, is_code and lines.

    The kind is found natively; packing greedily by bytes is done a batch of texts at a time.
    """
    rows = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_kind", content_kind(F.col("_text")))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                for place, p in enumerate(pieces(row[-2], row[-1])):
                    out.append((*row[:-2], place, p.title, p.content, p.is_code, p.line_start, p.line_end))
            yield pd.DataFrame(out, columns=[*keep, "place", "title", "content", "is_code", "line_start", "line_end"])

    return rows.mapInPandas(run, ", ".join([*kinds, "place int", OUT]))


def markdown_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Markdown sections natively: (id, section, title, content, line_start, line_end), by a running count of headings.

    Sections are not cut to size here.
    """
    lines = df.select(id_col, F.posexplode(T.lines_of(F.col(text_col))).alias("pos", "line"))
    order = Window.partitionBy(id_col).orderBy("pos")
    fence = F.startswith(F.ltrim("line"), F.lit("```"))
    fences = lines.withColumn("fence", fence).withColumn("fences", F.sum(F.col("fence").cast("int")).over(order))
    heading = F.startswith(F.col("line"), F.lit("#")) & ~F.col("fence") & (F.col("fences") % 2 == 0)
    marked = fences.withColumn("heading", heading).withColumn("section", F.sum(F.col("heading").cast("int")).over(order))
    parts = marked.groupBy(id_col, "section").agg(
        F.min_by("line", "pos").alias("first"),
        F.max("heading").alias("headed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"),
        (F.min("pos") + 1).cast("int").alias("line_start"),
        (F.max("pos") + 1).cast("int").alias("line_end"),
    )
    title = F.when(F.col("headed"), F.trim(F.regexp_replace("first", "^#+", ""))).otherwise(F.lit("(untitled)"))
    return parts.select(id_col, F.col("section").cast("int").alias("section"), title.alias("title"), "content", "line_start", "line_end")
