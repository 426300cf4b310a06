"""A whole query: rewriting, both corpora, bias and links, one list, and what is said of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Profile, Settings, profile
from ..functions import text as T
from ..operators import filters, links, search
from ..operators.indexing import Index


@dataclass
class Request:
    query: str
    source: str | None = None
    content_type: str | None = None
    limit: int | None = None
    include_knowledge: bool = True
    filter: str | None = None
    profile: str | None = None
    explain: bool = False
    use_memory: bool | None = None
    query_vector: list[float] | None = None


@dataclass
class Plan:
    """What a request comes to after its profile and memory had their say."""

    profile: Profile
    query: str
    source: str | None
    filter: str | None
    memory_applied: bool = False
    hints: dict[str, bool] = field(default_factory=dict)


def rewrite(request: Request, memory: dict | None = None) -> Plan:
    """Apply the profile's words, then what memory learnt: its query only if the profile added nothing, hints where none are given."""
    p = profile(request.profile)
    plain = request.query.strip()
    plan = Plan(p, p.expand(plain) if p.explicit else plain, request.source, request.filter)
    use = p.explicit if request.use_memory is None else request.use_memory and p.explicit
    if use and memory:
        if plan.query == plain and memory.get("learned_query") not in (None, plain):
            plan.query = memory["learned_query"]
            plan.hints["memory_query_hint"] = True
        source = memory.get("learned_source_hint") or memory.get("winning_source_label")
        if plan.source is None and source:
            plan.source = source
            plan.hints["memory_source_hint"] = True
        if plan.filter is None and memory.get("learned_filter_hint"):
            plan.filter = memory["learned_filter_hint"]
            plan.hints["memory_filter_hint"] = True
        plan.memory_applied = bool(plan.hints)
    return plan


COLUMNS = ("source_type", "source_id", "label", "file_path", "title", "content", "score", "lines", "bm25", "trigram", "fuzzy", "vector", "proximity", "knowledge_bias", "graph_boost", "metadata_match", "graph_neighbor", "memory_query_hint", "memory_source_hint", "memory_filter_hint")


def _unified(rows: DataFrame, source_type: str, hints: dict[str, bool], metadata_match: bool = False) -> DataFrame:
    have = set(rows.columns)
    zero, none = F.lit(0.0), F.lit(None).cast("string")
    pick = {
        "source_type": F.lit(source_type), "source_id": F.col("source_id"), "label": F.coalesce("label", F.lit("")), "file_path": F.col("rel_path") if "rel_path" in have else none,
        "title": F.col("title"), "content": F.col("content"), "score": F.col("score"), "lines": T.line_range(F.coalesce("line_start", F.lit(0)), F.coalesce("line_end", F.lit(0))),
        "metadata_match": F.lit(metadata_match), "graph_neighbor": F.col("graph_neighbor") if "graph_neighbor" in have else F.lit(False),
    }
    for c in ("bm25", "trigram", "fuzzy", "vector", "proximity", "knowledge_bias", "graph_boost"):
        pick[c] = F.coalesce(c, zero) if c in have else zero
    for c in ("memory_query_hint", "memory_source_hint", "memory_filter_hint"):
        pick[c] = F.lit(hints.get(c, False))
    return rows.select(*[pick[c].alias(c) for c in COLUMNS])


def run(request: Request, session: Index, knowledge: Index | None = None, link_table: DataFrame | None = None, memory: dict | None = None, settings: Settings = Settings()) -> tuple[Plan, DataFrame]:
    """The plan and its results, best first, with a rank from 1."""
    plan = rewrite(request, memory)
    n = request.limit or settings.limit
    kw, vw = settings.keyword_weight * plan.profile.keyword, settings.vector_weight * plan.profile.vector
    where = filters.session(plan.source, None, request.content_type)
    rows = search.hybrid(session, plan.query, settings, request.query_vector, where, kw, vw, n)
    out = _unified(rows, "session", plan.hints)
    if request.include_knowledge and knowledge is not None:
        wanted = filters.parse(plan.filter)
        if plan.source is not None:
            wanted = [*wanted, filters.Predicate("source", "source", plan.source)]
        inside = filters.condition(wanted, F.coalesce("metadata", F.lit("{}")), F.col("label"))
        found = search.hybrid(knowledge, plan.query, settings, request.query_vector, inside, kw, vw, n)
        biased = F.col("score") * plan.profile.bias
        found = found.withColumn("knowledge_bias", biased - F.col("score")).withColumn("score", biased)
        boost = plan.profile.graph_boost(plan.source is not None or plan.filter is not None)
        if boost > 0 and link_table is not None:
            found = links.graph_rerank(found, link_table, knowledge.chunks, boost, plan.profile.inject)
        out = out.unionByName(_unified(found, "knowledge", plan.hints, bool(filters.parse(plan.filter))))
    order = [F.round("score", 9).desc(), F.col("source_type").desc(), F.col("source_id"), F.col("title")]
    top = out.orderBy(*order).limit(n)
    return plan, top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def sizes(p: Profile, settings: Settings) -> tuple[int, int]:
    return p.snippets or (settings.snippet_bytes, settings.secondary_snippet_bytes)


def snippets(results: DataFrame, p: Profile, settings: Settings = Settings()) -> DataFrame:
    """Results with their snippets, larger ones for the first; and whether a snippet is shorter than its content."""
    first, rest = sizes(p, settings)
    near = F.col("rank") <= settings.top_results
    text = F.when(near, T.preview(F.col("content"), first)).otherwise(T.preview(F.col("content"), rest))
    cut = F.octet_length("content") > F.when(near, first).otherwise(rest)
    return results.withColumn("snippet", text).withColumn("cut", cut)


def entry_line(score: Column) -> Column:
    """The line over a result: its title, where it is from, and its score."""
    place = F.when(F.col("source_type") == "session", F.format_string("source: %s, source_id: %d, type: session", "label", "source_id")).otherwise(F.format_string("source: %s, type: knowledge, file: %s", "label", F.coalesce("file_path", F.lit(""))))
    return F.concat(F.format_string("**[%s]** (", "title"), place, F.format_string(", score: %.4f", score), "lines", F.lit(")"))


def report(request: Request, plan: Plan, results: DataFrame, settings: Settings = Settings()) -> str:
    """The results as text; at most the limit's rows come to the driver."""
    rows = snippets(results, plan.profile, settings)
    told = rows.select("rank", entry_line(F.col("score")).alias("line"), search.why(rows).alias("why"), search.why(rows, True).alias("detail"), "snippet", "cut").orderBy("rank").collect()
    out = [f'### "{request.query}"']
    if plan.memory_applied:
        out.append(f'Search memory adjusted this query: "{plan.query}".\n')
    if not told:
        return "\n".join([*out, "No results.", ""])
    for r in told:
        out += [r.line, r.why, r.snippet, "", *([r.detail, ""] if request.explain else [])]
    if any(r.cut for r in told):
        out.append("Some results were cut. Read the chunks of a source for all of it.")
    return "\n".join(out)


def note_on_breadth(queries: list[str], source: str | None) -> str | None:
    """A hint for one short query over everything."""
    if source is None and len(queries) == 1 and len(queries[0].split()) <= 2:
        return "This is a broad query: name a source, or add words."
    return None
