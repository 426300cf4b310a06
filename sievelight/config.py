"""Settings and the retrieval profiles."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Defaults of the engine; every operator takes what it needs as arguments."""

    limit: int = 15
    #: Whether the engine's indexes compare words by their Porter stems.
    stem: bool = True
    keyword_weight: float = 1.0
    vector_weight: float = 1.0
    rrf_k: int = 60
    snippet_bytes: int = 2000
    secondary_snippet_bytes: int = 800
    top_results: int = 3
    preview_threshold: int = 8192
    preview_bytes: int = 3072
    max_output_bytes: int = 102_400
    head_ratio: float = 0.6
    inline_tokens: int = 20_000
    #: Corrections look at so many terms, the first in order; None: at all.
    fuzzy_terms: int | None = 500
    fuzzy_distance: int = 2
    frontier: int = 50
    max_depth: int = 3
    stale_minutes: int = 60
    retained_events: int = 500
    snapshot_bytes: int = 2048
    snapshot_events: int = 100
    budget_tokens: int = 200_000
    thresholds: tuple[int, ...] = (40, 60, 70, 80, 90)
    recency_weight: float = 0.4
    frequency_weight: float = 0.3
    staleness_weight: float = 0.3


@dataclass(frozen=True)
class Profile:
    """How a kind of work bends ranking: weights, bias to the knowledge store, graph boost and snippet sizes."""

    name: str
    keyword: float = 1.0
    vector: float = 1.0
    bias: float = 1.0
    boost: float = 0.0
    scoped_boost: float = 0.0
    inject: bool = False
    snippets: tuple[int, int] | None = None
    #: (words that must occur, what is then added); no words: always added
    expansions: tuple[tuple[tuple[str, ...], str], ...] = field(default=())

    @property
    def explicit(self) -> bool:
        return self.name != "default"

    def graph_boost(self, scoped: bool) -> float:
        return self.scoped_boost if scoped else self.boost

    def expand(self, query: str) -> str:
        query = query.strip()
        low = query.lower()
        added = [extra for words, extra in self.expansions if query and (not words or any(w in low for w in words))]
        return " ".join([query, *added]) if added else query


# The five profiles.
PROFILES = {
    p.name: p
    for p in (
        Profile("default"),
        Profile("code_review", 1.35, 0.9, 1.0, 0.0, 0.0015, False, (1400, 600)),
        Profile("debug", 1.1, 1.0, 1.05, 0.0015, 0.0015, False, (1800, 900), ((("panic", "exception", "error"), "failure root cause"), (("trace", "stack"), "stack trace"))),
        Profile("planning", 1.0, 1.1, 1.15, 0.003, 0.003, True, (2400, 1400), (((), "architecture plan steps"),)),
        Profile("vault_navigation", 0.95, 1.2, 1.25, 0.0045, 0.0045, True, (1200, 700), (((), "related notes links"),)),
    )
}


def profile(name: str | None) -> Profile:
    try:
        return PROFILES[name or "default"]
    except KeyError:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(PROFILES)}") from None
