from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievelight.config import Settings, profile
from sievelight.operators import enrich, events, filters, indexing, ledger, links, memory, policy, search, sync
from sievelight.operators.indexing import Index
from sievelight.plans import retrieval

CHUNKS = "chunk_id long, source_id long, label string, title string, content string, content_type string, line_start int, line_end int"


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        (1, 1, "test-source", "authentication", "login with user tokens and sessions", "prose", 1, 2),
        (2, 1, "test-source", "database schema", "tables for users and orders", "prose", 3, 4),
        (3, 2, "other_100%", "error handling", "errors in the login are retried", "prose", 0, 0),
        (4, 2, "other_100%", "filler", "nothing of note", "prose", 0, 0),
        (5, 2, "other_100%", "more filler", "still nothing", "prose", 0, 0),
    ]
    return Index(spark.createDataFrame(rows, CHUNKS))


def ids(df):
    return [r.chunk_id for r in df.orderBy("rank").collect()]


def test_all_words_must_occur(index):
    assert ids(search.bm25(index, "login tokens", 10)) == [1]
    assert set(ids(search.bm25(index, "login", 10))) == {1, 3}
    assert ids(search.bm25(index, "", 10)) == [] and ids(search.bm25(index, "absent", 10)) == []


def test_postings_and_scan_agree(index):
    scan = search.bm25(index, "login nothing login", 10).collect()
    assert scan == search.bm25(index.with_postings(), "login nothing login", 10).collect()
    a = [(r.chunk_id, round(r.score, 9)) for r in search.bm25(index, "nothing", 10).collect()]
    assert a == [(r.chunk_id, round(r.score, 9)) for r in search.bm25(index.with_postings(), "nothing", 10).collect()]


def test_a_saved_index_reads_only_its_terms_folders(index, spark, tmp_path):
    index.save(f"{tmp_path}/index", 8)
    saved = Index.load(spark, f"{tmp_path}/index")
    for query in ("login tokens", "nothing", "login nothing login"):
        found = search.bm25(saved, query, 10)
        assert [(r.chunk_id, round(r.score, 9)) for r in found.collect()] == [(r.chunk_id, round(r.score, 9)) for r in search.bm25(index, query, 10).collect()]
    plan = search.bm25(saved, "tokens", 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(term_bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,tokens)" in plan, plan


def test_content_type_is_a_word_of_session_chunks(index):
    assert len(ids(search.bm25(index, "prose", 10))) == 5
    assert ids(search.bm25(Index(index.chunks, knowledge=True), "prose", 10)) == []


def test_label_filters_take_part_of_a_label_whatever_its_case(index):
    assert ids(search.bm25(index, "login", 10, filters.session("TEST"))) == [1]
    assert ids(search.bm25(index, "login", 10, filters.session("'; --"))) == []
    assert ids(search.bm25(index, "login", 10, filters.session("100%"))) == [3]


def test_substrings_need_three_bytes(index):
    assert ids(search.substring(index, "LOGIN with", 10)) == [1]
    assert ids(search.substring(index, "lo", 10)) == []


def test_corrections(index):
    assert search.corrected_query(index, "logim tabels", Settings()) == "login tables"
    assert search.corrected_query(index, "login", Settings()) is None


def test_hybrid_layers_and_reasons(index):
    rows = search.hybrid(index, "login tokens", Settings(limit=5))
    out = rows.select("chunk_id", "score", search.why(rows).alias("why")).collect()
    assert out[0].chunk_id == 1 and out[0].why.startswith("why: bm25") and "proximity" in out[0].why


def test_vector_layer_scores_keyword_hits_only(spark, index):
    rows = index.chunks.withColumn("embedding", F.array(F.col("chunk_id").cast("float"), F.lit(1.0).cast("float")))
    with_vectors = Index(rows)
    assert {r.chunk_id for r in search.hybrid(with_vectors, "login", Settings(limit=9, fuzzy_terms=0), [1.0, 0.0]).collect()} == {1, 3}
    full = search.hybrid(with_vectors, "login", Settings(limit=9, fuzzy_terms=0), [1.0, 0.0], full_recall=True)
    assert {r.chunk_id for r in full.collect()} == {1, 2, 3, 4, 5}
    assert len(search.hybrid(with_vectors, "qqqqqqqqq", Settings(limit=9, fuzzy_terms=0), [1.0, 0.0]).collect()) == 5


def test_filter_language():
    kinds = lambda t: [(p.kind, p.key, p.value) for p in filters.parse(t)]
    assert kinds("source:vault type:task tag:foo folder:01-projects") == [("source", "source", "vault"), ("field", "type", "task"), ("tag", "tag", "foo"), ("folder", "folder", "01-projects")]
    assert kinds(":value key: key';DROP:evil key.sub:value plain") == [] and kinds("") == [] and kinds(None) == []


def test_typed_metadata(spark):
    rows = spark.createDataFrame([(1, '{"frontmatter":{"k":"42","tags":["a"]}}'), (2, '{"frontmatter":{"k":42,"tags":"a"}}'), (3, "{}"), (4, "broken"), (5, None)], "id long, metadata string")
    found = lambda t: [r.id for r in rows.filter(filters.condition(filters.parse(t), F.col("metadata"), F.lit("x"))).collect()]
    assert found("k:42") == [1] and found("tag:a") == [1] and found("source:x k:42 tag:a") == [1] and found("source:y") == []


def test_enrichment(spark):
    assert enrich.frontmatter("---\ntype: task\nn: 3\ntags: [a, b]\n---\nbody") == '{"type": "task", "n": 3, "tags": ["a", "b"]}'
    for text in ("", "no", "---\n: [\n---", "---\n- a\n---", "---\na: 1", None):
        assert enrich.frontmatter(text) == "{}"
    row = spark.createDataFrame([("[[A|x]] [[b]] [[A]] [[ ]] [[c", "/vault/p/q/n.md")], "t string, p string").select(
        enrich.wikilinks(F.col("t")).alias("l"), enrich.folder_tags(F.col("p"), "/vault").alias("f"), enrich.folder_tags(F.col("p"), "/other").alias("o"), enrich.metadata(["wikilinks", "folder_tags", "odd"], F.col("t"), F.col("p"), "/vault").alias("m")
    ).first()
    assert row.l == ["A", "b"] and row.f == ["p", "q"] and row.o == [] and row.m == '{"wikilinks":["A","b"],"folder_tags":["p","q"]}'


def test_enrichment_by_a_function(spark):
    df = enrich.enrich_by(spark.createDataFrame([("abc", "p/q")], "t string, p string"), lambda t, p: {"n": len(t), "at": p}, "t", "p")
    assert df.first().metadata == '{"n": 3, "at": "p/q"}'


def test_resolving_links(spark):
    files = spark.createDataFrame([(1, "a.md"), (2, "d/b.md"), (3, "d/c"), (4, "e/b.md")], "file_id long, rel_path string")
    targets = spark.createDataFrame([(1, "a"), (1, "a.md"), (2, "a"), (1, "b"), (1, "d/b"), (1, "c"), (1, "none"), (3, "e/b.md")], "source_file_id long, target string")
    assert sorted((r.source_file_id, r.target_file_id) for r in links.resolve(targets, files).collect()) == [(1, 2), (1, 3), (2, 1), (3, 4)]


def test_hops(spark):
    edges = spark.createDataFrame([(1, 2, "wikilink", 1.0), (1, 3, "wikilink", 1.0), (2, 1, "wikilink", 1.0), (3, 4, "wikilink", 1.0)], "source_file_id long, target_file_id long, link_type string, confidence double")
    files = spark.createDataFrame([(i, f"{i}.md") for i in range(1, 5)], "file_id long, rel_path string")
    chunks = spark.createDataFrame([(i, 10 * i + k, f"t{i}") for i in range(1, 5) for k in (0, 1)], "file_id long, chunk_id long, title string")
    assert [(r.file_id, r.direction) for r in links.related(edges, chunks, 1, "both", 3).collect()] == [(2, "forward"), (2, "forward"), (3, "forward")]
    assert [(r.chunk_id, r.hop) for r in links.multi_hop(edges, chunks, 1, "forward", 9, 2).collect()] == [(20, 1), (30, 1), (40, 2)]
    counts = [(r.rel_path, r.hop) for r in links.link_counts(edges, files, chunks, 1, "forward", 2).collect()]
    assert counts == [("2.md", 1), ("3.md", 1), ("1.md", 2), ("4.md", 2)]  # the origin comes back at hop 2
    with pytest.raises(ValueError):
        links.edges(edges, "sideways")


def test_sync_counts(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "rel_path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "rel_path string, content_hash string")
    assert sync.counters(sync.diff(new, old)).first().asDict() == {"scanned": 3, "added": 1, "updated": 1, "removed": 1, "unchanged": 1}


def test_globs():
    import re

    hit = lambda g, p: bool(re.search(sync.glob_pattern(g), p))
    assert hit("*.rs", "a.rs") and hit("*.rs", "x/y/a.rs") and not hit("*.rs", "a.rsx")
    assert hit("docs/*.md", "docs/a.md") and not hit("docs/*.md", "docs/x/a.md") and hit("docs/**", "docs/x/a.md") and hit("**/b.md", "b.md")


def test_ledger_and_advice(spark):
    now = datetime(2024, 1, 1, 12)
    rows = [(i, label, t, now - timedelta(minutes=m), n) for i, (label, t, m, n) in enumerate([("a", 390, 0, 10), ("a", 10, 5, 1), ("b", 300, 10, 1), ("c", 100, 90, 1), ("d", 200, 300, 2)])]
    frame = spark.createDataFrame(rows, "chunk_id long, source_label string, token_estimate long, returned_at timestamp, access_count int")
    assert [(r.label, r.tokens) for r in ledger.breakdown(frame).collect()] == [("a", 400), ("b", 300), ("d", 200), ("c", 100)]
    scored = ledger.relevance(ledger.breakdown(frame), F.lit(now))
    by = {r.label: round(r.relevance, 4) for r in scored.collect()}
    assert by["a"] == 0.7 and by["b"] == round(0.2 + 0.3 / 11, 4)
    advice = {r.label: r.advice for r in ledger.keep_and_drop(scored, 2, 3).collect()}
    assert advice == {"a": "keep", "b": "keep", "c": "drop", "d": "drop"}
    assert ledger.savings(ledger.keep_and_drop(scored, 2, 3)).first().savings == 300
    assert "Keep" in ledger.recommendation(frame, F.lit(now)) and ledger.recommendation(frame.limit(0), F.lit(now)) == "No tracked sources."


def test_thresholds_fire_once_and_the_highest_wins(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, "s", t, start + timedelta(minutes=i), 1) for i, t in enumerate([390, 20, 10, 400, 10, 100])]
    frame = spark.createDataFrame(rows, "chunk_id long, source_label string, token_estimate long, returned_at timestamp, access_count int")
    found = [(r.chunk_id, r.threshold) for r in ledger.crossings(frame, Settings(budget_tokens=1000)).orderBy("chunk_id").collect()]
    assert found == [(1, 40), (3, 80), (5, 90)]


def test_alert_texts(spark):
    row = type("R", (), {"label": "a", "tokens": 5, "relevance": 0.5})
    for t in (40, 60, 70, 80, 90):
        assert f"{t}%" in ledger.alert_text(t, 10, Settings(), [row], [row], [row])


def test_events(spark):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, None, "x", 2, at), (2, "c", "x", 3, at + timedelta(hours=1)), (3, "c", "y", 1, at), (4, "d", "z", 3, at)], "event_id long, category string, data string, priority int, created_at timestamp")
    assert sorted(r.event_id for r in events.distinct_events(rows).collect()) == [1, 3, 4]
    assert [r.event_id for r in events.retained(rows, 3).collect()] == [2, 4, 1]
    text = events.snapshot_text(rows)
    assert text.startswith("## Session Resume\n\n### c\n- 2 events (latest: 2024-01-01 01:00:00)") and "### general" in text
    assert "more categories" in events.snapshot_text(rows, Settings(snapshot_bytes=80))
    assert events.snapshot_text(rows.limit(0)) == "No session events recorded."


def test_memory_keeps_old_hints(spark):
    at = datetime(2024, 1, 1)
    schema = "normalized_query string, profile string, learned_query string, learned_source_hint string, learned_filter_hint string, winning_source_label string, winning_file_path string, credited_at timestamp, run_id long"
    first = spark.createDataFrame([("q", "debug", "q one", "src", None, "win", None, at, 1)], schema)
    second = spark.createDataFrame([("q", "debug", "q two", None, "type:x", None, "f.md", at + timedelta(1), 2), ("r", "debug", "r", None, None, None, None, at, 3)], schema)
    kept = memory.upsert(memory.learned(first), second).orderBy("normalized_query").collect()
    q = kept[0]
    assert (q.learned_query, q.learned_source_hint, q.learned_filter_hint, q.winning_source_label, q.winning_file_path, q.success_count) == ("q two", "src", "type:x", "win", "f.md", 2)
    assert kept[1].success_count == 1


def test_rewriting():
    memory_row = {"learned_query": "learnt", "learned_source_hint": None, "winning_source_label": "win", "learned_filter_hint": "type:x"}
    plan = retrieval.rewrite(retrieval.Request(" find it ", profile="code_review"), memory_row)
    assert (plan.query, plan.source, plan.filter, plan.memory_applied) == ("learnt", "win", "type:x", True)
    plan = retrieval.rewrite(retrieval.Request("a stack error", profile="debug", source="s"), memory_row)
    assert plan.query == "a stack error failure root cause stack trace" and plan.source == "s"
    assert not retrieval.rewrite(retrieval.Request("x"), memory_row).memory_applied
    assert not retrieval.rewrite(retrieval.Request("x", profile="debug", use_memory=False), memory_row).memory_applied
    assert profile("planning").expand("") == ""
    with pytest.raises(ValueError):
        profile("odd")
    assert retrieval.note_on_breadth(["one two"], None) and not retrieval.note_on_breadth(["one two three"], None)


def test_policy(spark):
    rows = spark.createDataFrame(
        [("Bash", None, 'echo a > "/tmp/a b.txt" && tee -a /x/y.log; cat z', "Created: /n/c.md\nsee (/vault/tasks/t.md), /tmp/u.md"), ("Bash", None, "mv a /d/e", None), ("Write", "/w.md", None, None), ("Read", "/r.md", None, None), ("Bash", None, "guarantee /x > rel.txt", "")],
        "tool string, file string, command string, output string",
    )
    got = [r.p for r in rows.select(policy.written_paths(*[F.col(c) for c in rows.columns]).alias("p")).collect()]
    assert got == [["/tmp/a b.txt", "/x/y.log", "/n/c.md", "/vault/tasks/t.md", "/tasks/t.md"], ["/d/e"], ["/w.md"], [], []]
    calls = spark.createDataFrame([("Bash", "git log"), ("Bash", "git status; cat x"), ("WebFetch", None), ("Read", None), ("Bash", "ls")], "tool string, command string")
    assert [r.d for r in calls.select(policy.decision(F.col("tool"), F.col("command")).alias("d")).collect()] == ["block", "approve", "block", "approve", "approve"]
    assert len(calls.select(policy.message(F.lit("x" * 99)).alias("m")).first().m) == 80


def test_missing_embeddings(spark):
    chunks, have = spark.range(5).withColumnRenamed("id", "chunk_id"), spark.range(3).withColumnRenamed("id", "chunk_id")
    assert [r.chunk_id for r in indexing.missing_embeddings(chunks, have).orderBy("chunk_id").collect()] == [3, 4]
