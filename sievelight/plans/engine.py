"""The engine: a session's content index, the knowledge store and telemetry over versioned tables."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import Settings
from ..functions import embedding as E
from ..operators import enrich, events, indexing, ledger, links, memory, policy, search, sync
from ..operators.indexing import Index
from ..sources import files
from ..sources.tables import Table, write_report
from . import retrieval


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Engine:
    """Index texts, files, folders and pages; search them together with the knowledge store; keep account of what was shown."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), embedder: E.Embedder | None = None):
        self.spark, self.settings, self.embedder = spark, settings, embedder
        chunk_schema = schema.CHUNKS + ", is_code boolean, embedding array<float>, dl int"
        self.source_table = Table(spark, root, "sources", schema.SOURCES)
        self.chunk_table = Table(spark, root, "chunks", chunk_schema)
        self.postings = Postings(spark, root, "postings", settings)
        self.event_table = Table(spark, root, "events", schema.EVENTS)
        self.ledger_table = Table(spark, root, "ledger", schema.LEDGER)
        self.run_table = Table(spark, root, "runs", schema.RUNS)
        self.hit_table = Table(spark, root, "hits", schema.RUN_HITS)
        self.memory_table = Table(spark, root, "memory", schema.MEMORY)
        self.fired, self.visibility_told = 0, False
        self.knowledge = Knowledge(spark, root, settings, embedder)

    # Indexing

    def index_documents(self, docs: DataFrame, content_type: str | None = None) -> DataFrame:
        """Index rows (label, text); a label that is indexed twice is two sources.  The new sources."""
        rows = docs.select(F.expr("uuid()").alias("_u"), "label", "text").withColumn("source_id", F.xxhash64("_u"))
        pieces = indexing.chunk_documents(rows, "source_id", F.col("label"), "text", content_type).drop("chunk_key")
        pieces = E.embed(pieces, F.col("content"), self.embedder) if self.embedder else pieces.withColumn("embedding", F.lit(None).cast("array<float>"))
        # The ids are random, so the chunks are written before anything is derived from them.
        new = self.chunk_table.append(pieces.withColumn("dl", F.size(Index(pieces).words())))
        self.postings.add(Index(new, stem=self.postings.stem))
        made = indexing.sources(new, F.lit(_now())).withColumnRenamed("source_id", "id").select("id", "label", "indexed_at", "chunk_count", "code_chunk_count")
        return self.source_table.append(made.withColumnRenamed("id", "source_id")).withColumnRenamed("source_id", "id")

    def index_text(self, label: str, text: str, content_type: str | None = None) -> DataFrame:
        return self.index_documents(files.read_text(self.spark, label, text), content_type)

    def index_batch(self, outputs: DataFrame) -> DataFrame:
        """Captured outputs (label, text), cut to their size first."""
        from ..functions import text as T

        s = self.settings
        return self.index_documents(outputs.withColumn("text", T.head_and_tail(F.col("text"), s.max_output_bytes, s.head_ratio)))

    def index_file(self, path: str, query: str | None = None) -> DataFrame:
        """Index a file under its name; its text if it is short, else its best chunks for the query, else a preview."""
        from ..functions import text as T

        docs = files.read_file(self.spark, path)
        self.index_documents(docs)
        long = docs.select((F.octet_length("text") > self.settings.preview_threshold).alias("x")).first().x
        if query and long:
            return self.search(query, source=path.rsplit("/", 1)[-1], limit=5, include_knowledge=False)
        return docs.select("label", T.adaptive(F.col("text"), self.settings.preview_threshold, self.settings.preview_bytes).alias("text"))

    def index_dir(self, path: str = ".", glob: str | None = None, label_prefix: str = "", ignore: list[str] | None = None) -> DataFrame:
        """Index a folder's texts; the new sources."""
        rows = files.read_folder(self.spark, path, glob, False, ignore)
        return self.index_documents(rows.select(F.concat(F.lit(label_prefix), "rel_path").alias("label"), "text"))

    def index_dir_report(self, path: str = ".", glob: str | None = None, label_prefix: str = "", ignore: list[str] | None = None) -> dict[str, int]:
        """index_dir, and its counts: files indexed and skipped, chunks, bytes, and the average size of a file (0 without files)."""
        seen = files.listed(self.spark, path, glob, False, ignore).count()
        made = self.index_dir(path, glob, label_prefix, ignore)
        sizes = files.read_folder(self.spark, path, glob, False, ignore).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).first()
        chunks = made.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("n")).first().n
        return {"indexed": sizes.n, "skipped": seen - sizes.n, "chunks": chunks, "bytes": sizes.bytes, "average_bytes": sizes.bytes // sizes.n if sizes.n else 0}

    def index_pages(self, pages: DataFrame, url_col: str = "url", body_col: str = "html", type_col: str | None = None) -> DataFrame:
        return self.index_documents(files.fetched_pages(pages, url_col, body_col, type_col), "prose")

    def embed_backfill(self) -> int:
        """Embed chunks that have no embedding; how many there were."""
        rows = self.chunk_table.read()
        missing = rows.filter("embedding IS NULL")
        n = missing.count()
        if n and self.embedder:
            self.chunk_table.overwrite(rows.filter("embedding IS NOT NULL").unionByName(E.embed(missing.drop("embedding"), F.col("content"), self.embedder)))
        return n

    # Search

    def index(self) -> Index:
        return Index(self.chunk_table.read(), stem=self.settings.stem, lookup=self.postings.lookup(self.settings))

    def _vector(self, query: str) -> list[float] | None:
        return self.embedder.batch([query])[0].tolist() if self.embedder else None

    def _memory(self, request: retrieval.Request) -> dict | None:
        from ..config import profile

        p = profile(request.profile)
        if not p.explicit:
            return None
        key = " ".join(request.query.lower().split())
        found = memory.lookup(self.memory_table.read(), key, p.name).first()
        return found.asDict() if found else None

    def run(self, request: retrieval.Request, count_only: bool = False) -> tuple[retrieval.Plan, DataFrame]:
        request.query_vector = request.query_vector or self._vector(request.query)
        plan, results = retrieval.run(request, self.index(), self.knowledge.index(), self.knowledge.link_table.read(), self._memory(request), self.settings)
        if count_only:  # is not recorded
            return plan, search.result_size(results, self.settings.inline_tokens)
        # At most the limit's rows: what made them runs once, for the accounts and for the caller.
        results = search.held(results)
        self._record(request, plan, results)
        return plan, results

    def search(self, query: str, **options) -> DataFrame:
        return self.run(retrieval.Request(query, **options))[1]

    def count_only(self, query: str, **options) -> DataFrame:
        return self.run(retrieval.Request(query, **options), True)[1]

    def search_many(self, queries: list[str], **options) -> DataFrame:
        out = None
        for q in queries:
            rows = self.search(q, **options).withColumn("query", F.lit(q))
            out = rows if out is None else out.unionByName(rows)
        return out

    def report(self, query: str, **options) -> str:
        request = retrieval.Request(query, **options)
        plan, results = self.run(request)
        return retrieval.report(request, plan, results, self.settings)

    def _record(self, request: retrieval.Request, plan: retrieval.Plan, results: DataFrame) -> None:
        run_id, at = uuid.uuid4().int >> 65, _now()
        row = (run_id, " ".join(request.query.lower().split()), plan.profile.name, plan.query, plan.source, plan.filter, plan.memory_applied, at)
        self.run_table.append(self.spark.createDataFrame([row], schema.RUNS))
        self.hit_table.append(results.select(F.lit(run_id).cast("long").alias("run_id"), "source_type", F.col("label").alias("source_label"), "file_path", "title"))
        size = F.octet_length("content").cast("long")
        for table in (self.run_table, self.hit_table, self.ledger_table):
            table.compact()
        self.ledger_table.append(results.groupBy("label").agg(F.sum(size).alias("n")).select(F.lit(None).cast("long").alias("chunk_id"), F.col("label").alias("source_label"), ledger.tokens_of(F.col("n")).alias("token_estimate"), F.lit(at).alias("returned_at"), F.lit(1).alias("access_count")))

    def read_chunks(self, label: str, query: str | None = None, max_chunks: int = 10) -> DataFrame:
        """A source's chunks in order, or its best for a query; the latest run that showed the source is credited."""
        self._credit("source_label", label, None)
        if query:
            return self.search(query, source=label, limit=max_chunks, include_knowledge=False)
        return indexing.chunks_of(self.chunk_table.read(), label, max_chunks)

    def _credit(self, by: str, value: str, path: str | None) -> None:
        latest = memory.latest_run(self.run_table.read(), self.hit_table.read(), by).filter(F.col(by) == value)
        label = F.lit(value if by == "source_label" else None).cast("string")
        credit = memory.credit(latest, label, F.lit(path).cast("string"), F.lit(_now()))
        self.memory_table.overwrite(memory.upsert(self.memory_table.read(), credit))

    def links(self, file: str | None = None, query: str | None = None, **options) -> DataFrame:
        """Knowledge.links, with credit to the latest run that showed the file."""
        file = file or self.knowledge.top_file(query, options.get("source"))
        self._credit("file_path", file, file)
        return self.knowledge.links(file, **options)

    def auto_sync(self) -> list[str]:
        """Bring stale knowledge sources up to date; which they were."""
        labels = [r.label for r in self.knowledge.status().filter("is_stale").collect()]
        for label in labels:
            self.knowledge.sync(label)
        return labels

    def note(self, query: str, path: str, top: int = 3) -> None:
        """The best results of a query as a text report."""
        rows = self.search(query, limit=5).filter(F.col("rank") <= top).orderBy("rank")
        write_report(rows.select(F.concat_ws("\n", F.concat(F.lit("## "), "title"), "content", F.lit("")).alias("value")), path)

    # Accounts

    def alert(self) -> str | None:
        """What to say if the ledger newly reaches a threshold, the highest one; else, once, if too little was seen."""
        used = ledger.totals(self.ledger_table.read()).first().total_tokens
        reached = max((t for t in self.settings.thresholds if used * 100 // self.settings.budget_tokens >= t), default=0)
        if reached > self.fired:
            self.fired = reached
            sources = ledger.breakdown(self.ledger_table.read())
            advice = ledger.keep_and_drop(ledger.relevance(sources, F.lit(_now()), self.settings)).collect()
            listed = sources.limit(3).collect() if reached != 40 else sources.select("label").collect()
            return ledger.alert_text(reached, used, self.settings, listed, [r for r in advice if r.advice == "keep"], [r for r in advice if r.advice == "drop"])
        seen = self.stats().first()
        if seen.too_little_seen and not self.visibility_told:
            self.visibility_told = True
            return f"[visibility: {seen.visibility_ratio:.1%} of what is indexed was seen. Search, or read the chunks of a source.]"
        return None

    def reset(self) -> None:
        """An empty ledger, and alerts that can fire again."""
        self.ledger_table.overwrite(self.spark.createDataFrame([], schema.LEDGER))
        self.fired, self.visibility_told = 0, False

    def sources(self) -> DataFrame:
        return self.source_table.read().orderBy(F.col("indexed_at").desc(), "label")

    def stats(self) -> DataFrame:
        indexed = self.chunk_table.read().select(F.octet_length("content").alias("bytes"))
        shown = self.ledger_table.read().select((F.col("token_estimate") * 4).alias("bytes"))
        return ledger.visibility(indexed, shown)

    def stats_report(self) -> str:
        """What was indexed and shown, and the budget, as text."""
        seen, used = self.stats().first(), ledger.totals(self.ledger_table.read()).first()
        top = ledger.breakdown(self.ledger_table.read()).limit(5).collect()
        lines = [
            "## Stats", "", f"- Searches: {self.run_table.read().count()}", f"- Sources: {self.source_table.read().count()}", f"- Bytes indexed: {seen.bytes_indexed}", f"- Bytes shown: {seen.bytes_returned}",
            f"- Visibility: {seen.visibility_ratio:.1%}", f"- Tokens saved: {seen.tokens_saved}", f"- Tokens used: {used.total_tokens}/{self.settings.budget_tokens} ({used.total_tokens / self.settings.budget_tokens:.1%})", f"- Sources tracked: {used.source_count}",
        ]
        return "\n".join([*lines, *(["- Top consumers: " + ", ".join(f"{r.label} ({r.tokens}t)" for r in top)] if top else [])])

    def status_report(self) -> str:
        """The tracked sources by relevance, as text."""
        rows = self.context_status().orderBy(F.round("relevance", 9).desc(), "label").limit(20).collect()
        return "\n".join(["## Context", "", *[f"- {r.label}: {r.tokens}t, {r.access_count} accesses, relevance {r.relevance:.2f} ({r.level})" for r in rows]] if rows else ["No tracked sources."])

    def context_status(self) -> DataFrame:
        return ledger.relevance(ledger.breakdown(self.ledger_table.read()), F.lit(_now()), self.settings)

    def compaction_advice(self) -> str:
        return events.snapshot_text(self.event_table.read(), self.settings) + "\n" + ledger.recommendation(self.ledger_table.read(), F.lit(_now()), self.settings)

    def record_call(self, label: str, text: str) -> None:
        """Account for what a call has shown, under the call's own label."""
        rows = self.spark.createDataFrame([(label, text)], "source_label string, text string")
        self.ledger_table.append(rows.select(F.lit(None).cast("long").alias("chunk_id"), "source_label", ledger.tokens_of(F.octet_length("text")).alias("token_estimate"), F.lit(_now()).alias("returned_at"), F.lit(1).alias("access_count")))

    def record_events(self, rows: DataFrame) -> None:
        """New events (event_id, event_type, category, data, tool, created_at): without repeats, and only the retained ones."""
        made = rows.select("event_id", "event_type", "category", "data", events.priority(F.col("tool")).alias("priority"), "created_at")
        both = self.event_table.read().drop("data_hash").unionByName(made)
        self.event_table.overwrite(events.retained(events.distinct_events(both), self.settings.retained_events).select(*[f.split()[0] for f in schema.EVENTS.split(", ")]))

    @staticmethod
    def decide(calls: DataFrame) -> DataFrame:
        """Calls (tool, command) with the decision."""
        return calls.withColumn("decision", policy.decision(F.col("tool"), F.col("command")))


class Postings:
    """Postings of a growing corpus, by buckets of terms, so that a query reads its own terms' buckets alone."""

    BUCKETS = 32

    def __init__(self, spark: SparkSession, root: str, name: str, settings: Settings):
        self.stem = settings.stem
        self.table = Table(spark, root, name, schema.POSTINGS, by="term_bucket", sort="term")

    def add(self, new: Index) -> None:
        rows = new.build_postings()
        self.table.append(rows.withColumn("term_bucket", indexing.term_bucket(F.col("term"), self.BUCKETS)))
        self.table.compact()

    def lookup(self, settings: Settings, live: DataFrame | None = None) -> Callable[[list[str]], DataFrame] | None:
        """Postings of terms, of the chunks in `live` alone; none if the settings ask for words that were stemmed otherwise."""
        if settings.stem != self.stem:
            return None

        def found(terms: list[str]) -> DataFrame:
            rows = self.table.read({zlib.crc32(t.encode()) % self.BUCKETS for t in terms}).filter(F.col("term").isin(*terms)).select("term", "chunk_id", "tf", "dl")
            # A text that comes back after a change has its postings twice.
            return rows if live is None else rows.dropDuplicates(["term", "chunk_id"]).join(live.select("chunk_id"), "chunk_id", "left_semi")

        return found


class Knowledge:
    """Folders that are kept in step: their files, chunks, metadata and links.

    Files and chunks lie in shelves, FILE_SHELVES for each source, by a hash of the file: a sync rewrites the shelves of changed files alone.
    Postings of chunks that are gone stay in their table; a lookup keeps those of live chunks.
    """

    FILE_SHELVES = 64

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), embedder: E.Embedder | None = None):
        self.spark, self.settings, self.embedder = spark, settings, embedder
        self.source_table = Table(spark, root, "k_sources", schema.K_SOURCES)
        self.file_table = Table(spark, root, "k_files", schema.K_FILES + ", shelf string", by="shelf")
        self.chunk_table = Table(spark, root, "k_chunks", schema.K_CHUNKS + ", embedding array<float>, dl int, label string, rel_path string, shelf string", by="shelf")
        self.link_table = Table(spark, root, "k_links", schema.LINKS + ", shelf string", by="shelf")
        self.postings = Postings(spark, root, "k_postings", settings)

    def _shelves(self, source_id: int, table: Table | None = None) -> list[str]:
        """The shelves that a source has in a table."""
        return sorted({k for k, _ in (table or self.file_table).parts() if k.split("_")[0] == str(source_id)})

    def _shelf(self, source_id: int, file_id: Column) -> Column:
        return F.concat(F.lit(f"{source_id}_"), F.pmod(file_id, F.lit(self.FILE_SHELVES)).cast("string"))

    def _source(self, label: str):
        found = self.source_table.read().filter(F.col("label") == label).first()
        if found is None:
            raise ValueError(f"no knowledge source {label!r}")
        return found

    def add(self, path: str, label: str, glob: str | None = None, enrichments: list[str] | None = None) -> dict[str, int]:
        """Register a folder and bring it in; a label can be used once."""
        if not self.source_table.read().filter(F.col("label") == label).isEmpty():
            raise ValueError(f"there is a knowledge source {label!r}")
        if not files.is_folder(self.spark, path):
            raise ValueError(f"{path!r} is not a folder")
        rows = self.spark.createDataFrame([(label, path, glob, enrichments or [], _now())], "label string, path string, glob string, enrichments array<string>, created_at timestamp")
        self.source_table.append(rows.select(F.xxhash64("label").alias("source_id"), "*", F.lit(None).cast("timestamp").alias("last_sync"), F.lit(0).cast("long").alias("file_count"), F.lit(0).cast("long").alias("chunk_count")))
        return self.sync(label)

    def sync(self, label: str | None = None) -> dict[str, int]:
        """Bring one source, or all, up to date: only files whose content changed are chunked again."""
        if label is None:
            total: dict[str, int] = {}
            for r in self.source_table.read().orderBy("label").collect():
                for k, v in self.sync(r.label).items():
                    total[k] = total.get(k, 0) + v
            return total
        source = self._source(label)
        return self._merge(source, files.read_folder(self.spark, source.path, source.glob, True))

    def reindex(self, label: str, rel_path: str) -> dict[str, int]:
        """One file, read by itself; links stay as they are."""
        source = self._source(label)
        return self._merge(source, files.read_one(self.spark, source.path, rel_path), only=rel_path)

    def _merge(self, source, present: DataFrame, only: str | None = None) -> dict[str, int]:
        """Bring shelves with changed files up to date: what changed, and the source's chunks and links then."""
        sid = source.source_id
        own = self.file_table.read(self._shelves(sid))
        mine = own.filter(F.col("rel_path") == only) if only else own
        identity = F.xxhash64(F.lit(sid), "rel_path")
        # Each file is read and hashed once for this; only changed ones are read again.
        changes = sync.diff(present.select("rel_path", "content_hash"), mine).withColumn("file_id", identity).withColumn("shelf", self._shelf(sid, F.col("file_id"))).persist()
        counts = sync.counters(changes).first().asDict()
        touched = changes.filter("status <> 'unchanged'")
        shelves = [r.shelf for r in touched.select("shelf").distinct().collect()]
        if shelves:
            fresh = present.join(changes.filter("status IN ('added', 'updated')").select("rel_path", "file_id", "shelf"), "rel_path")
            rows = enrich.enrich(fresh, source.enrichments, "text", "rel_path")
            pieces = indexing.chunk_documents(rows.select("file_id", "rel_path", "text"), "file_id", F.col("rel_path")).select(F.col("source_id").alias("file_id"), "chunk_key", "title", "content", "line_start", "line_end")
            pieces = pieces.join(rows.select("file_id", "metadata", "rel_path", "shelf", "content_hash"), "file_id")
            # The content's hash is part of the id, so that postings of an older text never meet a newer one.
            pieces = pieces.withColumn("chunk_id", F.xxhash64("content_hash", "chunk_key")).withColumns({"source_id": F.lit(sid), "label": F.lit(source.label)})
            pieces = pieces.withColumn("dl", F.size(Index(pieces, knowledge=True).words()))
            pieces = E.embed(pieces, F.col("content"), self.embedder) if self.embedder else pieces.withColumn("embedding", F.lit(None).cast("array<float>"))
            gone = touched.select("file_id")
            kept = self.chunk_table.read(shelves)
            order = kept.columns
            self.chunk_table.replace(kept.join(gone, "file_id", "left_anti").select(order).unionByName(pieces.select(order)), shelves)
            now = self.chunk_table.read(shelves)
            self.postings.add(Index(now.join(gone, "file_id", "left_semi"), knowledge=True, stem=self.postings.stem))
            sizes = now.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
            made = rows.select("file_id", F.lit(sid).alias("source_id"), "rel_path", "content_hash", "size_bytes", F.lit(_now()).alias("indexed_at"), "shelf").join(sizes, "file_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
            stored = self.file_table.read(shelves)
            self.file_table.replace(stored.join(gone, "file_id", "left_anti").unionByName(made.select(stored.columns)), shelves)
        changes.unpersist()
        own = self.file_table.read(self._shelves(sid))
        if not only and shelves:
            self._relink(sid, own)
        total = own.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunks")).first()
        this = F.col("source_id") == sid
        update = {"file_count": F.lit(total.files), "chunk_count": F.lit(total.chunks), "last_sync": F.lit(_now())}
        self.source_table.overwrite(self.source_table.read().withColumns({c: F.when(this, x).otherwise(F.col(c)) for c, x in update.items()}))
        return counts | {"chunks": total.chunks, "links": self.edges(source.label)}

    def _relink(self, source_id: int, own: DataFrame) -> None:
        """Links of a source, made anew from its metadata; they lead to files of the same source."""
        meta = self.chunk_table.read(self._shelves(source_id, self.chunk_table)).groupBy("file_id").agg(F.first("metadata").alias("metadata"))
        targets = meta.select(F.col("file_id").alias("source_file_id"), F.explode(F.from_json(F.get_json_object("metadata", "$.wikilinks"), "array<string>")).alias("target"))
        self.link_table.replace(links.resolve(targets, own).withColumn("shelf", F.lit(str(source_id))), [source_id])

    def edges(self, label: str) -> int:
        """How many links a source has."""
        return self.link_table.read([self._source(label).source_id]).count()

    def index(self) -> Index:
        rows = self.chunk_table.read()
        return Index(rows.withColumn("content_type", F.lit("prose")), knowledge=True, stem=self.settings.stem, lookup=self.postings.lookup(self.settings, rows))

    def search(self, query: str, filter: str | None = None, source: str | None = None, limit: int = 10) -> DataFrame:
        from ..operators import filters

        wanted = filters.parse(filter) + ([filters.Predicate("source", "source", source)] if source else [])
        where = filters.condition(wanted, F.coalesce("metadata", F.lit("{}")), F.col("label"))
        vector = self.embedder.batch([query])[0].tolist() if self.embedder else None
        return search.hybrid(self.index(), query, self.settings, vector, where, limit=limit)

    def listing(self, query: str, **options) -> DataFrame:
        """A search as lines: title, place, score, and a short preview."""
        from ..functions import text as T

        rows = self.search(query, **options)
        line = F.format_string("**[%s]** (%s: %s, score: %.3f)", "title", "label", "rel_path", "score")
        return rows.select(F.concat_ws("\n", line, T.preview(F.col("content"), 200)).alias("line"))

    def status(self) -> DataFrame:
        return sync.stale(self.source_table.read(), F.lit(_now()), self.settings.stale_minutes).orderBy("label")

    def remove(self, label: str) -> dict[str, int]:
        """Forget a source: its shelves go, all others stay unread."""
        source = self._source(label)
        own, chunks = self._shelves(source.source_id), self._shelves(source.source_id, self.chunk_table)
        counts = {"files_removed": self.file_table.read(own).count(), "chunks_removed": self.chunk_table.read(chunks).count()}
        self.link_table.drop([source.source_id])
        self.chunk_table.drop(chunks)
        self.file_table.drop(own)
        self.source_table.overwrite(self.source_table.read().filter(F.col("source_id") != source.source_id))
        return counts

    def top_file(self, query: str | None, source: str | None = None) -> str:
        """The file of a query's best chunk."""
        if not query:
            raise ValueError("a file or a query is needed")
        best = self.search(query, source=source, limit=1).first()
        if best is None:
            raise ValueError(f"nothing is found for {query!r}")
        return best.rel_path

    def _file(self, file: str, source: str | None) -> int:
        rows = self.file_table.read(self._shelves(self._source(source).source_id) if source else None)
        found = rows.filter(F.col("rel_path") == file).orderBy("file_id").first()
        if found is None:
            raise ValueError(f"no knowledge file {file!r}")
        return found.file_id

    def links(self, file: str | None = None, direction: str = "both", limit: int = 20, depth: int = 1, filter: str | None = None, count_only: bool = False, query: str | None = None, source: str | None = None) -> DataFrame:
        """Chunks, or counts, of files linked with a file (its path, or that of a query's best chunk), within 1 to 3 hops."""
        from ..operators import filters

        file_id = self._file(file or self.top_file(query, source), source)
        edges, chunks = self.link_table.read(), self.index().chunks
        if count_only:
            return links.link_counts(edges, self.file_table.read(), chunks, file_id, direction, depth, self.settings.frontier)
        where = filters.condition(filters.parse(filter), F.coalesce("metadata", F.lit("{}")), F.col("label"))
        if depth == 1:
            return links.related(edges, chunks, file_id, direction, limit, where)
        return links.multi_hop(edges, chunks, file_id, direction, limit, depth, where, self.settings.frontier)

    def related(self, chunk_id: int, direction: str = "both", limit: int = 20) -> DataFrame:
        """Chunks of files linked with a chunk's file."""
        found = self.chunk_table.read().filter(F.col("chunk_id") == chunk_id).first()
        if found is None:
            raise ValueError(f"no knowledge chunk {chunk_id}")
        return links.related(self.link_table.read(), self.index().chunks, found.file_id, direction, limit)

    def linked_files(self, file: str, direction: str = "both") -> DataFrame:
        """The distinct files that a file is linked with (file_id)."""
        return links.edges(self.link_table.read(), direction).filter(F.col("file_id") == self._file(file, None)).select(F.col("neighbour_id").alias("file_id")).distinct()
