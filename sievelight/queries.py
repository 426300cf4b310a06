"""One query for each operator over the driver tables, each with the SQL that says the same."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .config import PROFILES, Settings
from .functions import text as T
from .functions.embedding import ByteSumEmbedder, embed
from .operators import chunking, enrich, events, filters, indexing, ledger, links, memory, policy, search, sync
from .operators.indexing import Index
from .plans import retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The searches that the queries run.
TWO_WORDS = "thing heat"
ONE_WORD = "reed"
PHRASE = "of the"
SETTINGS = Settings(limit=15)
AS_OF = "2024-01-31 00:00:00"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a local one will do only where there is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sievelight-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = "file://" + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> Index:
    return Index(indexing.whole_documents(table(spark, sf_dir, "documents")))


def scored(df: DataFrame, *more: str) -> DataFrame:
    return df.select("chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), *more)


# --- SQL building blocks -------------------------------------------------------------------------------------------

TOKENS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
CORPUS = """chunks AS (
  SELECT CAST(doc_id AS BIGINT) AS chunk_id, CAST(doc_id AS BIGINT) AS source_id, source AS label, 'document ' || CAST(doc_id AS VARCHAR) AS title,
         text AS content, 'prose' AS content_type FROM documents
), words AS (
  SELECT *, {words} AS w, len({words}) AS dl FROM chunks
)""".format(words=TOKENS.format("title || ' ' || content || ' ' || content_type"))


def idf_sql(n: str, df: str) -> str:
    return f"CASE WHEN ln(({n} - {df} + 0.5) / ({df} + 0.5)) > 0 THEN ln(({n} - {df} + 0.5) / ({df} + 0.5)) ELSE 0.000001 END"


def gain_sql(tf: str, dl: str, avgdl: str) -> str:
    return f"({tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {dl} / {avgdl})))"


def bm25_sql(name: str, text: str, limit: int = 15, where: str = "TRUE") -> str:
    """CTEs name_tf, name_st, name_sc and name(chunk_id, score, rank) over `words`."""
    terms = list(dict.fromkeys(T.query_tokens(text)))
    times = [T.query_tokens(text).count(t) for t in terms]
    tfs = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"{k} * ({idf_sql('n', f'df{i}')}) * {gain_sql(f'tf{i}', 'dl', 'avgdl')}" for i, k in enumerate(times))
    every = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""{name}_tf AS (SELECT *, {tfs} FROM words),
{name}_st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM {name}_tf),
{name}_sc AS (SELECT chunk_id, {score} AS score FROM {name}_tf, {name}_st WHERE {every} AND {where}),
{name} AS (SELECT chunk_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM {name}_sc QUALIFY rank < {limit})"""


def phrase_sql(name: str, phrase: str, limit: int = 15) -> str:
    phrase = phrase.lower()
    cols = ("title", "content", "content_type")
    tf = " + ".join(f"(length(lower({c})) - length(replace(lower({c}), '{phrase}', ''))) // {len(phrase)}" for c in cols)
    dl = " + ".join(f"greatest(length({c}) - 2, 0)" for c in cols)
    return f"""{name}_tf AS (SELECT *, {tf} AS tf, {dl} AS dlc FROM chunks),
{name}_st AS (SELECT count(*) AS n, avg(dlc) AS avgdl, count(*) FILTER (WHERE tf > 0) AS df FROM {name}_tf),
{name} AS (SELECT chunk_id, ({idf_sql('n', 'df')}) * {gain_sql('tf', 'dlc', 'avgdl')} AS score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank
  FROM {name}_tf, {name}_st WHERE tf > 0 QUALIFY rank < {limit})"""


TOP = "SELECT chunk_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM {0}"


# --- search layers ---------------------------------------------------------------------------------------------------


@query(f"WITH {CORPUS}, {bm25_sql('b', TWO_WORDS)} {TOP.format('b')}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(search.bm25(corpus(spark, sf_dir), TWO_WORDS, 15))


@query(f"WITH {CORPUS}, {bm25_sql('b', ONE_WORD)} {TOP.format('b')}")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(search.bm25(corpus(spark, sf_dir).with_postings(), ONE_WORD, 15))


@query(f"WITH {CORPUS}, {bm25_sql('b', ONE_WORD, 15, 'content_type = ' + chr(39) + 'prose' + chr(39))} {TOP.format('b')}")
def bm25_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(search.bm25(corpus(spark, sf_dir), ONE_WORD, 15, filters.session(content_type="prose")))


@query(f"WITH {CORPUS}, {bm25_sql('b', ONE_WORD, 15, 'label ILIKE ' + chr(39) + '%SRC1%' + chr(39))} {TOP.format('b')}")
def bm25_label_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(search.bm25(corpus(spark, sf_dir), ONE_WORD, 15, filters.session(label="SRC1")))


@query(f"WITH {CORPUS}, {bm25_sql('b', ONE_WORD, 15, 'source_id = 7')} {TOP.format('b')}")
def bm25_source_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(search.bm25(corpus(spark, sf_dir), ONE_WORD, 15, filters.session(source_id=7)))


@query(f"WITH {CORPUS}, t AS (SELECT unnest(w) AS term, chunk_id FROM words), c AS (SELECT term, chunk_id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM c GROUP BY term")
def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).build_postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


@query(f"WITH {CORPUS} SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM words")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).corpus_stats().select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {CORPUS}, {bm25_sql('b', TWO_WORDS)} {TOP.format('b')}")
def saved_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save the index, load it again, and search its postings."""
    path = shared_folder(spark, "index")
    corpus(spark, sf_dir).save(path, 32)
    return scored(search.bm25(Index.load(spark, path), TWO_WORDS, 15))


@query(f"WITH {CORPUS}, {phrase_sql('p', PHRASE)} {TOP.format('p')}")
def trigram_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(search.substring(corpus(spark, sf_dir), PHRASE, 15))


FUZZY = "thinng heatt zzzzzzzz"
FUZZY_SQL = f"""{CORPUS}, vocab AS (SELECT DISTINCT unnest({TOKENS.format('content')}) AS term FROM chunks), few AS (SELECT term FROM vocab ORDER BY term LIMIT FEWEST),
q AS (SELECT unnest(range(1, 4)) - 1 AS pos, unnest(['thinng', 'heatt', 'zzzzzzzz']) AS word),
near AS (SELECT pos, word, term, levenshtein(word, term) AS d FROM q JOIN few ON levenshtein(word, term) <= 2),
best AS (SELECT pos, arg_min(term, (d, term)) AS term FROM near GROUP BY pos)"""


@query(f"WITH {FUZZY_SQL.replace("FEWEST", "100000")} SELECT CAST(q.pos AS INTEGER) AS pos, q.word, coalesce(best.term, q.word) AS corrected FROM q LEFT JOIN best USING (pos)")
def fuzzy_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.corrections(corpus(spark, sf_dir), FUZZY, Settings(fuzzy_terms=None))


@query(f"WITH {FUZZY_SQL.replace("FEWEST", "500")} SELECT term FROM few")
def fuzzy_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vocabulary(corpus(spark, sf_dir), 500)


def vectors(spark: SparkSession, sf_dir: str) -> tuple[Index, list[float]]:
    rows = table(spark, sf_dir, "embeddings")
    probe = rows.filter("vec_id = 0").select("embedding").first()[0]
    return Index(rows.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")), list(probe)


VECTOR = "SELECT v.vec_id AS chunk_id, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings v, embeddings q WHERE q.vec_id = 0"
VECTOR_TOP = "SELECT chunk_id, round(s, 5) AS score, row_number() OVER (ORDER BY round(s, 6) DESC, chunk_id) - 1 AS rank FROM d QUALIFY rank < 15"


@query(f"WITH d AS ({VECTOR}) {VECTOR_TOP}")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, probe = vectors(spark, sf_dir)
    return search.vector(index, probe, 15).select("chunk_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH d AS ({VECTOR} AND v.label = 1) {VECTOR_TOP}")
def vector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, probe = vectors(spark, sf_dir)
    among = index.chunks.filter("label = 1")
    return search.vector(index, probe, 15, candidates=among).select("chunk_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def rrf_sql(layers: list[tuple[str, float]]) -> str:
    union = " UNION ALL ".join(f"SELECT chunk_id, {w} / (60 + rank + 1) AS part, {i} AS place FROM {n}" for i, (n, w) in enumerate(layers))
    return f"SELECT chunk_id, round(sum(part), 8) AS score FROM ({union}) GROUP BY chunk_id"


@query(f"WITH {CORPUS}, {bm25_sql('b', TWO_WORDS)}, {phrase_sql('p', 'heat')} {rrf_sql([('b', 1.0), ('p', 1.0)])}")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus(spark, sf_dir)
    fused = search.fuse(index, {"bm25": (search.bm25(index, TWO_WORDS, 15), 1.0), "trigram": (search.substring(index, "heat", 15), 1.0)})
    return fused.select("chunk_id", F.round("score", 8).alias("score"))


@query(f"WITH {CORPUS}, {bm25_sql('b', TWO_WORDS)}, {phrase_sql('p', 'heat')} {rrf_sql([('b', 1.35), ('p', 0.9)])}")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus(spark, sf_dir)
    fused = search.fuse(index, {"bm25": (search.bm25(index, TWO_WORDS, 15), 1.35), "trigram": (search.substring(index, "heat", 15), 0.9)})
    return fused.select("chunk_id", F.round("score", 8).alias("score"))


@query(f"WITH {CORPUS}, {bm25_sql('b', 'oranti')}, {phrase_sql('p', 'oranti')}, g AS (SELECT * FROM p WHERE (SELECT count(*) FROM b) < 15) {rrf_sql([('b', 1.0), ('g', 1.0)])}")
def rrf_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus(spark, sf_dir)
    first = search.bm25(index, "oranti", 15)
    fused = search.fuse(index, {"bm25": (first, 1.0), "trigram": (search.gate(search.substring(index, "oranti", 15), first, 15), 1.0)})
    return fused.select("chunk_id", F.round("score", 8).alias("score"))


def place_sql(word: str) -> str:
    return f"CASE WHEN strpos(lower(content), '{word}') > 0 THEN strlen(substr(lower(content), 1, strpos(lower(content), '{word}') - 1)) END"


BOOST = f"""CASE WHEN a IS NULL OR h IS NULL THEN 1.0 WHEN greatest(a, h) - least(a, h) < 200 THEN 1.5 WHEN greatest(a, h) - least(a, h) < 500 THEN 1.2 ELSE 1.0 END"""
PLACES = f"SELECT *, {place_sql('thing')} AS a, {place_sql('heat')} AS h FROM chunks"


@query(f"WITH {CORPUS}, p AS ({PLACES}) SELECT chunk_id, CAST({BOOST} AS DOUBLE) AS boost FROM p")
def proximity_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).chunks.select("chunk_id", search.proximity(F.col("content"), TWO_WORDS).cast("double").alias("boost"))


# "thing heat" is found in 15 or more documents, or the gates let the substring layer in; words are exact, so nothing is corrected
# among the first 500 terms that stand in alphabetical order unless one is near.
HYBRID = f"""WITH {CORPUS}, {bm25_sql('b', TWO_WORDS)}, {phrase_sql('p', TWO_WORDS)}, g AS (SELECT * FROM p WHERE (SELECT count(*) FROM b) < 15),
u AS (SELECT chunk_id, 1.0 / (60 + rank + 1) AS bm25, 0.0 AS trigram FROM b UNION ALL SELECT chunk_id, 0.0, 1.0 / (60 + rank + 1) FROM g),
f AS (SELECT chunk_id, sum(bm25 + trigram) AS score, sum(bm25) AS bm25, sum(trigram) AS trigram FROM u GROUP BY chunk_id),
k AS ({PLACES}), r AS (SELECT f.chunk_id, k.label, k.title, k.content, f.bm25, f.trigram, f.score * {BOOST} AS score FROM f JOIN k USING (chunk_id)),
hybrid AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM r QUALIFY rank <= 15)"""


def hybrid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Correction is off here: SQL can't say its gate on a corrected query in one statement.
    index = corpus(spark, sf_dir)
    rows = search.hybrid(index, TWO_WORDS, Settings(limit=15, fuzzy_terms=0))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "source_id", "title", "chunk_id")))


@query(f"{HYBRID} SELECT chunk_id, label, round(score, 8) AS score, round(bm25, 8) AS bm25, CAST(rank AS BIGINT) AS rank FROM hybrid")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_rows(spark, sf_dir).select("chunk_id", "label", F.round("score", 8).alias("score"), F.round("bm25", 8).alias("bm25"), F.col("rank").cast("long").alias("rank"))


@query(f"{HYBRID} SELECT count(*) AS total_chunks, CAST(sum(strlen(content)) AS BIGINT) AS estimated_bytes, string_agg(DISTINCT label, ',' ORDER BY label) AS sources_matched, CAST(ceil(sum(strlen(content)) / 4) AS BIGINT) AS estimated_tokens, CASE WHEN ceil(sum(strlen(content)) / 4) <= 20000 THEN 'inline' ELSE 'delegate' END AS recommendation FROM hybrid")
def count_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.result_size(hybrid_rows(spark, sf_dir))


@query(f"{HYBRID} SELECT CAST(sum(least(strlen(content), CASE WHEN rank <= 3 THEN 2000 ELSE 800 END)) AS BIGINT) AS visible_bytes FROM hybrid")
def visible_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.visible_bytes(hybrid_rows(spark, sf_dir), SETTINGS)


@query(
    f"""{HYBRID} SELECT chunk_id, 'why: ' || concat_ws(', ', CASE WHEN bm25 > 0 THEN 'bm25' END, CASE WHEN trigram > 0 THEN 'trigram' END, CASE WHEN score > bm25 + trigram + 1e-12 THEN 'proximity' END) AS why,
'why: ' || concat_ws(', ', CASE WHEN bm25 > 0 THEN 'bm25=' || printf('%.4f', bm25) END, CASE WHEN trigram > 0 THEN 'trigram=' || printf('%.4f', trigram) END, CASE WHEN score > bm25 + trigram + 1e-12 THEN 'proximity=' || printf('%.4f', score - bm25 - trigram) END, 'final=' || printf('%.4f', score)) AS detail FROM hybrid"""
)
def explain_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hybrid_rows(spark, sf_dir)
    return rows.select("chunk_id", search.why(rows).alias("why"), search.why(rows, True).alias("detail"))


WRONG = "thinng heatt"
ALL_LAYERS = f"""WITH {CORPUS}, {bm25_sql('b', WRONG)}, {phrase_sql('p', WRONG)}, g AS (SELECT * FROM p WHERE (SELECT count(*) FROM b) < 15),
vocab AS (SELECT DISTINCT unnest({TOKENS.format('content')}) AS term FROM chunks), q AS (SELECT unnest([0, 1]) AS pos, unnest({WRONG.split()}) AS word),
best AS (SELECT pos, arg_min(term, (levenshtein(word, term), term)) AS term FROM q JOIN vocab ON levenshtein(word, term) <= 2 GROUP BY pos),
t AS (SELECT max(CASE WHEN q.pos = 0 THEN coalesce(term, word) END) AS t0, max(CASE WHEN q.pos = 1 THEN coalesce(term, word) END) AS t1 FROM q LEFT JOIN best USING (pos)),
f_tf AS (SELECT words.*, t0, t1, len(list_filter(w, lambda x: x = t0)) AS tf0, len(list_filter(w, lambda x: x = t1)) AS tf1 FROM words, t),
f_st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf0 > 0) AS df0, count(*) FILTER (WHERE tf1 > 0) AS df1 FROM f_tf),
f_sc AS (SELECT chunk_id, ({idf_sql('n', 'df0')}) * {gain_sql('tf0', 'dl', 'avgdl')} + ({idf_sql('n', 'df1')}) * {gain_sql('tf1', 'dl', 'avgdl')} AS score FROM f_tf, f_st WHERE tf0 > 0 AND tf1 > 0 AND t0 || ' ' || t1 <> '{WRONG}' AND (SELECT count(DISTINCT chunk_id) FROM (SELECT chunk_id FROM b UNION ALL SELECT chunk_id FROM g)) < 15),
f AS (SELECT chunk_id, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM f_sc QUALIFY rank < 15),
k AS (SELECT DISTINCT chunk_id FROM (SELECT chunk_id FROM b UNION ALL SELECT chunk_id FROM g UNION ALL SELECT chunk_id FROM f)),
d AS (SELECT c.chunk_id, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])) AS s FROM chunks c JOIN embeddings v ON v.vec_id = c.chunk_id JOIN embeddings o ON o.vec_id = 0 WHERE c.chunk_id IN (SELECT chunk_id FROM k) OR (SELECT count(*) FROM k) = 0),
v AS (SELECT chunk_id, row_number() OVER (ORDER BY round(s, 6) DESC, chunk_id) - 1 AS rank FROM d QUALIFY rank < 15),
u AS (SELECT chunk_id, 'bm25' AS layer, 1.0 / (61 + rank) AS part FROM b UNION ALL SELECT chunk_id, 'trigram', 1.0 / (61 + rank) FROM g UNION ALL SELECT chunk_id, 'fuzzy', 1.0 / (61 + rank) FROM f UNION ALL SELECT chunk_id, 'vector', 0.8 / (61 + rank) FROM v),
z AS (SELECT chunk_id, sum(part) AS score, coalesce(sum(part) FILTER (WHERE layer = 'fuzzy'), 0) AS fuzzy, coalesce(sum(part) FILTER (WHERE layer = 'vector'), 0) AS vector FROM u GROUP BY chunk_id)
SELECT chunk_id, round(score, 8) AS score, round(fuzzy, 8) AS fuzzy, round(vector, 8) AS vector FROM z QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) <= 15"""


def with_vectors(spark: SparkSession, sf_dir: str) -> tuple[Index, list[float]]:
    """Documents with the embeddings of their ids, and a probe."""
    rows, probe = vectors(spark, sf_dir)
    return Index(corpus(spark, sf_dir).chunks.join(rows.chunks.select("chunk_id", "embedding"), "chunk_id", "left")), probe


@query(ALL_LAYERS)
def hybrid_all_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A misspelt query and a vector: corrected words are looked for, and the vector ranks what they find."""
    index, probe = with_vectors(spark, sf_dir)
    rows = search.hybrid(index, WRONG, Settings(limit=15, fuzzy_terms=None), probe, vector_weight=0.8)
    return rows.select("chunk_id", *[F.round(c, 8).alias(c) for c in ("score", "fuzzy", "vector")])


KNOW = r"""kn AS (SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS chunk_id, conv_id, role, text FROM conversations)"""


def knowledge(spark: SparkSession, sf_dir: str) -> Index:
    """Conversations as notes: one file for each, turns as chunks, the role as the frontmatter's type."""
    rows = table(spark, sf_dir, "conversations")
    chunks = rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("chunk_id"), F.col("conv_id").cast("long").alias("file_id"), F.lit(1).cast("long").alias("source_id"), F.lit("talk").alias("label"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"), F.col("text").alias("content"), F.lit("prose").alias("content_type"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"),
        F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("rel_path"),
        F.to_json(F.struct(F.struct(F.col("role").alias("type"), F.array(F.col("role")).alias("tags")).alias("frontmatter"), F.array(F.lit("talk")).alias("folder_tags"))).alias("metadata"),
    )
    return Index(chunks, knowledge=True)


@query(
    f"""WITH {CORPUS}, {bm25_sql('b', ONE_WORD)}, kc AS (SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS chunk_id, {TOKENS.format("'turn ' || CAST(turn AS VARCHAR) || ' ' || text")} AS w FROM conversations),
kt AS (SELECT chunk_id, len(w) AS dl, len(list_filter(w, lambda x: x = '{ONE_WORD}')) AS tf FROM kc), ks AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf > 0) AS df FROM kt),
kb AS (SELECT chunk_id, ({idf_sql('n', 'df')}) * {gain_sql('tf', 'dl', 'avgdl')} AS score FROM kt, ks WHERE tf > 0),
kr AS (SELECT chunk_id, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM kb QUALIFY rank < 15),
u AS (SELECT 'session' AS source_type, chunk_id, 1.0 / (61 + rank) AS score FROM b UNION ALL SELECT 'knowledge', chunk_id, 1.25 / (61 + rank) FROM kr)
SELECT source_type, chunk_id, round(score, 8) AS score FROM u QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, source_type DESC, chunk_id) <= 15"""
)
def two_corpus_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = search.bm25(corpus(spark, sf_dir), ONE_WORD, 15).select(F.lit("session").alias("source_type"), "chunk_id", (1.0 / (61 + F.col("rank"))).alias("score"))
    k = search.bm25(knowledge(spark, sf_dir), ONE_WORD, 15).select(F.lit("knowledge").alias("source_type"), "chunk_id", (PROFILES["vault_navigation"].bias / (61 + F.col("rank"))).alias("score"))
    both = a.unionByName(k).orderBy(F.round("score", 9).desc(), F.col("source_type").desc(), "chunk_id").limit(15)
    return both.withColumn("score", F.round("score", 8))


@query(
    f"""WITH {CORPUS}, {bm25_sql('b', ONE_WORD)}, {phrase_sql('p', ONE_WORD)}, u AS (SELECT chunk_id AS k, 1.0 / (61 + row_number() OVER (ORDER BY round(score, 9) DESC, CAST(chunk_id AS VARCHAR)) - 1) AS part FROM b
UNION ALL SELECT chunk_id, 1.0 / (61 + row_number() OVER (ORDER BY round(score, 9) DESC, CAST(chunk_id AS VARCHAR)) - 1) FROM p)
SELECT CAST(k AS VARCHAR) AS key, round(sum(part), 8) AS score FROM u GROUP BY k QUALIFY row_number() OVER (ORDER BY round(sum(part), 9) DESC, CAST(k AS VARCHAR)) <= 15"""
)
def combined_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus(spark, sf_dir)
    keyed = lambda rows: rows.select(F.col("chunk_id").cast("string").alias("key"), "score")
    out = search.combined(keyed(search.bm25(index, ONE_WORD, 15)), keyed(search.substring(index, ONE_WORD, 15)), 15)
    return out.select("key", F.round("score", 8).alias("score"))


@query()
def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole query, misspelt, with the debug profile, over both corpora and their links."""
    request = retrieval.Request("reeed", profile="debug", limit=10, query_vector=with_vectors(spark, sf_dir)[1])
    k = knowledge(spark, sf_dir)
    near = k.chunks.select("file_id").distinct().select(F.col("file_id").alias("source_file_id"), (F.col("file_id") + 1).alias("target_file_id"), F.lit("wikilink").alias("link_type"), F.lit(1.0).alias("confidence"))
    _, rows = retrieval.run(request, with_vectors(spark, sf_dir)[0], k, near, None, Settings(limit=10, fuzzy_terms=None))
    return rows.select("source_type", "label", "title", "file_path", F.round("score", 6).alias("score"), search.why(rows).alias("why"), "rank")


@query()
def stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index(indexing.whole_documents(table(spark, sf_dir, "documents")), stem=True).with_postings()
    return scored(search.bm25(index, "things heating", 15))


# --- text functions ---------------------------------------------------------------------------------------------------


@query(r"""SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''), ' ') AS normalized FROM conversations""")
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_query(F.col("text")).alias("normalized"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(text, '[^\p{L}\p{N}_-]+', ' ', 'g')) AS clean FROM conversations""")
def sanitize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sanitize(F.col("text")).alias("clean"))


@query("""WITH c AS (SELECT doc_id, text, substr(text, 1, 200) AS s FROM documents) SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE CASE WHEN contains(s, ' ') THEN regexp_replace(s, ' [^ ]*$', '') ELSE s END || '...' END AS snippet FROM c""")
def snippet_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), 200).alias("snippet"))


@query("""SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 497) || '...' ELSE text END AS response FROM documents""")
def response_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.shortened(F.col("text")).alias("response"))


ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')"


def head_sql(n: int) -> str:
    s = f"substr(t, 1, {n})"
    return f"CASE WHEN contains({s}, chr(10)) AND length({s}) - strpos(reverse({s}), chr(10)) > {n // 2} THEN substr({s}, 1, length({s}) - strpos(reverse({s}), chr(10))) ELSE {s} END"


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ASCII letters only, where bytes are characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))


@query(f"WITH a AS (SELECT doc_id, {ASCII} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 1500 THEN t ELSE ({head_sql(1500)}) || chr(10) || chr(10) || '... [truncated, ' || length(t) || ' bytes total]' END AS preview FROM a")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(spark, sf_dir).select("doc_id", T.preview(F.col("text"), 1500).alias("preview"))


@query(
    f"""WITH a AS (SELECT doc_id, {ASCII} AS t FROM documents), b AS (SELECT *, {head_sql(600)} AS h, right(t, 400) AS e FROM a),
c AS (SELECT *, CASE WHEN contains(e, chr(10)) AND strpos(e, chr(10)) - 1 < 200 THEN substr(e, strpos(e, chr(10)) + 1) ELSE e END AS l FROM b)
SELECT doc_id, CASE WHEN length(t) <= 1000 THEN t ELSE h || chr(10) || chr(10) || '... [' || (length(t) - length(h) - length(l)) || ' bytes omitted] ...' || chr(10) || chr(10) || l END AS cut FROM c"""
)
def head_tail_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(spark, sf_dir).select("doc_id", T.head_and_tail(F.col("text"), 1000, 0.6).alias("cut"))


@query(f"WITH a AS (SELECT doc_id, {ASCII} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 8192 THEN t ELSE ({head_sql(3072)}) || chr(10) || chr(10) || '... [truncated, ' || length(t) || ' bytes total]' END AS shown FROM a")
def adaptive_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(spark, sf_dir).select("doc_id", T.adaptive(F.col("text")).alias("shown"))


@query(
    """WITH k AS (SELECT doc_id, text, left(text, CAST(list_max(list_filter(range(0, 1501), lambda i: strlen(left(text, CAST(i AS INTEGER))) <= 1500)) AS INTEGER)) AS s FROM documents),
e AS (SELECT *, CASE WHEN contains(s, chr(10)) THEN left(s, CAST(length(s) - strpos(reverse(s), chr(10)) AS INTEGER)) END AS line FROM k)
SELECT doc_id, CASE WHEN strlen(text) <= 1500 THEN text ELSE CASE WHEN line IS NOT NULL AND strlen(line) > 750 THEN line ELSE s END || chr(10) || chr(10) || '... [truncated, ' || strlen(text) || ' bytes total]' END AS preview FROM e"""
)
def preview_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text"), 1500).alias("preview"))


@query(f"WITH {CORPUS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY chunk_id) AS rank FROM chunks), a AS (SELECT chunk_id, rank, {ASCII.replace('text', 'content')} AS t FROM r) SELECT chunk_id, CASE WHEN length(t) <= CASE WHEN rank <= 3 THEN 2000 ELSE 800 END THEN t WHEN rank <= 3 THEN ({head_sql(2000)}) || chr(10) || chr(10) || '... [truncated, ' || length(t) || ' bytes total]' ELSE ({head_sql(800)}) || chr(10) || chr(10) || '... [truncated, ' || length(t) || ' bytes total]' END AS snippet, length(t) > CASE WHEN rank <= 3 THEN 2000 ELSE 800 END AS cut FROM a")
def snippet_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of result lists, one for each source, larger ones for a list's first three."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("content"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return retrieval.snippets(rows, PROFILES["default"]).select(F.col("doc_id").alias("chunk_id"), "snippet", "cut")


# --- chunking ----------------------------------------------------------------------------------------------------------

NOTE = """'# ' || p_name || chr(10) || 'Brand: ' || p_brand || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '## Details' || chr(10) || '- ' || p_type || chr(10) || 'size ' || p_size WHEN p_partkey % 3 = 1 THEN 'def f(x) {' || chr(10) || 'return x;' || chr(10) || '}' || chr(10) || 'let y = 2;' || chr(10) || 'let z = 3;' ELSE 'plain words' END"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small Markdown and code texts made from `part`."""
    tail = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("## Details\n- "), "p_type", F.lit("\nsize "), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.lit("def f(x) {\nreturn x;\n}\nlet y = 2;\nlet z = 3;")).otherwise(F.lit("plain words"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("# "), "p_name", F.lit("\nBrand: "), "p_brand", F.lit("\n"), tail).alias("text"))


LINES = f"n AS (SELECT p_partkey, {NOTE} AS text FROM part), l AS (SELECT p_partkey, text, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS ls FROM n)"


@query(
    f"""WITH {LINES}, m AS (SELECT *, len(list_filter(ls, lambda x: starts_with(x, '# ') OR starts_with(x, '## ') OR starts_with(x, '- '))) AS marks, len(list_filter(ls, lambda x: ends_with(x, ';') OR ends_with(x, '{{'))) AS against,
len(list_filter(ls, lambda x: ends_with(x, ';') OR ends_with(x, '{{') OR ends_with(x, '}}'))) AS endings FROM l)
SELECT p_partkey, CASE WHEN marks > 0 AND marks / len(ls) > 0.02 AND against <= 2 * marks THEN 'markdown' WHEN endings / len(ls) > 0.4 THEN 'code' ELSE 'plain' END AS kind FROM m"""
)
def classify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("p_partkey", chunking.content_kind(F.col("text")).alias("kind"))


@query(f"WITH {LINES} SELECT p_partkey, len(list_filter(ls, lambda x: starts_with(x, 'let ') OR starts_with(x, 'def ') OR starts_with(x, '#') OR starts_with(x, '{{') OR starts_with(x, '}}') OR ends_with(x, ';') OR ends_with(x, '{{'))) / len(ls) > 0.6 AS is_code FROM l")
def detect_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("p_partkey", chunking.is_code(F.col("text")).alias("is_code"))


@query(
    f"""WITH {LINES}, x AS (SELECT p_partkey, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM n),
s AS (SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY pos) AS section FROM x)
SELECT p_partkey, CAST(section AS INTEGER) AS section, trim(ltrim(arg_min(line, pos), '#')) AS title, string_agg(line, chr(10) ORDER BY pos) AS content, CAST(min(pos) AS INTEGER) AS line_start, CAST(max(pos) AS INTEGER) AS line_end FROM s GROUP BY p_partkey, section"""
)
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.markdown_chunks(notes(spark, sf_dir), "p_partkey", "text")


@query()
def chunk_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(table(spark, sf_dir, "documents"), ["doc_id"])


@query()
def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(notes(spark, sf_dir), ["p_partkey"])


@query("SELECT source AS label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each source, of its chunks as far as they hold the text as it is."""
    chunks = corpus(spark, sf_dir).chunks
    return chunks.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("SELECT CAST(sum(length(text)) AS BIGINT) AS content_chars FROM documents")
def content_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.content_characters(corpus(spark, sf_dir).chunks)


# --- metadata filters ----------------------------------------------------------------------------------------------------

META = """m AS (SELECT p_partkey, p_brand, p_type, p_size, CASE WHEN p_partkey % 2 = 0 THEN 'docs' ELSE 'vault' END AS label, split_part(p_name, ' ', 1) AS colour FROM part)"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.array(F.split("p_name", " ")[0]).alias("tags"))
    meta = F.to_json(F.struct(front.alias("frontmatter"), F.array("p_brand").alias("folder_tags")))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "docs").otherwise("vault").alias("label"), meta.alias("metadata"))


def filtered(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    rows = annotated(spark, sf_dir)
    return rows.filter(filters.condition(filters.parse(text), F.col("metadata"), F.col("label"))).select("p_partkey")


@query(f"WITH {META} SELECT p_partkey FROM m WHERE p_type = 'ECONOMY'")
def frontmatter_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "type:ECONOMY bad key':x :y")


@query(f"WITH {META} SELECT p_size AS size, count(*) AS n, CAST(0 AS BIGINT) AS matched FROM m GROUP BY p_size")
def frontmatter_number_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number in the frontmatter never equals the text of a filter: of all parts by size, those whose size is asked for as text."""
    rows = annotated(spark, sf_dir).withColumn("size", F.get_json_object("metadata", "$.frontmatter.size").cast("int"))
    sizes = [r.size for r in rows.select("size").distinct().collect()]
    asked = F.lit(False)
    for size in sizes:
        asked = asked | filters.condition(filters.parse(f"size:{size}"), F.col("metadata"), F.col("label"))
    return rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asked, 1)).alias("matched"))


@query(f"WITH {META} SELECT p_partkey FROM m WHERE colour = 'red'")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "tag:red")


@query(f"WITH {META} SELECT p_partkey FROM m WHERE p_brand = 'Brand#17'")
def folder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "folder:Brand#17")


@query(f"WITH {META} SELECT p_partkey FROM m WHERE label = 'vault' AND p_type = 'ECONOMY' AND colour = 'red'")
def compound_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "source:vault type:ECONOMY tag:red")


# --- links -----------------------------------------------------------------------------------------------------------------

LINKED = """txt AS (SELECT a.n_nationkey, 'See [[' || string_agg('notes/' || b.n_name || '|x', ']] and [[' ORDER BY b.n_nationkey) || ']] [[' || any_value(a.n_name) || ']]' AS text FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey >= a.n_nationkey GROUP BY a.n_nationkey)"""


def linked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's note: links to the nations of its region from itself on, and to itself by name."""
    n = table(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("b.n_nationkey") >= F.col("a.n_nationkey")))
    grouped = pairs.groupBy(F.col("a.n_nationkey").alias("n_nationkey"), F.col("a.n_name").alias("n_name")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("b.n_nationkey"), F.col("b.n_name").alias("name")))), lambda x: F.concat(F.lit("notes/"), x["name"], F.lit("|x"))).alias("names"))
    return grouped.select("n_nationkey", "n_name", F.concat(F.lit("See [["), F.array_join("names", "]] and [["), F.lit("]] [["), "n_name", F.lit("]]")).alias("text"))


@query(f"WITH {LINKED} SELECT n_nationkey, array_to_string(list_transform(regexp_extract_all(text, '\\[\\[(.*?)\\]\\]', 1), lambda x: trim(split_part(x, '|', 1))), ';') AS targets FROM txt")
def wikilinks_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_notes(spark, sf_dir).select("n_nationkey", F.array_join(enrich.wikilinks(F.col("text")), ";").alias("targets"))


RESOLVED = """links AS (SELECT CAST(a.n_nationkey AS BIGINT) AS source_file_id, CAST(b.n_nationkey AS BIGINT) AS target_file_id FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey)"""


def link_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """links, files and chunks of the notes."""
    rows = linked_notes(spark, sf_dir)
    files = rows.select(F.col("n_nationkey").cast("long").alias("file_id"), F.concat(F.lit("notes/"), "n_name", F.lit(".md")).alias("rel_path"))
    targets = rows.select(F.col("n_nationkey").cast("long").alias("source_file_id"), F.explode(enrich.wikilinks(F.col("text"))).alias("target"))
    chunks = rows.select(F.col("n_nationkey").cast("long").alias("file_id"), F.col("n_nationkey").cast("long").alias("chunk_id"), F.col("n_name").alias("title"), F.col("text").alias("content"))
    return links.resolve(targets, files), files, chunks


@query(f"WITH {RESOLVED} SELECT source_file_id, target_file_id, 'wikilink' AS link_type, CAST(1 AS DOUBLE) AS confidence FROM links")
def wikilink_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tables(spark, sf_dir)[0]


def _related(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    edges, _, chunks = link_tables(spark, sf_dir)
    return links.related(edges, chunks, 9, direction, 10).select("file_id", "direction", "title")


BOTH = "SELECT target_file_id AS file_id, 'forward' AS direction FROM links WHERE source_file_id = 9 UNION ALL SELECT source_file_id, 'backward' FROM links WHERE target_file_id = 9"


@query(f"WITH {RESOLVED}, b AS ({BOTH}) SELECT file_id, direction, n_name AS title FROM b JOIN nation ON n_nationkey = file_id WHERE direction = 'forward'")
def links_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir, "forward")


@query(f"WITH {RESOLVED}, b AS ({BOTH}) SELECT file_id, direction, n_name AS title FROM b JOIN nation ON n_nationkey = file_id WHERE direction = 'backward'")
def links_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir, "backward")


@query(f"WITH {RESOLVED}, b AS ({BOTH}) SELECT file_id, direction, n_name AS title FROM b JOIN nation ON n_nationkey = file_id")
def links_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir, "both")


HOPS = f"""WITH RECURSIVE {RESOLVED}, e AS (SELECT source_file_id AS a, target_file_id AS b, 'forward' AS direction FROM links UNION ALL SELECT target_file_id, source_file_id, 'backward' FROM links),
reach AS (SELECT CAST(9 AS BIGINT) AS id, 0 AS d UNION SELECT e.b, d + 1 FROM reach JOIN e ON e.a = reach.id WHERE d < 2), near AS (SELECT id, min(d) AS d FROM reach GROUP BY id)"""


@query(f"{HOPS} SELECT id AS file_id, n_name AS title, CAST(d AS INTEGER) AS hop FROM near JOIN nation ON n_nationkey = id WHERE d > 0")
def multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, chunks = link_tables(spark, sf_dir)
    return links.multi_hop(edges, chunks, 9, "both", 50, 2).select("file_id", "title", F.col("hop").cast("int").alias("hop"))


@query(f"{HOPS} SELECT 'notes/' || n_name || '.md' AS rel_path, direction, CAST(1 AS BIGINT) AS chunk_count, CAST(min(near.d + 1) AS INTEGER) AS hop FROM near JOIN e ON e.a = near.id JOIN nation ON n_nationkey = e.b WHERE near.d < 2 GROUP BY ALL")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, files, chunks = link_tables(spark, sf_dir)
    return links.link_counts(edges, files, chunks, 9, "both", 2).select("rel_path", "direction", "chunk_count", "hop")


RANKED = "(SELECT CAST(n_nationkey AS BIGINT) AS chunk_id, CAST(n_nationkey AS BIGINT) AS file_id, 1.0 / (61 + n_nationkey) AS score FROM nation ORDER BY score DESC LIMIT 6)"


def nation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best nations of a ranking by key."""
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_nationkey").cast("long").alias("chunk_id"), F.col("n_nationkey").cast("long").alias("file_id"), F.col("n_name").alias("title"), (1.0 / (61 + F.col("n_nationkey"))).alias("score"))
    return rows.orderBy(F.col("score").desc()).limit(6)


@query(f"WITH {RESOLVED}, r AS {RANKED}, e AS (SELECT source_file_id AS a, target_file_id AS b FROM links UNION ALL SELECT target_file_id, source_file_id FROM links), nb AS (SELECT DISTINCT b FROM e WHERE a < 3) SELECT r.file_id, round(score + CASE WHEN nb.b IS NULL THEN 0 ELSE 0.0015 END, 8) AS score, nb.b IS NOT NULL AS graph_neighbor FROM r LEFT JOIN nb ON nb.b = r.file_id")
def graph_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, chunks = link_tables(spark, sf_dir)
    out = links.graph_rerank(nation_results(spark, sf_dir), edges, chunks, 0.0015, False, 50)
    return out.select("file_id", F.round("score", 8).alias("score"), "graph_neighbor")


@query(
    f"""WITH {RESOLVED}, r AS {RANKED}, e AS (SELECT source_file_id AS a, target_file_id AS b FROM links UNION ALL SELECT target_file_id, source_file_id FROM links), nb AS (SELECT DISTINCT b FROM e WHERE a < 3),
s AS (SELECT r.file_id, score + CASE WHEN nb.b IS NULL THEN 0 ELSE 0.003 END AS score FROM r LEFT JOIN nb ON nb.b = r.file_id), x AS (SELECT b AS file_id, (SELECT min(score) * 0.92 + 0.003 FROM s) AS score FROM nb WHERE b NOT IN (SELECT file_id FROM r) ORDER BY b LIMIT 2)
SELECT file_id, round(score, 8) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM x)"""
)
def graph_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, chunks = link_tables(spark, sf_dir)
    return links.graph_rerank(nation_results(spark, sf_dir), edges, chunks, 0.003, True, 50).select("file_id", F.round("score", 8).alias("score"))


@query("SELECT page_id, array_to_string(p[1:len(p) - 1], '/') AS tags FROM (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS p FROM pages)")
def folder_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(enrich.folder_tags(path), "/").alias("tags"))


@query("""SELECT p_partkey, '{"frontmatter":{"type": "' || p_type || '", "size": ' || p_size || ', "tags": ["a", "b"]}}' AS metadata FROM part""")
def frontmatter_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("---\ntype: "), "p_type", F.lit("\nsize: "), F.col("p_size").cast("string"), F.lit("\ntags: [a, b]\n---\nbody"))
    return table(spark, sf_dir, "part").select("p_partkey", enrich.metadata(["frontmatter"], text, F.lit("x")).alias("metadata"))


# --- synchronisation ----------------------------------------------------------------------------------------------------

DIFF = """old AS (SELECT CAST(doc_id AS VARCHAR) AS rel_path, sha256(text) AS h FROM documents), new AS (SELECT rel_path, CASE WHEN CAST(rel_path AS BIGINT) % 7 = 0 THEN 'x' ELSE h END AS h FROM old WHERE CAST(rel_path AS BIGINT) % 11 <> 0 UNION ALL SELECT 'n' || rel_path, h FROM old WHERE CAST(rel_path AS BIGINT) % 50 = 0),
d AS (SELECT coalesce(new.rel_path, old.rel_path) AS rel_path, CASE WHEN old.h IS NULL THEN 'added' WHEN new.h IS NULL THEN 'removed' WHEN old.h = new.h THEN 'unchanged' ELSE 'updated' END AS status FROM new FULL JOIN old USING (rel_path))"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), sync.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    changed = old.filter("doc_id % 11 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("content_hash")))
    new = old.filter("doc_id % 50 = 0").withColumn("rel_path", F.concat(F.lit("n"), "rel_path"))
    return changed.unionByName(new).drop("doc_id"), old.drop("doc_id")


@query(f"WITH {DIFF} SELECT rel_path, status FROM d")
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.diff(*snapshots(spark, sf_dir))


@query(f"WITH {DIFF} SELECT count(*) FILTER (WHERE status <> 'removed') AS scanned, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM d")
def sync_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.counters(sync.diff(*snapshots(spark, sf_dir)))


@query("SELECT CAST(r_regionkey AS BIGINT) AS source_id, count(DISTINCT n_nationkey) AS file_count, count(c_custkey) AS chunk_count FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey")
def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("source_id"))
    files = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("source_id"), "n_nationkey")
    chunks = table(spark, sf_dir, "customer").join(files, F.col("c_nationkey") == F.col("n_nationkey")).select("source_id")
    return sync.source_totals(sources, files.select("source_id"), chunks)


@query("SELECT sha256(text) AS data_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY sha256(text)")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.contents(table(spark, sf_dir, "documents"))


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.missing_embeddings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")))


@query("SELECT c_custkey AS source_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as chunks whose sources are orders."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"))
    return indexing.orphans(rows, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id")))


@query(f"SELECT user_id AS source_id, max(ts) AS last_sync, datediff('second', max(ts), TIMESTAMP '{AS_OF}') // 60 >= 600 AS is_stale FROM events GROUP BY user_id")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.max("ts").alias("last_sync"))
    return sync.stale(last, F.lit(AS_OF).cast("timestamp"), 600)


@query("WITH s AS (SELECT * FROM (VALUES ('all', ''), ('de', 'de/'), ('en', 'en/'), ('fr', 'fr/')) t(label, folder)), p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '/web/') AS path FROM pages) SELECT path, min(label) AS label FROM p JOIN s ON starts_with(path, '/web/' || folder) AND (label = 'all' OR NOT contains(substr(path, length('/web/' || folder) + 1), '/')) WHERE label <> 'all' OR path LIKE '/web/es/%' GROUP BY path")
def source_for_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source a page's path belongs to; language folders take pages right below them, `all` takes Spanish ones."""
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://[^/]*/", "/web/").alias("path"))
    rows = [("all", "/web", sync.glob_pattern("es/**")), *[(x, f"/web/{x}", sync.glob_pattern("/*")[:1] + "[^/]*$") for x in ("de", "en", "fr")]]
    return sync.source_for_path(paths, spark.createDataFrame(rows, "label string, base string, pattern string"))


# --- ledger ---------------------------------------------------------------------------------------------------------------

LEDGER = "led AS (SELECT event_id AS chunk_id, 'user ' || user_id AS source_label, CAST(floor(value * 10) AS BIGINT) AS token_estimate, ts AS returned_at, user_id FROM events)"
BREAK = "brk AS (SELECT source_label AS label, CAST(sum(token_estimate) AS BIGINT) AS tokens, count(*) AS access_count, max(returned_at) AS last_access FROM led GROUP BY source_label)"
SCORES = f"sc AS (SELECT *, greatest(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(last_access)), 0) / 60.0 AS m FROM brk), rel AS (SELECT label, tokens, access_count, 0.4 / (1 + m / 10) + 0.3 * access_count / (SELECT greatest(max(access_count), 1) FROM brk) - 0.3 * CASE WHEN m > 60 THEN least(m - 60, 60) / 60.0 ELSE 0 END AS relevance FROM sc)"
ADVICE = "kp AS (SELECT *, 'keep' AS advice FROM rel ORDER BY round(relevance, 9) DESC, label LIMIT 3), dr AS (SELECT *, 'drop' AS advice FROM rel WHERE label NOT IN (SELECT label FROM kp) ORDER BY round(relevance, 9), label DESC LIMIT 3), adv AS (SELECT * FROM kp UNION ALL SELECT * FROM dr)"


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("chunk_id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("source_label"), F.floor(F.col("value") * 10).cast("long").alias("token_estimate"), F.col("ts").alias("returned_at"), F.lit(1).alias("access_count"), "user_id")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


@query(f"WITH {LEDGER}, {BREAK} SELECT * FROM brk")
def ledger_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.breakdown(ledger_rows(spark, sf_dir))


@query(f"WITH {LEDGER} SELECT CAST(sum(token_estimate) AS BIGINT) AS total_tokens, count(DISTINCT source_label) AS source_count FROM led")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.totals(ledger_rows(spark, sf_dir))


@query(f"WITH {LEDGER}, {BREAK}, {SCORES} SELECT label, round(relevance, 6) AS relevance, CASE WHEN relevance > 0.6 THEN 'high' WHEN relevance > 0.3 THEN 'mid' ELSE 'low' END AS level FROM rel")
def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.relevance(ledger.breakdown(ledger_rows(spark, sf_dir)), as_of()).select("label", F.round("relevance", 6).alias("relevance"), "level")


@query(f"WITH {LEDGER}, {BREAK}, {SCORES}, {ADVICE} SELECT label, tokens, access_count, round(relevance, 6) AS relevance, advice FROM adv")
def keep_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.keep_and_drop(ledger.relevance(ledger.breakdown(ledger_rows(spark, sf_dir)), as_of()))
    return out.withColumn("relevance", F.round("relevance", 6))


@query(f"WITH {LEDGER}, {BREAK}, {SCORES}, {ADVICE} SELECT CAST(coalesce(sum(tokens) FILTER (WHERE advice = 'drop'), 0) AS BIGINT) AS savings FROM adv")
def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.savings(ledger.keep_and_drop(ledger.relevance(ledger.breakdown(ledger_rows(spark, sf_dir)), as_of())))


@query(f"WITH {LEDGER}, r AS (SELECT *, sum(token_estimate) OVER (PARTITION BY user_id ORDER BY returned_at, chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM led), p AS (SELECT *, CAST(floor(used * 100 / 10000) AS INTEGER) AS pct FROM r), t AS (SELECT *, CASE WHEN pct >= 90 THEN 90 WHEN pct >= 80 THEN 80 WHEN pct >= 70 THEN 70 WHEN pct >= 60 THEN 60 WHEN pct >= 40 THEN 40 ELSE 0 END AS threshold FROM p), l AS (SELECT *, coalesce(lag(threshold) OVER (PARTITION BY user_id ORDER BY returned_at, chunk_id), 0) AS b FROM t) SELECT user_id, chunk_id, CAST(used AS BIGINT) AS used, CAST(threshold AS INTEGER) AS threshold FROM l WHERE threshold > b")
def alert_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.crossings(ledger_rows(spark, sf_dir), Settings(budget_tokens=10_000), "user_id").select("user_id", "chunk_id", "used", "threshold")


@query("WITH a AS (SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes_indexed FROM documents), b AS (SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes_returned FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)) SELECT bytes_indexed, bytes_returned, (bytes_indexed - bytes_returned) // 4 AS tokens_saved, round((bytes_indexed - bytes_returned) / bytes_indexed, 6) AS savings_ratio, round(bytes_returned / bytes_indexed, 6) AS visibility_ratio, bytes_indexed > 10000 AND bytes_returned / bytes_indexed < 0.05 AS too_little_seen FROM a, b")
def visibility_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("bytes"))
    shown = rows.join(table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id", "left_semi")
    out = ledger.visibility(rows, shown)
    return out.withColumn("savings_ratio", F.round("savings_ratio", 6)).withColumn("visibility_ratio", F.round("visibility_ratio", 6))


# --- events -----------------------------------------------------------------------------------------------------------------

EVENTS = "ev AS (SELECT event_id, event_type AS category, props AS data, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END AS priority, ts AS created_at, user_id FROM events)"


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("category"), F.col("props").alias("data"), p.alias("priority"), F.col("ts").alias("created_at"), "user_id")


@query(f"WITH {EVENTS} SELECT sha256(data) AS data_hash, arg_min(event_id, (created_at, event_id)) AS event_id FROM ev GROUP BY data")
def events_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.distinct_events(event_rows(spark, sf_dir)).select("data_hash", "event_id")


@query(f"WITH {EVENTS} SELECT event_id, category, priority FROM ev ORDER BY priority DESC, created_at DESC, event_id DESC LIMIT 50")
def events_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.recent(event_rows(spark, sf_dir), 50).select("event_id", "category", "priority")


@query(f"WITH {EVENTS} SELECT user_id, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, created_at DESC, event_id DESC) <= 20")
def events_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.retained(event_rows(spark, sf_dir), 20, "user_id").select("user_id", "event_id")


@query(f"WITH {EVENTS} SELECT category, count(*) AS n, arg_max(created_at, (priority, created_at)) AS latest, max(priority) AS priority FROM ev GROUP BY category")
def event_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.categories(event_rows(spark, sf_dir))


@query(
    f"""WITH {EVENTS}, r AS (SELECT event_id, category, 1 AS priority, created_at FROM ev ORDER BY created_at DESC, event_id DESC LIMIT 100), c AS (SELECT category, count(*) AS n, arg_max(created_at, (priority, created_at)) AS latest, max(priority) AS priority FROM r GROUP BY category),
s AS (SELECT *, '### ' || category || chr(10) || '- ' || n || ' events (latest: ' || strftime(latest, '%Y-%m-%d %H:%M:%S') || ')' || chr(10) || chr(10) AS section FROM c),
z AS (SELECT *, row_number() OVER (ORDER BY priority DESC, category) AS place, sum(strlen(section)) OVER (ORDER BY priority DESC, category ROWS UNBOUNDED PRECEDING) + 19 AS size FROM s)
SELECT category, n, section, CAST(place AS INTEGER) AS place, CAST(size AS BIGINT) AS size, size <= 150 AS fits FROM z"""
)
def event_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).withColumn("priority", F.lit(1))
    return events.snapshot(rows, Settings(snapshot_bytes=150)).select("category", "n", "section", "place", F.col("size").cast("long").alias("size"), "fits")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 2 WHEN event_type = 'purchase' THEN 3 ELSE 1 END AS priority FROM events")
def event_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.when(F.col("event_type") == "click", "Bash").when(F.col("event_type") == "purchase", "Agent").otherwise("Other")
    return table(spark, sf_dir, "events").select("event_id", events.priority(tool).alias("priority"))


@query("SELECT sha256(props) AS data_hash, min(event_id) AS event_id FROM events GROUP BY props")
def stream_dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, run until it has seen all that is there; each content's first event stays.

    The stream's micro-batch goes to a table of the shared folder, and the first of each content is then the least id.
    """
    folder = shared_folder(spark, "stream")
    kind = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(sf_dir)
    kept = rows.select("event_id", F.sha2("props", 256).alias("data_hash"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.groupBy("data_hash").agg(F.min("event_id").alias("event_id")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    kept.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("data_hash").agg(F.min("event_id").alias("event_id"))


# --- search memory ------------------------------------------------------------------------------------------------------------

RUNS = "runs AS (SELECT event_id AS run_id, event_type AS normalized_query, 'debug' AS profile, event_type || ' ' || user_id % 5 AS effective_query, CASE WHEN user_id % 3 = 0 THEN 'src' || user_id END AS source_hint, CASE WHEN user_id % 4 = 0 THEN 'type:' || user_id END AS filter_hint, ts AS created_at, 'label ' || user_id % 10 AS source_label FROM events)"


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("normalized_query"), F.lit("debug").alias("profile"), F.concat("event_type", F.lit(" "), (F.col("user_id") % 5).cast("string")).alias("effective_query"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("src"), user)).alias("source_hint"), F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("type:"), user)).alias("filter_hint"), F.lit(False).alias("memory_applied"),
        F.col("ts").alias("created_at"), F.concat(F.lit("label "), (F.col("user_id") % 10).cast("string")).alias("source_label"),
    )


@query(f"WITH {RUNS} SELECT normalized_query, profile, arg_max(effective_query, (created_at, run_id)) AS learned_query, arg_max(source_hint, (created_at, run_id)) FILTER (WHERE source_hint IS NOT NULL) AS learned_source_hint, arg_max(filter_hint, (created_at, run_id)) FILTER (WHERE filter_hint IS NOT NULL) AS learned_filter_hint, count(*) AS success_count FROM runs GROUP BY normalized_query, profile")
def memory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_rows(spark, sf_dir)
    credits = memory.credit(rows, F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("created_at"))
    known = spark.createDataFrame([], schema.MEMORY)
    # Three instalments, in the order of time.
    for early, late in (("1900-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2999-01-01")):
        known = memory.upsert(known, credits.filter((F.col("credited_at") >= early) & (F.col("credited_at") < late)))
    return known.select("normalized_query", "profile", "learned_query", "learned_source_hint", "learned_filter_hint", "success_count")


@query(f"WITH {RUNS} SELECT source_label, arg_max(run_id, (created_at, run_id)) AS run_id FROM runs GROUP BY source_label")
def memory_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_rows(spark, sf_dir)
    return memory.latest_run(rows.drop("source_label"), rows.select("run_id", "source_label"), "source_label").select("source_label", "run_id")


@query(f"WITH {RUNS} SELECT normalized_query, arg_max(run_id, (created_at, run_id)) AS run_id FROM runs GROUP BY normalized_query")
def memory_latest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.latest_query(run_rows(spark, sf_dir)).select("normalized_query", "run_id")


@query("SELECT * FROM (VALUES ('default', 1.0, 1.0, 1.0, 0.0, 0.0), ('code_review', 1.35, 0.9, 1.0, 0.0, 0.0015), ('debug', 1.1, 1.0, 1.05, 0.0015, 0.0015), ('planning', 1.0, 1.1, 1.15, 0.003, 0.003), ('vault_navigation', 0.95, 1.2, 1.25, 0.0045, 0.0045)) t(profile, keyword, vector, bias, boost, scoped_boost)".replace("SELECT *", "SELECT profile, CAST(keyword AS DOUBLE) AS keyword, CAST(vector AS DOUBLE) AS vector, CAST(bias AS DOUBLE) AS bias, CAST(boost AS DOUBLE) AS boost, CAST(scoped_boost AS DOUBLE) AS scoped_boost"))
def profile_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p.name, p.keyword, p.vector, p.bias, p.boost, p.scoped_boost) for p in PROFILES.values()]
    return spark.createDataFrame(rows, "profile string, keyword double, vector double, bias double, boost double, scoped_boost double")


@query(f"WITH {CORPUS}, {bm25_sql('b', ONE_WORD)} SELECT chunk_id, round(score * 1.15, 6) AS score, round(score * 0.15, 6) AS knowledge_bias FROM b")
def knowledge_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    biased = F.col("score") * PROFILES["planning"].bias
    return search.bm25(corpus(spark, sf_dir), ONE_WORD, 15).select("chunk_id", F.round(biased, 6).alias("score"), F.round(biased - F.col("score"), 6).alias("knowledge_bias"))


# --- policy -----------------------------------------------------------------------------------------------------------------

COMMANDS = ("git status", "git log --oneline", "cat /etc/hosts", "echo hello > /tmp/a.txt", "cp a.md /notes/b.md", "make all | tee -a /var/log/x.log", "ls", "guarantee /x")
CALLS = f"calls AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'WebFetch' WHEN event_type = 'signup' THEN 'Read' ELSE 'Bash' END AS tool, ({list(COMMANDS)})[1 + CAST(event_id % 8 AS INTEGER)] AS command FROM events)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.when(F.col("event_type") == "view", "WebFetch").when(F.col("event_type") == "signup", "Read").otherwise("Bash")
    return table(spark, sf_dir, "events").select("event_id", tool.alias("tool"), F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("event_id") % 8 + 1).cast("int")).alias("command"))


@query(f"WITH {CALLS} SELECT event_id, CASE WHEN tool = 'WebFetch' OR (tool = 'Bash' AND event_id % 8 IN (1, 2, 5)) THEN 'block' ELSE 'approve' END AS decision FROM calls")
def tool_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("event_id", policy.decision(F.col("tool"), F.col("command")).alias("decision"))


@query(f"WITH {CALLS} SELECT event_id, CASE WHEN tool <> 'Bash' THEN '' WHEN event_id % 8 = 3 THEN '/tmp/a.txt' WHEN event_id % 8 = 4 THEN '/notes/b.md' WHEN event_id % 8 = 5 THEN '/var/log/x.log' ELSE '' END AS paths FROM calls")
def written_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return calls(spark, sf_dir).select("event_id", F.array_join(policy.written_paths(F.col("tool"), none, F.col("command"), none), ";").alias("paths"))


# --- embeddings and pages ------------------------------------------------------------------------------------------------------


@query("WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), i AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS k FROM b) SELECT doc_id, k % 16 AS dim, CAST(sum(CAST('0x' || substr(h, 2 * k + 1, 2) AS INTEGER)) AS BIGINT) AS total FROM i GROUP BY doc_id, k % 16")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte sums that the model-free embedder brings to length one."""
    embedder = ByteSumEmbedder(16)

    @F.pandas_udf("array<bigint>")
    def sums(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.sums(texts.tolist())))

    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sums("text")).alias("dim", "total"))
    return rows.filter("total > 0").select("doc_id", F.col("dim").cast("long").alias("dim"), "total")


@query(
    """WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), i AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS k FROM b), s AS (SELECT doc_id, k % 16 AS dim, sum(CAST('0x' || substr(h, 2 * k + 1, 2) AS INTEGER)) AS total FROM i GROUP BY doc_id, k % 16),
n AS (SELECT *, total / sqrt(sum(total * total) OVER (PARTITION BY doc_id)) AS x FROM s) SELECT doc_id, dim, round(x, 2) AS value FROM n"""
)
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embed(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), ByteSumEmbedder(16))
    return rows.select("doc_id", F.posexplode("embedding").alias("dim", "x")).filter("x > 0").select("doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 2).alias("value"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS length, len(embedding) AS dim FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(T.dot(e, e)), 4).alias("length"), F.size(e).cast("long").alias("dim"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import files

    return files.fetched_pages(table(spark, sf_dir, "pages"))


@query("SELECT doc_id AS source_id, source AS label, CAST(1 AS INTEGER) AS chunk_count, CAST(0 AS INTEGER) AS code_chunk_count FROM documents")
def sources_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus(spark, sf_dir).chunks.withColumn("is_code", F.lit(False))
    return indexing.sources(chunks, as_of()).drop("indexed_at")


@query("SELECT doc_id AS chunk_id, source AS label FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 10")
def read_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.chunks_of(corpus(spark, sf_dir).chunks, "src3", 10).select("chunk_id", "label")
