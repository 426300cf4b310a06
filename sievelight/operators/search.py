"""Search layers as DataFrames, their fusion and what is said of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import porter
from ..functions import text as T
from .indexing import Index

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
LAYERS = ("bm25", "trigram", "fuzzy", "vector")


def _idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def _gain(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _best(scored: DataFrame, limit: int) -> DataFrame:
    """The best by score (rounded, so that ties don't hang on the last bit), then the least chunk_id; rank from 0."""
    top = scored.filter("score > 0").orderBy(F.round("score", 9).desc(), "chunk_id").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "chunk_id")) - 1
    return top.withColumn("rank", rank).select("chunk_id", "score", "rank")


def held(rows: DataFrame) -> DataFrame:
    """The rows of a list that a limit has cut, held by the driver, so that what follows doesn't run the search again."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema)


def bm25(index: Index, query: str | list[str], limit: int, where: Column | None = None) -> DataFrame:
    """chunk_id, score, rank of chunks that have all the query's words; statistics are those of the whole corpus.

    With postings only the query's terms are read; without, one scan counts the words of each chunk, or their stems, and nothing is
    shuffled but a row of statistics.
    """
    terms = T.query_tokens(query) if isinstance(query, str) else query
    if index.stem:
        terms = [porter.stem(t) for t in terms]
    empty = index.chunks.limit(0).select("chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    if not terms:
        return empty
    times = {t: terms.count(t) for t in dict.fromkeys(terms)}
    names = list(times)
    if index.postings is not None or index.lookup is not None:
        return _bm25_postings(index, times, limit, where)
    every = F.lit(True)
    for i in range(len(names)):
        every = every & (F.col(f"_tf{i}") > 0)

    def counted(only_hits: bool) -> DataFrame:
        """Chunks with _dl and the counts _tf0, ..; made once a row: what Spark doesn't push through `inline` it doesn't repeat."""
        if index.stem:
            rows = index.chunks.withColumn("_words", index.words())
            dl, rows = F.size("_words"), rows.withColumn("_stems", porter.stems_among(F.col("_words"), names))
            tfs = [T.count_of(F.col("_stems"), F.lit(t)) for t in names]
        else:  # words are looked for only where their letters are, and no array of words is made
            rows, maybe = index.chunks.withColumn("_text", index.folded()), F.lit(True)
            for t in names:
                maybe = maybe & F.contains("_text", F.lit(t))
            dl = T.count_words(F.col("_text"))
            dl = F.when(maybe, dl) if only_hits else dl
            tfs = [T.count_word(F.col("_text"), t) for t in names]
        return rows.select("*", F.inline(F.array(F.struct(dl.alias("_dl"), *[tf.alias(f"_tf{i}") for i, tf in enumerate(tfs)]))))

    stats = counted(False).agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avgdl"), *[F.count(F.when(F.col(f"_tf{i}") > 0, 1)).alias(f"_df{i}") for i in range(len(names))])
    score = F.lit(0.0)
    for i, t in enumerate(names):
        score = score + times[t] * _idf(F.col("_n"), F.col(f"_df{i}")) * _gain(F.col(f"_tf{i}"), F.col("_dl"), F.col("_avgdl"))
    hits = counted(True) if where is None else counted(True).filter(where)
    # The statistics are one row.
    return _best(hits.filter(every).join(F.broadcast(stats)).select("chunk_id", score.alias("score")), limit)


def _bm25_postings(index: Index, times: dict[str, int], limit: int, where: Column | None) -> DataFrame:
    stats = index.corpus_stats()
    found = index.postings_of(list(times))
    dfs = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.create_map(*[F.lit(x) for kv in times.items() for x in kv])[F.col("term")]
    # As many rows as the query has terms, and one row.
    parts = found.join(F.broadcast(dfs), "term").join(F.broadcast(stats)).select("chunk_id", "term", (weight * _idf(F.col("n"), F.col("df")) * _gain(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("part"))
    scored = parts.groupBy("chunk_id").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("terms")).filter(F.col("terms") == len(times))
    if where is not None:
        scored = scored.join(index.chunks.filter(where).select("chunk_id"), "chunk_id", "left_semi")
    return _best(scored, limit)


def substring(index: Index, query: str, limit: int, where: Column | None = None) -> DataFrame:
    """Chunks with the sanitised query as a substring of a column, whatever its case, ranked as one phrase; from 3 bytes on."""
    phrase = T.sanitize_query(query).lower()
    if len(phrase.encode()) < 3:
        return index.chunks.limit(0).select("chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    cols = [F.lower(F.col(c)) for c in index.indexed_columns()]
    tf, dl = F.lit(0), F.lit(0)
    for c in cols:
        tf, dl = tf + T.occurrences(c, F.lit(phrase)), dl + F.greatest(F.length(c) - 2, F.lit(0))
    counted = index.chunks.select("*", F.inline(F.array(F.struct(tf.alias("_tf"), dl.alias("_dl")))))
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avgdl"), F.count(F.when(F.col("_tf") > 0, 1)).alias("_df"))
    hits = counted if where is None else counted.filter(where)
    score = _idf(F.col("_n"), F.col("_df")) * _gain(F.col("_tf"), F.col("_dl"), F.col("_avgdl"))
    return _best(hits.filter("_tf > 0").join(F.broadcast(stats)).select("chunk_id", score.alias("score")), limit)


def vocabulary(index: Index, limit: int | None) -> DataFrame:
    """The first terms of the content in alphabetical order, or all in any order."""
    words = index.chunks.select(F.explode(T.tokens(F.col("content"))).alias("term"))
    if index.stem:
        words = porter.stems(words).select(F.col("stem").alias("term"))
    terms = words.distinct()
    return terms if limit is None else terms.orderBy("term").limit(limit)


def corrections(index: Index, query: str, settings: Settings) -> DataFrame:
    """(pos, word, corrected): each word's nearest term within the distance, the first in order; itself if there is none."""
    spark = index.chunks.sparkSession
    words = spark.createDataFrame([(i, w) for i, w in enumerate(query.split())], "pos int, word string")
    terms = vocabulary(index, settings.fuzzy_terms)
    far = settings.fuzzy_distance
    # The query's few words against each term.
    near = terms.join(F.broadcast(words)).withColumn("distance", F.levenshtein(F.lower("word"), F.col("term"), far)).filter("distance >= 0")
    best = near.groupBy("pos").agg(F.min_by("term", F.struct("distance", "term")).alias("term"))
    return words.join(best, "pos", "left").select("pos", "word", F.coalesce("term", "word").alias("corrected"))


def corrected_query(index: Index, query: str, settings: Settings) -> str | None:
    """The query with its words corrected, None if that changes nothing; as many rows as words come to the driver."""
    found = sorted(corrections(index, query, settings).collect())
    fixed = " ".join(r.corrected for r in found)
    return None if not found or fixed == query else fixed


def vector(index: Index, query_vector: list[float], limit: int, where: Column | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """The nearest chunks by inner product, among the candidates if there are any, else among all."""
    rows = index.chunks if where is None else index.chunks.filter(where)
    if candidates is not None:
        rows = rows.join(candidates.select("chunk_id"), "chunk_id", "left_semi")
    probe = F.array(*[F.lit(float(x)) for x in query_vector])
    scored = rows.filter("embedding IS NOT NULL").select("chunk_id", T.dot(F.col("embedding"), probe).alias("score"))
    top = scored.orderBy(F.round("score", 6).desc(), "chunk_id").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.round("score", 6).desc(), "chunk_id")) - 1
    return top.withColumn("rank", rank).select("chunk_id", "score", "rank")


def gate(layer: DataFrame, seen: DataFrame, limit: int, key: list[str] | None = None) -> DataFrame:
    """The layer, empty if `seen` (at most a few limits of rows) already has `limit` rows, or keys."""
    count = seen.agg((F.countDistinct(*key) if key else F.count(F.lit(1))).alias("_seen"))
    return layer.join(F.broadcast(count)).filter(F.col("_seen") < limit).drop("_seen")


def fuse(index: Index, layers: dict[str, tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: chunk_id of the first layer that has a key, score, and each layer's part.

    The layers are a few limits of rows: the driver holds them, and only their chunks are read for the keys.
    """
    ranked = None
    for i, (name, (layer, weight)) in enumerate(layers.items()):
        part = layer.select("chunk_id", F.lit(name).alias("layer"), F.lit(i).alias("place"), (F.lit(float(weight)) / (k + F.col("rank") + 1)).alias("part"))
        ranked = part if ranked is None else ranked.unionByName(part)
    ranked = held(ranked)
    keyed = F.broadcast(ranked).join(_only(index, ranked).select("chunk_id", *[c for c in index.fuse_key if c != "chunk_id"]), "chunk_id")
    parts = [F.coalesce(F.sum(F.when(F.col("layer") == n, F.col("part"))), F.lit(0.0)).alias(n) for n in LAYERS]
    return keyed.groupBy(*index.fuse_key).agg(F.min_by("chunk_id", F.struct("place", "chunk_id")).alias("chunk"), F.sum("part").alias("score"), *parts).withColumnRenamed("chunk", "chunk_id" if not index.knowledge else "first_chunk").drop("first_chunk")


def _only(index: Index, rows: DataFrame) -> DataFrame:
    """The chunks of a held list: their ids are a filter that reaches the scan."""
    return index.chunks.filter(F.col("chunk_id").isin(*{r.chunk_id for r in rows.select("chunk_id").collect()}))


def proximity(content: Column, query: str) -> Column:
    """1.5 if the first places of all the query's words span less than 200 bytes, 1.2 below 500, else 1."""
    words = list(dict.fromkeys(query.lower().split()))
    if len(query.split()) < 2:
        return F.lit(1.0)
    low = F.lower(content)
    places = [T.first_byte(low, w) for w in words]
    every = F.lit(True)
    for p in places:
        every = every & p.isNotNull()
    span = F.greatest(*places) - F.least(*places) if len(places) > 1 else F.lit(0)
    return F.when(every & (span < 200), 1.5).when(every & (span < 500), 1.2).otherwise(1.0)


def hybrid(index: Index, query: str, settings: Settings, query_vector: list[float] | None = None, where: Column | None = None, keyword_weight: float | None = None, vector_weight: float | None = None, limit: int | None = None, full_recall: bool = False) -> DataFrame:
    """All layers, gated and fused: chunk columns with score, the layers' parts and the proximity part.

    Substrings are looked for if BM25 found less than the limit, corrected words if the fused keys still are fewer.  The vector layer
    ranks what keywords found, or everything if they found nothing (or full_recall is asked for).
    """
    n = limit or settings.limit
    kw = settings.keyword_weight if keyword_weight is None else keyword_weight
    vw = settings.vector_weight if vector_weight is None else vector_weight
    layers: dict[str, tuple[DataFrame, float]] = {"bm25": (held(bm25(index, query, n, where)), kw)}
    if layers["bm25"][0].count() < n:
        layers["trigram"] = (held(substring(index, query, n, where)), kw)
    fused = held(fuse(index, layers, settings.rrf_k))
    if fused.count() < n and (fixed := corrected_query(index, query, settings)) is not None:
        layers["fuzzy"] = (held(bm25(index, fixed, n, where)), kw)
        fused = held(fuse(index, layers, settings.rrf_k))
    if query_vector is not None and "embedding" in index.chunks.columns:
        among = None if full_recall or fused.isEmpty() else fused
        layers["vector"] = (held(vector(index, query_vector, n, where, among)), vw)
        fused = held(fuse(index, layers, settings.rrf_k))
    rows = F.broadcast(fused.drop(*[c for c in index.fuse_key if c != "chunk_id"])).join(_only(index, fused), "chunk_id")
    boost = F.lit(1.0) if index.knowledge else proximity(F.col("content"), query)
    rows = rows.withColumn("proximity", F.col("score") * (boost - 1)).withColumn("score", F.col("score") * boost)
    return rows.orderBy(F.round("score", 9).desc(), "source_id", "title", "chunk_id").limit(n)


#: Names of the parts in the order in which they are told.
PARTS = (("bm25", "bm25"), ("trigram", "trigram"), ("fuzzy", "fuzzy"), ("vector", "vector"), ("proximity", "proximity"), ("knowledge_bias", "knowledge-bias"), ("graph_boost", "graph"))
FLAGS = (("metadata_match", "metadata"), ("graph_neighbor", "graph-neighbor"), ("memory_query_hint", "memory-query"), ("memory_source_hint", "memory-source"), ("memory_filter_hint", "memory-filter"))


def why(df: DataFrame, detailed: bool = False) -> Column:
    """Which layers and marks made a result's score; with their values, if detailed."""
    told = []
    for column, name in PARTS:
        if column in df.columns:
            text = F.format_string(f"{name}=%.4f", F.col(column)) if detailed else F.lit(name)
            told.append(F.when(F.col(column) > 0, text))
    for column, name in FLAGS:
        if column in df.columns:
            told.append(F.when(F.col(column), F.lit(f"{name}=true" if detailed else name)))
    if detailed:
        return F.concat(F.lit("why: "), F.concat_ws(", ", *told, F.format_string("final=%.4f", F.col("score"))))
    line = F.concat_ws(", ", *told)
    return F.concat(F.lit("why: "), F.when(line == "", "ranking-defaults").otherwise(line))


def combined(first: DataFrame, second: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """Second-level fusion of two ranked lists (key, score): each key's sum of 1 / (k + rank)."""
    ranked = None
    for rows in (first, second):
        rank = F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "key"))
        part = rows.select("key", (1 / (F.lit(float(k)) + rank)).alias("part"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy("key").agg(F.sum("part").alias("score")).orderBy(F.round("score", 9).desc(), "key").limit(limit)


def result_size(results: DataFrame, inline_tokens: int = 20_000) -> DataFrame:
    """How much the results are, without them: chunks, bytes, tokens, sources, and whether to show or to hand over."""
    out = results.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("estimated_bytes"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("sources_matched"),
    )
    tokens = F.ceil(F.col("estimated_bytes") / 4).cast("long")
    return out.withColumn("estimated_tokens", tokens).withColumn("recommendation", F.when(F.col("estimated_tokens") <= inline_tokens, "inline").otherwise("delegate"))


def visible_bytes(results: DataFrame, settings: Settings) -> DataFrame:
    """Bytes that snippets of a result list (with rank from 1) show."""
    cap = F.when(F.col("rank") <= settings.top_results, settings.snippet_bytes).otherwise(settings.secondary_snippet_bytes)
    return results.agg(F.coalesce(F.sum(F.least(F.octet_length("content"), cap)), F.lit(0)).cast("long").alias("visible_bytes"))
