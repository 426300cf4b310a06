"""Quality by hierarchical empirical Bayes: a document classifier's evidence under site priors.

An additive logistic model of plain text measures, each cut into quantile bins, is fitted to a bounded sample of labelled
documents.  Its probabilities over all documents give each host, and each path of a host, a mean; the means are shrunk,
paths to their host's and hosts to the global one, by as much as the spread between sites (by the method of moments) is
less than chance alone would make.  A document's log odds are the classifier's, with the global prior replaced by that of its
path, which the path's, host's and all other documents make: the document's own evidence is left out of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, toxicity

#: The labelled sample's bound, and bins for each measure.
SAMPLE = 5_000
BINS = 10
#: At most so many sites are broadcast: all, or those that hold more than their part of the rows; the rest is joined by shuffles.
BROADCAST_SITES = 20_000

MEASURES = ("log_words", "word_length", "distinct_words", "top_word", "upper", "digits", "marks", "stars", "bars", "shouts", "stops", "lines", "other_bytes", "dup_lines", "long_words")


def measures(text: str) -> list[float]:
    """Plain measures of a text; an empty one has zeros."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(MEASURES)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    m = max(1, len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, int(h[65:91].sum() + h[97:123].sum() + h[128:].sum()))
    return [
        math.log1p(len(words)),
        n / m,
        math.log(max(1, len(seen))) / math.log(m + 1),
        max(seen.values(), default=0) / m,
        int(h[65:91].sum()) / letters,
        int(h[48:58].sum()) / n,
        int(h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()) / n,
        int(h[35:39].sum() + h[42]) / n,
        int(h[124] + h[95] + h[61] + h[126]) / n,
        int(h[33]) / m,
        int(h[46] + h[63]) / m,
        int(h[10]) / m,
        int(h[128:].sum()) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in seen.items() if len(w) > 18) / m,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def rows(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.weights)))
        out[:, 0] = 1
        at = 1
        for j, e in enumerate(self.edges):
            out[np.arange(len(x)), at + np.searchsorted(e, x[:, j], side="left")] = 1
            at += len(e) + 1
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality; the same as rows(x) @ weights, without the wide matrix."""
        z, at = np.full(len(x), self.weights[0]), 1
        for j, e in enumerate(self.edges):
            z += self.weights[at + np.searchsorted(e, x[:, j], side="left")]
            at += len(e) + 1
        return np.clip(z, -12, 12)


def train(texts: list[str], good: list[int]) -> Model:
    """The classifier; with one label only, or none, the constant model of that prior."""
    y = np.array(good, float)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        return Model([], np.array([math.log(prior / (1 - prior))]), prior)
    x = np.array([measures(t) for t in texts])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # The rare class has its own finer cuts, since what marks it may lie within one bin of all.
    rare = x[y == (y.mean() < 0.5)]
    edges = [np.unique(np.concatenate([e, np.quantile(rare[:, j], [0.1, 0.3, 0.5, 0.7, 0.9])])) for j, e in enumerate(edges)]
    model = Model(edges, np.zeros(1 + sum(len(e) + 1 for e in edges)), prior)
    model.weights = toxicity.logistic(model.rows(x), y, 0.3)
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The classifier from a bounded sample of the labelled documents that are in docs and aren't held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("good")).filter(F.col("doc_id").isNotNull() & F.col("good").isin(0, 1) & ~toxicity.held_out("doc_id"))
    known = known.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).dropDuplicates(["doc_id"])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The sample is bounded by its parameter, so it may be broadcast and collected.
    got = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "good").limit(4 * SAMPLE).collect()
    got.sort(key=lambda r: (r.doc_id, r.text or ""))
    model = train([r.text or "" for r in got], [r.good for r in got])
    del got
    blocks.release()
    return model


def evidence(df: DataFrame, model: Model, host: Column, path: Column, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default), numbered, with __host, __path and __logit, the classifier's log odds of good quality."""
    blocks.session_limits(df.sparkSession)
    keep = df.columns if keep is None else keep
    none = F.lit("")
    rows = df.select(*blocks.numbered(keep), F.coalesce(host.cast("string"), none).alias("__host"), F.coalesce(path.cast("string"), none).alias("__path"), blocks.column(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measures(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.logits(x), pa.float64())], [*batch.schema.names[:-1], "__logit"])
        blocks.release()

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*kinds, "__logit double"]))


@dataclass
class Priors:
    """All rows and the sum of their probabilities, how many sites there are, and the priors' weights in documents (infinite where
    sites differ no more than chance would have it)."""

    rows: float
    total: float
    sites: int
    host_strength: float
    path_strength: float


def site_priors(scored: DataFrame) -> tuple[DataFrame, Priors]:
    """(__host, __path, __n, __s, __hn, __hs): rows and sums of probabilities of each path and its host; and the priors."""
    p = 1 / (1 + F.exp(-F.col("__logit")))
    paths = blocks.settle(scored.groupBy("__host", "__path").agg(F.count(F.lit(1)).cast("double").alias("__n"), F.sum(p).alias("__s")), "sites")
    hosts = paths.groupBy("__host").agg(F.sum("__n").alias("__hn"), F.sum("__s").alias("__hs"), F.count(F.lit(1)).cast("double").alias("k"), F.sum(F.col("__n") ** 2).alias("n2"), F.sum(F.col("__s") ** 2 / F.col("__n")).alias("m2"))
    hn, hs = F.col("__hn"), F.col("__hs")
    t = hosts.agg(F.sum(hn).alias("n"), F.sum(hs).alias("s"), F.sum("k").alias("k"), F.sum("m2").alias("m2"), F.count(F.lit(1)).alias("hosts"), F.sum(hn**2).alias("h2"), F.sum(hs**2 / hn).alias("hm2"), F.sum(F.col("n2") / hn).alias("n2h")).first()
    out = paths.join(hosts.select("__host", "__hn", "__hs"), "__host")
    if not t.n:
        return out, Priors(0.0, 0.0, 0, math.inf, math.inf)
    mean = t.s / t.n
    within = mean * (1 - mean)

    def strength(spread: float, groups: float, scale: float) -> float:
        between = (spread - groups * within) / scale if scale > 0 else 0.0
        return max(0.0, within / between - 1) if between > 1e-12 else math.inf

    return out, Priors(t.n, t.s, int(t.k), strength(t.hm2 - t.n * mean**2, t.hosts - 1, t.n - t.h2 / t.n), strength(t.m2 - t.hm2, t.k - t.hosts, t.n - t.n2h))


def with_posteriors(scored: DataFrame, sites: DataFrame, priors: Priors) -> DataFrame:
    """`scored` with __host_posterior, __path_posterior and __score: the chance of good quality under the path's prior without this row."""
    keys = ["__host", "__path"]
    if priors.sites <= BROADCAST_SITES:
        joined = scored.join(F.broadcast(sites), keys)
    else:
        # A site may hold a third of all rows.  Those above their part of the rows are no more than BROADCAST_SITES.
        part = max(1.0, priors.rows / max(1, BROADCAST_SITES))
        hot, cold = sites.filter(F.col("__n") > part), sites.filter(F.col("__n") <= part)
        rest = scored.join(F.broadcast(hot.select(keys)), keys, "left_anti")
        joined = scored.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))

    def odds(p: Column) -> Column:
        held = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
        return F.log(held / (1 - held))

    def shrunk(total: str, n: str, prior: Column, k: float) -> Column:
        if math.isinf(k):
            return prior
        weight = F.col(n) - 1 + k
        return F.when(weight > 0, (F.col(total) - own + k * prior) / weight).otherwise(prior)

    own = 1 / (1 + F.exp(-F.col("__logit")))
    mean = (F.lit(priors.total) - own) / (priors.rows - 1) if priors.rows > 1 else F.lit(0.5)
    out = joined.withColumn("__host_posterior", shrunk("__hs", "__hn", mean, priors.host_strength))
    out = out.withColumn("__path_posterior", shrunk("__s", "__n", F.col("__host_posterior"), priors.path_strength))
    return out.withColumn("__score", 1 / (1 + F.exp(-(F.col("__logit") + odds(F.col("__path_posterior")) - odds(mean)))))


def classify(df: DataFrame, model: Model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted (1: good), host_posterior and path_posterior of each row.

    Null and empty texts are scored as a text without words; null hosts and paths are a site of their own, ''.  Rows that
    repeat are each scored.  Where all labels agree, or there are none, scores are that prior's.  A lone row of its path has its
    host's posterior, a lone row of its host the mean of all others, a lone row of all 0.5.
    """
    scored = blocks.settle(evidence(df, model, host, path, text_col, [id_col]), "evidence")
    out = with_posteriors(scored, *site_priors(scored))
    return out.select(F.col("c_0").alias("doc_id"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"), F.col("__host_posterior").alias("host_posterior"), F.col("__path_posterior").alias("path_posterior"))


def reject(df: DataFrame, model: Model, host: Column, path: Column, text_col: str = "text") -> DataFrame:
    """The rows of df, all their columns unchanged whatever their names, that aren't predicted to be of bad quality.

    Each text is measured once: rows and evidence are written to the shared folder, and only the evidence is read for the sites.
    """
    scored = blocks.settle(evidence(df, model, host, path, text_col), "evidence")
    out = with_posteriors(scored, *site_priors(scored.select("__host", "__path", "__logit")))
    return out.filter("__score >= 0.5").select(*blocks.named(df.columns))


def document_site() -> tuple[Column, Column]:
    """Host and path of `documents`: the source, and its part in one language."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))


def url_site(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: the host name, and the host with its first path segment."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return host, F.concat_ws("/", host, F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*/([^/?#]*)", 1))
