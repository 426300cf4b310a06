"""Toxic spans by a linear-chain conditional random field.

Documents are labelled, tokens are not: a token of a toxic document counts as toxic if a feature of it (a word, or its
first or last letters) occurs in toxic documents far more than in clean ones.  From these labelled tokens the field's
weights are learnt: a token's emission is the sum of the weights of all its features, in training as in scoring.
Forward-backward marginals give each document the chance that any token is toxic, the expected
count of toxic tokens and the offending offsets; a logistic curve, fitted to the labelled documents, makes the score.
Nothing depends on the order of rows or on a process's hash seed.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, near_dup

#: Bounds of the labelled sample: documents of each label.
SAMPLE_TOXIC = 2_000
SAMPLE_CLEAN = 3_000
#: A feature must be so much likelier in toxic documents (log odds ratio), by so many standard errors.
LEAST_ODDS = 2.3
LEAST_Z = 4.2
SURE_Z = 5.5
LEAST_DOCUMENTS = 3
WINDOW = 24
ROUNDS = 80

_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\S+")


def word_features(word: str) -> list[str]:
    """The word, its first 4 to 7 letters and its last 5, if it is longer."""
    found = ["=" + word]
    found += [f"{n}^" + word[:n] for n in (4, 5, 6, 7) if len(word) >= n]
    if len(word) > 5:
        found.append("$" + word[-5:])
    return found


def token_features(token: str) -> list[str]:
    """The features of all words in a token, each once, in their order."""
    words = _WORD.findall(token)
    if len(words) == 1:
        return word_features(words[0])
    return list(dict.fromkeys(f for word in words for f in word_features(word)))


def _distinct(texts: list[str]) -> np.ndarray:
    """Which texts are not mostly copies of an earlier one (by a sixteenth of the five-word shingles of long ones)."""
    words = near_dup.WordHashes()
    seen: set[int] = set()
    keep = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        h, _ = near_dup.shingles(text, words)
        its = set((h[h % np.uint64(16) == 0] if len(h) > 100 else h).tolist())
        keep[i] = not its or len(its & seen) < 0.3 * len(its)
        seen |= its
    return keep


def _telling(where: dict[str, set[int]], clean: Counter, n1: int, n0: int) -> dict[str, float]:
    """Features that tell toxic documents: those that do so beyond chance, and, the surest first, those that do so on
    documents that none before them explains."""

    def worth(f: str) -> tuple[float, float]:
        """How many standard errors a feature's share among toxic documents is above chance (by likelihood), and its log odds ratio."""
        a, c = len(where[f]), clean.get(f, 0)
        odds = math.log((a + 0.5) * (n0 - c + 0.5) / ((c + 0.5) * (n1 - a + 0.5)))
        expected = (a + c) * n1 / (n0 + n1)
        if a <= expected:
            return 0.0, odds
        gain = a * math.log(a / expected) + (c * math.log(c / (a + c - expected)) if c else 0.0)
        return math.sqrt(2 * max(gain, 0.0)), odds

    found = {f: odds for f in where for z, odds in [worth(f)] if z >= SURE_Z and odds >= LEAST_ODDS}
    queue = [(-z, f) for f in where if (z := worth(f)[0]) >= LEAST_Z]
    heapq.heapify(queue)
    explained: set[int] = set()
    while queue:
        _, f = heapq.heappop(queue)
        where[f] -= explained
        if len(where[f]) < LEAST_DOCUMENTS:
            continue
        z, odds = worth(f)
        if queue and -z > queue[0][0]:
            if z >= LEAST_Z:
                heapq.heappush(queue, (-z, f))
        elif z >= LEAST_Z and odds >= LEAST_ODDS:
            found[f] = odds
            explained |= where[f]
    return found


@dataclass
class Field:
    """Weights by feature, bias, log transitions [from][to] of states clean and toxic, and the document curve."""

    weights: dict[str, float]
    bias: float
    moves: np.ndarray
    curve: np.ndarray

    def emission(self, token: str) -> float:
        """Of the toxic state over the clean one, without the bias: the sum of the weights of the token's features."""
        weights = self.weights
        return sum([weights[f] for f in token_features(token) if f in weights])


class Emissions(dict):
    """Emission by token, remembered."""

    def __init__(self, field: Field, limit: int = 200_000):
        self.field, self.limit = field, limit

    def __missing__(self, token: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        self[token] = s = self.field.emission(token)
        return s


def marginals(emissions: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(tokens with an emission, their marginals, expected toxic tokens among them, log odds of any toxic token).

    Between tokens with an emission the recursion runs to its fixed point and then stays there, so only tokens around
    them are stepped through.  The chance of no toxic token is that of the one path that is clean throughout.
    """
    n, at = len(emissions), np.flatnonzero(emissions)
    if not len(at):
        return at, np.array([]), 0.0, -30.0
    (t00, t01), (t10, t11) = np.exp(field.moves).tolist()
    base = math.exp(field.bias)
    e = np.exp(np.clip(emissions[at].astype(float), -50.0, 50.0)).tolist()

    # Forward: the ratio at each token without its own emission; the token before the first has none.
    ratios, positions = [], [int(a) for a in at]
    r, last = None, -1
    log_rest = 0.0  # log of the sum over paths, relative to the clean path
    for p, f in zip(positions, e, strict=True):
        r, log_rest = _advance(r, last, p, base, t00, t01, t10, t11, log_rest)
        ratios.append(r)
        r *= f
        last = p
    _, total = _advance(r, last, n - 1, base, t00, t01, t10, t11, log_rest) if last < n - 1 else (r, log_rest)
    final = _advance(r, last, n - 1, base, t00, t01, t10, t11, log_rest)[0] if last < n - 1 else r
    log_z = total + math.log1p(final)
    # Backward: toxic : clean of all that follows each token.
    after, b, nxt = [], 1.0, n - 1
    for p, f in zip(reversed(positions), reversed(e), strict=True):
        b = _retreat(b, nxt, p, base, t00, t01, t10, t11)
        after.append(b)
        b, nxt = b * f, p
    odds = np.array(ratios) * np.array(e) * np.array(after[::-1])
    p = odds / (1 + odds)
    # P(clean path) = exp(-log_z).
    return at, p, float(p.sum()), math.log(max(math.expm1(min(log_z, 700.0)), 1e-13))


def _advance(r: float | None, last: int, to: int, base: float, t00: float, t01: float, t10: float, t11: float, log_rest: float) -> tuple[float, float]:
    """Ratio at token `to` with the bias alone, from that at token `last`."""
    if r is None:
        r, last = base, 0
    for k in range(last, to):
        s = (t00 + t10 * r) / t00
        new = base * (t01 + t11 * r) / (s * t00)
        log_rest += math.log(s)
        if abs(new - r) <= 1e-13 * r:
            return new, log_rest + (to - k - 1) * math.log(s)
        r = new
    return r, log_rest


def _retreat(b: float, nxt: int, to: int, base: float, t00: float, t01: float, t10: float, t11: float) -> float:
    """Ratio of what follows token `to`, from that of token `nxt` (with its emission, without the bias)."""
    for _ in range(nxt, to, -1):
        new = (t10 + t11 * base * b) / (t00 + t01 * base * b)
        if abs(new - b) <= 1e-13 * b:
            return new
        b = new
    return b


def describe(text: str, cache: Emissions, field: Field) -> tuple[float, np.ndarray, np.ndarray]:
    """Score, tokens with an emission and their marginals."""
    tokens = text.lower().split()
    emissions = np.fromiter(map(cache.__getitem__, tokens), np.float32, len(tokens))
    at, p, count, odds = marginals(emissions, field)
    z = field.curve @ np.array([1.0, np.clip(odds, -8, 8), math.log1p(count)])
    return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0))), at, p


def spans(text: str, at: np.ndarray, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Character offsets (start, end) of offending tokens, with their marginals."""
    wanted = {int(k): float(x) for k, x in zip(at, p, strict=True) if x >= least}
    if not wanted:
        return []
    return [{"start": m.start(), "end": m.end(), "p": wanted[k]} for k, m in enumerate(_TOKEN.finditer(text)) if k in wanted]


def window_starts(centres: list[int], n: int) -> list[int]:
    """Starts of windows that cover half a window on both sides of every centre among n tokens, none twice."""
    starts, end = [], 0
    for i in centres:
        while end < min(n, i + WINDOW // 2):
            starts.append(max(end, i - WINDOW // 2))
            end = starts[-1] + WINDOW
    return starts


def train(texts: list[str], toxic: list[int], rate: float | None = None) -> Field:
    """A field from labelled documents; texts that mostly repeat others are left out of counts.

    `rate` is the share of toxic documents where the sample was drawn from, if it was drawn by label.
    """
    y = np.array(toxic, int)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    shift = 0.0 if rate is None else math.log(rate / (1 - rate)) - math.log(prior / (1 - prior))
    flat = Field({}, -8.0, np.zeros((2, 2)), np.array([math.log(prior / (1 - prior)), 0.0, 0.0]))
    if not y.any() or y.all():
        return flat
    own = _distinct(texts)
    where: dict[str, list[int]] = {}
    for i in np.flatnonzero(own & (y == 1)).tolist():
        for f in {f for w in set(_WORD.findall(texts[i].lower())) for f in word_features(w)}:
            where.setdefault(f, []).append(i)
    where = {f: at for f, at in where.items() if len(at) >= LEAST_DOCUMENTS}
    clean: Counter = Counter()  # of features that toxic documents have
    for i in np.flatnonzero(own & (y == 0)).tolist():
        clean.update({f for w in set(_WORD.findall(texts[i].lower())) for f in word_features(w) if f in where})
    strength = _telling({f: set(at) for f, at in where.items()}, clean, int((own & (y == 1)).sum()), int((own & (y == 0)).sum()))
    if not strength:
        return flat
    # Labelled tokens, in windows around those of toxic documents and from clean ones.
    index = {f: i for i, f in enumerate(sorted(strength))}
    feature: list[int] = []
    token: list[int] = []
    ys: list[np.ndarray] = []
    rng = np.random.default_rng(7)
    known: dict[str, list[int]] = {}
    for text, label, ok in zip(texts, y, own, strict=True):
        tokens = text.lower().split()
        if not tokens or not (ok or label == 0):
            continue
        for t in tokens:
            if t not in known:
                known[t] = [index[f] for f in token_features(t) if f in index]
        marks = [known[t] for t in tokens]
        starts = window_starts([i for i, m in enumerate(marks) if m], len(tokens))
        starts.append(int(rng.integers(0, max(1, len(tokens) - WINDOW + 1))))
        for s in starts:
            t = np.zeros(WINDOW, np.int8)
            for k, m in enumerate(marks[s : s + WINDOW]):
                if m:
                    feature += m
                    token += [len(ys) * WINDOW + k] * len(m)
                    t[k] = label == 1
            ys.append(t)
    weights, bias, moves = _fit(np.array(feature, np.int64), np.array(token, np.int64), np.array(ys), len(index))
    field = Field({f: float(weights[i]) for f, i in index.items() if weights[i]}, bias, moves, np.zeros(3))
    # The document curve.
    field.curve = np.array([0.0, 1.0, 0.0])
    cache = Emissions(field)
    rows = []
    for text in texts:
        tokens = text.lower().split()
        _, _, count, odds = marginals(np.fromiter(map(cache.__getitem__, tokens), np.float32, len(tokens)), field)
        rows.append((1.0, np.clip(odds, -8, 8), math.log1p(count)))
    field.curve = logistic(np.array(rows), y.astype(float), 1.0) + np.array([shift, 0.0, 0.0])
    return field


def _fit(feature: np.ndarray, token: np.ndarray, y: np.ndarray, n_features: int, ridge: float = 0.02) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights by Adagrad on the log likelihood of label sequences, a row of y each; entry k says that `feature[k]` holds at place
    `token[k]` of y, read row by row."""
    w, bias, moves = np.zeros(n_features), -3.0, np.zeros((2, 2))
    gw, gb, gm = np.full(n_features, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    n, length = y.shape
    pairs = np.array([[np.sum((y[:, :-1] == a) & (y[:, 1:] == b)) for b in (0, 1)] for a in (0, 1)], float)
    for _ in range(ROUNDS):
        s = np.bincount(token, w[feature], y.size).reshape(y.shape) + bias
        p, expect = _expected(np.exp(np.clip(s, -50, 50)).T, np.exp(moves))
        d = y - p.T
        dw = np.bincount(feature, d.ravel()[token], n_features) - ridge * w
        dm, db = pairs - expect - ridge * moves, d.sum() - ridge * bias
        gw, gb, gm = gw + dw**2, gb + db**2, gm + dm**2
        w, bias, moves = w + 0.6 * dw / np.sqrt(gw), bias + 0.6 * db / math.sqrt(gb), moves + 0.3 * dm / np.sqrt(gm)
    return w, float(bias), moves


def _expected(e: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences (columns of e, factors of the toxic state): marginals and the expected moves, by scaled forward-backward."""
    length, n = e.shape
    toxic = np.empty((length, n))  # forward shares of the toxic state
    toxic[0] = e[0] / (1 + e[0])
    for t in range(1, length):
        c, x = 1 - toxic[t - 1], toxic[t - 1]
        clean, tox = c * m[0, 0] + x * m[1, 0], (c * m[0, 1] + x * m[1, 1]) * e[t]
        toxic[t] = tox / (clean + tox)
    p, expect = np.empty((length, n)), np.zeros((2, 2))
    b0, b1 = np.ones(n), np.ones(n)
    for t in range(length - 1, -1, -1):
        c, x = (1 - toxic[t]) * b0, toxic[t] * b1
        p[t] = x / (c + x)
        if t:
            c, x = 1 - toxic[t - 1], toxic[t - 1]
            to0, to1 = b0, e[t] * b1
            four = [[c * m[0, 0] * to0, c * m[0, 1] * to1], [x * m[1, 0] * to0, x * m[1, 1] * to1]]
            z = four[0][0] + four[0][1] + four[1][0] + four[1][1]
            expect += np.array([[(v / z).sum() for v in row] for row in four])
            b0, b1 = m[0, 0] * to0 + m[0, 1] * to1, m[1, 0] * to0 + m[1, 1] * to1
            scale = b0 + b1
            b0, b1 = b0 / scale, b1 / scale
    return p, expect


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights by Newton steps; the first column, the constant, is not held down."""
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo `folds`, is 0 (null: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """A field from a bounded sample of the labelled documents that are in docs and aren't held out; so is their share of toxic ones."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
    known = known.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    rate = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionAll(known.filter("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN)).dropDuplicates(["doc_id"])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The sample is bounded by its two parameters, so it may be broadcast and collected.
    got = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").limit(4 * (SAMPLE_TOXIC + SAMPLE_CLEAN)).collect()
    got.sort(key=lambda r: (r.doc_id, r.text or ""))
    field = train([r.text or "" for r in got], [r.toxic for r in got], rate)
    del got
    blocks.release()
    return field


def score(df: DataFrame, field: Field, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default), score double, predicted int and spans (start, end, p) of each whole text.

    Null and empty texts get the score of a text without any toxic token.  Rows that repeat are each scored.  Columns score,
    predicted and spans of df are replaced.
    """
    blocks.session_limits(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score", "predicted", "spans")]
    rows = df.select(*blocks.numbered(keep), blocks.column(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Emissions(field)
        for batch in batches:
            scores, found = [], []
            for text in batch.column(len(keep)).to_pylist():
                x, at, p = describe(text or "", cache, field)
                scores.append(x)
                found.append(spans(text or "", at, p))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))], [*batch.schema.names[:-1], "score", "predicted", "spans"])
        cache.clear()
        blocks.release()

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    out = rows.mapInArrow(run, ", ".join([*kinds, "score double, predicted int, spans array<struct<start: int, end: int, p: double>>"]))
    return out.select(*blocks.named(keep), "score", "predicted", "spans")


def reject(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of df, unchanged, whose text isn't predicted toxic."""
    blocks.session_limits(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Emissions(field)
        for batch in batches:
            ok = [describe(t or "", cache, field)[0] < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(ok, pa.bool_()))
        cache.clear()
        blocks.release()

    rows = df.select(*blocks.numbered(df.columns))
    return rows.mapInArrow(run, rows.schema).select(*blocks.named(df.columns))
