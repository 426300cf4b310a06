"""The whole hybrid search, all four layers and their gates, against a plain version of it."""

import math
import random
import re

import pytest

from sievelight.config import Settings
from sievelight.functions import porter
from sievelight.operators import search
from sievelight.operators.indexing import Index

WORDS = "reed heat thing river harbour lantern copper meadow signal anchor running heating".split()


def corpus(n=40):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 12)))
        text = text if rng.random() < 0.8 else text + " " + "x " * 300 + rng.choice(WORDS)
        rows.append((i, i % 7, "s", f"title {i % 5}", text, "prose", 1, 1, [rng.uniform(-1, 1) for _ in range(4)]))
    return rows


COLUMNS = "chunk_id long, source_id long, label string, title string, content string, content_type string, line_start int, line_end int, embedding array<float>"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def ranked(scores, n):
    return [k for _, k in sorted((-round(s, 9), k) for k, s in scores.items() if s > 0)][:n]


def gain(n, df, tf, dl, avg):
    idf = math.log((n - df + 0.5) / (df + 0.5))
    return (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))


def bm25(rows, query, n, stem):
    word = porter.stem if stem else str
    words = {r[0]: [word(w) for w in re.findall("[a-z0-9]+", f"{r[3]} {r[4]} {r[5]}")] for r in rows}
    terms = [word(w) for w in re.findall("[a-z0-9]+", query.lower())]
    avg = sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for t in terms}
    return ranked({k: sum(gain(len(words), df[t], w.count(t), len(w), avg) for t in terms) for k, w in words.items() if all(t in w for t in terms)}, n) if terms else []


def phrase(rows, query, n):
    query = query.lower()
    if len(query) < 3:
        return []
    cols = {r[0]: [r[3].lower(), r[4].lower(), r[5]] for r in rows}
    tf = {k: sum(c.count(query) for c in v) for k, v in cols.items()}
    dl = {k: sum(max(0, len(c) - 2) for c in v) for k, v in cols.items()}
    df, avg = sum(x > 0 for x in tf.values()), sum(dl.values()) / len(dl)
    return ranked({k: gain(len(rows), df, tf[k], dl[k], avg) for k in tf if tf[k]}, n)


def plain(rows, query, vector, n, stem):
    by = {r[0]: r for r in rows}
    word = porter.stem if stem else str
    layers = [(bm25(rows, query, n, stem), 1.0)]
    if len(layers[0][0]) < n:
        layers.append((phrase(rows, query, n), 1.0))

    def fused():
        score, chunk = {}, {}
        for found, weight in layers:
            for place, k in enumerate(found):
                key = by[k][1], by[k][3]
                score[key] = score.get(key, 0) + weight / (61 + place)
        for found, _ in layers:
            for k in sorted(found):
                chunk.setdefault((by[k][1], by[k][3]), k)
        return {chunk[key]: s for key, s in score.items()}

    if len(fused()) < n:
        vocabulary = {word(w) for r in rows for w in re.findall("[a-z0-9]+", r[4])}
        fixed = " ".join(min(((distance(w, t), t) for t in vocabulary if distance(w, t) <= 2), default=(0, w))[1] for w in query.split())
        if fixed != query:
            layers.append((bm25(rows, fixed, n, stem), 1.0))
    if vector:
        among = fused() or by
        dots = sorted((-round(sum(a * b for a, b in zip(by[k][8], vector, strict=True)), 6), k) for k in among)
        layers.append(([k for _, k in dots][:n], 1.0))
    out = {}
    for k, s in fused().items():
        words, text = list(dict.fromkeys(query.lower().split())), by[k][4].lower()
        places = [text.find(w) for w in words]
        span = max(places) - min(places) if places and min(places) >= 0 else None
        boost = 1.0 if len(query.split()) < 2 or span is None else 1.5 if span < 200 else 1.2 if span < 500 else 1.0
        out[k] = s * boost
    order = sorted(out, key=lambda k: (-round(out[k], 9), by[k][1], by[k][3], k))[:n]
    return [(k, round(out[k], 8)) for k in order]


@pytest.mark.parametrize("stem", [False, True])
def test_hybrid_against_a_plain_version(spark, stem):
    rows = corpus()
    rows = [(*r[:8], [float(f"{x:.3f}") for x in r[8]]) for r in rows]
    index = Index(spark.createDataFrame(rows, COLUMNS), stem=stem)
    for query, vector, n in (("reed", None, 3), ("reed heat", [1.0, 0.0, 0.5, 0.0], 8), ("reeed heaat", None, 8), ("lantrn", [0.0, 1.0, 0.0, 0.0], 5), ("qqqqqqqq", [0.0, 0.0, 1.0, 0.0], 4), ("heat thing", None, 15), ("runs heats", None, 15), ("eed he", None, 6)):
        got = search.hybrid(index, query, Settings(limit=n, fuzzy_terms=None), vector).collect()
        assert [(r.chunk_id, round(r.score, 8)) for r in got] == plain(rows, query, vector, n, stem), query
