"""Models by held-out accuracy, fingerprints and search by brute force, pages by hand-made ones."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import ctph, html_main, maxscore, quality, toxicity

from .conftest import ODD

WORDS = [f"{a}{b}" for a in ("lor", "mip", "sun", "tar", "wen", "gol") for b in ("a", "ed", "ing", "o", "ment", "ly")]


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


# --- fingerprints


def test_fingerprint_changes_little_with_an_edit():
    rng = random.Random(1)
    text = " ".join(words(rng, 3000))
    cut = text[:5000] + " inserted here " + text[5000:]
    f, g = ctph.fingerprint(text), ctph.fingerprint(cut)
    assert ctph.likeness(f, f) == 1 and ctph.likeness(f, g) > 0.9
    assert ctph.likeness(f, ctph.fingerprint(" ".join(words(random.Random(2), 3000)))) < 0.3
    assert ctph.fingerprint("") == "3::" and ctph.likeness("3::", "3::") == 1 and ctph.likeness("3::", f) == 0


def test_short_signatures_are_compared_by_edits():
    assert ctph._likeness("ABCDE", "ABXDE") == 0.8 and ctph._likeness("ABC", "ABCDEFGH") == 6 / 11 and ctph._likeness("ABC", "XYZ") == 0
    assert ctph._likeness("ABCDEFGH", "ABCXEFGH") == 0  # long enough, and no run of seven
    a, b = "one two", "one two three"
    assert 0 < ctph.likeness(ctph.fingerprint(a), ctph.fingerprint(b)) < 1


def test_rolling_hash_over_parts_and_as_a_whole(monkeypatch):
    data = bytes(random.Random(3).randrange(256) for _ in range(5000))
    whole = ctph.triggers(data)
    monkeypatch.setattr(ctph, "_PART", 64)
    assert all((a == b).all() for a, b in zip(whole, ctph.triggers(data), strict=True))
    for end, power in zip(*whole, strict=True):  # by the definition of the hash
        window = data[max(0, end - 7) : end]
        h1, h2, h3 = sum(window), sum((7 - k) * c for k, c in enumerate(reversed(window))), 0
        for k, c in enumerate(reversed(window)):
            h3 ^= (c << 5 * k) & 0xFFFFFFFF
        h = (h1 + h2 + h3) & 0xFFFFFFFF
        assert (h + 1) % (3 * 2**power) == 0 and (h + 1) % (3 * 2 ** (power + 1)) != 0


def test_common_length():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("ABC") for _ in range(rng.randint(0, 30))) for _ in "ab")
        assert ctph.common_length(a, b) == lcs(a, b)


@pytest.mark.parametrize("cuts", [None, [3, 5, 8], list(range(1, 12))])
def test_neighbours(frame, monkeypatch, cuts):
    docs = [r for r in ODD if r[0] != 7] + [(7, "one"), (11, "ab" * 500)]
    if cuts:
        monkeypatch.setattr(ctph.blocks, "splitters", lambda *a: np.array(cuts))
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for (i, t), (_, o) in zip(order, order[1:] + order[:1], strict=True):
        t, o = t or "", o or ""
        new = ctph.edited(t, o)
        f = ctph.fingerprint(t)
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), f, ctph.fingerprint(new), ctph.likeness(f, ctph.fingerprint(new)), ctph.likeness(f, ctph.fingerprint(o))))
    assert sorted(map(repr, map(tuple, ctph.compare_neighbours(frame(docs)).collect()))) == sorted(map(repr, want))
    assert ctph.compare_neighbours(frame([])).count() == 0
    lone = ctph.compare_neighbours(frame([(1, "abc")])).first()
    assert lone.near_next == 1


# --- search


def test_search(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)], f"l{i}") for i in range(300)]
    rows += [(400, None, ""), (401, [1.0, None], ""), (402, [float("nan")], ""), (403, [float("inf")] * 8, ""), (404, [], ""), (405, [0.5] * 3, ""), (20, rows[20][1], "again"), (None, [1.0] * 8, "")]
    rows += [(500 + i, rows[3][1], "tie") for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")
    took = [(i, np.floor(64 * np.pad(np.array(v), (0, 8 - len(v)))).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in took if i % 20 == 0}):
        v = next(x for i, x in took if i == q)
        best = sorted(((-int(v @ x), i) for i, x in took if i != q))[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    got = maxscore.search(df, F.col("vec_id") % 20 == 0, 20).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert maxscore.search(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_pruning_loses_nothing():
    rng = np.random.default_rng(7)
    rows = np.floor(rng.normal(size=(6000, 24)) * 20 * np.geomspace(1, 0.02, 24))
    shard = maxscore.Shard(np.arange(6000), rows)
    for q in rows[:20]:
        scores = rows @ q
        best = np.lexsort((np.arange(6000), -scores))
        best = best[best != 5][:20]
        ids, found = shard.top(5, q, 20)
        assert ids.tolist() == best.tolist() and found.tolist() == scores[best].tolist()


# --- pages


def test_pages(spark):
    long = " ".join(["plain words of an article"] * 9)
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href='/'>Site</a> name</header><nav><ul><li><a href='/a'>A</a></li></ul></nav>"
        f"<!-- <p>no</p> --><div class='cookie-banner'>We use cookies</div><main><h1>Head &amp; line</h1><p>{long}<br>more&nbsp;&lt;b&gt; \n text<script>if (a<b) x('</p>')</script></p><p>Short.</p>"
        f"<div class='ad'>Buy now</div><p>{long}</p><form><p>Name</p><textarea>typed</textarea></form></main><aside>{long}</aside><section id='comments'><p>{long}</p></section><footer>&copy; me</footer><p"
    )
    want = f"Head & line {long} more <b> text Short. {long}"
    rows = [(1, "u1", page), (2, "u2", None), (3, "u3", ""), (4, "u4", "<nav><a href='/x'>only</a> menu</nav>"), (1, "u1", page), (None, None, "no markup at all")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_main.extract(df).collect()
    assert [r.text for r in got if r.page_id == 1] == [want, want] and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (2, 3, 4)] == ["", "", ""]
    assert html_main.extract(df.limit(0)).count() == 0


# --- toxicity


def labelled(seed=9, n=700):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        t = words(rng, rng.randint(5, 80))
        bad = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) if bad else 0):
            t[rng.randrange(len(t))] = rng.choice(["Zorgle!", "zorgling", "vashik", "vashikment,", "vashiko"])
        texts.append(" ".join(t))
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def field():
    return toxicity.train(*labelled())


def test_held_out_toxicity(field):
    texts, labels = labelled(10, 300)
    cache = toxicity.Emissions(field)
    scores = np.array([toxicity.describe(t, cache, field)[0] for t in texts])
    assert ((scores >= 0.5) == np.array(labels)).mean() > 0.98


def test_windows_hold_every_marked_token(monkeypatch):
    rng = random.Random(1)
    for n in (1, 5, 24, 500):
        for centres in ([], [0], [n - 1], sorted(rng.sample(range(n), n // 2)), list(range(n))):
            starts = toxicity.window_starts(centres, n)
            held = [k for s in starts for k in range(s, s + toxicity.WINDOW) if k < n]
            assert len(held) == len(set(held))
            assert {k for i in centres for k in range(max(0, i - 12), min(n, i + 12))} <= set(held)
    seen = []
    fit = toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda feature, token, y, n: seen.append(int(y.sum())) or fit(feature, token, y, n))
    texts, labels = labelled()
    many = " ".join(f"zorgle {' '.join(words(rng, 60))}" for _ in range(40))
    for extra in ([], [many]):
        toxicity.train([*texts, *extra], [*labels, *[1] * len(extra)])
    assert seen[1] - seen[0] >= 40


def test_gradient_by_all_paths():
    rng = np.random.default_rng(21)
    s, moves = rng.normal(0, 2, (3, 5)), rng.normal(0, 1, (2, 2))
    p, expect = toxicity._expected(np.exp(s).T, np.exp(moves))
    want, pairs = np.zeros((3, 5)), np.zeros((2, 2))
    for k in range(3):
        paths = [[path >> t & 1 for t in range(5)] for path in range(32)]
        w = np.array([math.exp(sum(s[k, t] * y[t] for t in range(5)) + sum(moves[y[t], y[t + 1]] for t in range(4))) for y in paths])
        w /= w.sum()
        want[k] = w @ np.array(paths)
        for y, x in zip(paths, w, strict=True):
            for t in range(4):
                pairs[y[t], y[t + 1]] += x
    assert np.allclose(p.T, want) and np.allclose(expect, pairs)


def test_scores_of_a_fold_by_the_plain_recursion(spark, frame):
    """The whole way from labelled rows to held-out scores, against dense forward-backward sums over every token."""
    texts, labels = labelled(22, 260)
    docs = frame(list(enumerate(texts)))
    known = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    field = toxicity.learn(docs, known)
    kept = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    rate = (sum(labels[i] for i in kept) + 0.5) / (len(kept) + 1)
    again = toxicity.train([texts[i] for i in kept], [labels[i] for i in kept], rate)
    assert again.weights == field.weights and (again.curve == field.curve).all()
    scores = {r.doc_id: r.score for r in toxicity.score(docs, field, keep=["doc_id"]).collect()}
    assert len(scores) == len(texts)
    for i in set(range(len(texts))) - set(kept):
        s = np.array([field.bias + sum(field.weights.get(f, 0.0) for f in dict.fromkeys(f for w in re.findall(r"\w+", t) for f in toxicity.word_features(w))) for t in texts[i].lower().split()])
        alpha, beta = np.zeros((len(s), 2)), np.zeros((len(s), 2))
        alpha[0] = [0, s[0]]
        for t in range(1, len(s)):
            alpha[t] = [np.logaddexp(alpha[t - 1, 0] + field.moves[0, b], alpha[t - 1, 1] + field.moves[1, b]) + b * s[t] for b in (0, 1)]
        for t in range(len(s) - 2, -1, -1):
            beta[t] = [np.logaddexp(beta[t + 1, 0] + field.moves[a, 0], beta[t + 1, 1] + s[t + 1] + field.moves[a, 1]) for a in (0, 1)]
        z = np.logaddexp(*alpha[-1])
        some = s != field.bias  # tokens without a feature don't count towards the expected number
        count = np.exp(alpha[:, 1] + beta[:, 1] - z)[some].sum()
        odds = math.log(max(math.expm1(z - field.moves[0, 0] * (len(s) - 1)), 1e-13)) if some.any() else -30.0
        x = field.curve @ np.array([1.0, np.clip(odds, -8, 8), math.log1p(count)])
        assert abs(scores[i] - 1 / (1 + math.exp(-x))) < 1e-6
    assert np.mean([(scores[i] >= 0.5) == labels[i] for i in set(range(len(texts))) - set(kept)]) > 0.9


def test_scores_do_not_hang_on_the_hash_seed():
    """Near copies, whose counting hangs on their shingles' hashes, in processes with different seeds."""
    code = (
        "import sys; sys.path.insert(0, %r)\nimport random\nfrom sievelight.llm import toxicity\nrng = random.Random(5)\n"
        "base = [' '.join(rng.choice('lor mip sun tar wen gol vash zorg'.split()) + str(rng.randrange(40)) for _ in range(150)) for _ in range(20)]\n"
        "texts = [t.replace('7', str(k), 3 * k) + (' vashik zorgle' if i %% 4 == 0 else '') for i, t in enumerate(base) for k in range(4)]\n"
        "f = toxicity.train(texts, [int('vashik' in t) for t in texts])\nc = toxicity.Emissions(f)\n"
        "print(toxicity._distinct(texts).tolist(), [repr(toxicity.describe(t, c, f)[0]) for t in texts])\n"
    ) % os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = [subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": seed}, capture_output=True, text=True, check=True).stdout for seed in ("0", "1", "77")]
    assert said[0] == said[1] == said[2] and said[0].startswith("[True")


def test_marginals_by_all_paths(field):
    rng = np.random.default_rng(11)
    for _ in range(30):
        e = np.where(rng.random(9) < 0.4, rng.normal(3, 2, 9), 0.0)
        weights = np.zeros((9, 2))
        total = clean = 0.0
        for path in range(2**9):
            y = [path >> k & 1 for k in range(9)]
            w = math.exp(sum((e[k] + field.bias) * y[k] for k in range(9)) + sum(field.moves[y[k], y[k + 1]] for k in range(8)))
            total += w
            clean += w if path == 0 else 0
            for k in range(9):
                weights[k, y[k]] += w
        at, p, count, odds = toxicity.marginals(e, field)
        assert np.allclose(p, (weights[:, 1] / total)[at], atol=1e-9)
        if len(at):
            assert abs(odds - math.log((total - clean) / clean)) < 1e-6 and abs(count - p.sum()) < 1e-12


def test_long_gaps_match_the_plain_recursion(field):
    e = np.zeros(3000)
    e[[10, 900, 2999]] = [2.0, 5.0, 1.0]
    at, p, _, odds = toxicity.marginals(e, field)
    s, m = e + field.bias, field.moves
    alpha, beta = np.zeros((3000, 2)), np.zeros((3000, 2))
    alpha[0] = [0, s[0]]
    for t in range(1, 3000):
        alpha[t] = [np.logaddexp(alpha[t - 1, 0] + m[0, b], alpha[t - 1, 1] + m[1, b]) + b * s[t] for b in (0, 1)]
    for t in range(2998, -1, -1):
        beta[t] = [np.logaddexp(beta[t + 1, 0] + m[a, 0], beta[t + 1, 1] + s[t + 1] + m[a, 1]) for a in (0, 1)]
    z = np.logaddexp(*alpha[-1])
    assert np.allclose(p, np.exp(alpha[at, 1] + beta[at, 1] - z), atol=1e-8)
    clean = 2999 * m[0, 0]
    assert abs(odds - math.log(math.expm1(z - clean))) < 1e-6


def test_scores_and_offsets(frame, field):
    docs = [*ODD, (20, "lora Zorgle! suned vashik"), (21, "tara " * 500 + "vashik")]
    rows = toxicity.score(frame(docs), field, keep=["doc_id", "text", "bucket"]).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    assert by[20].predicted == by[21].predicted == 1
    assert [by[20].text[s.start : s.end] for s in by[20].spans] == ["Zorgle!", "vashik"]
    assert by[1].predicted == by[2].predicted == 0 and by[1].score == by[2].score
    df = frame(docs)
    kept = toxicity.reject(df, field)
    assert kept.columns == df.columns and sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in rows if not r.predicted)
    assert toxicity.score(frame([]), field).count() == 0
    clash = df.withColumns({"score": F.lit("s"), "predicted": F.lit("p"), "spans": F.lit(1), "a.b": F.lit(1)})
    out = toxicity.score(clash, field)
    assert sorted(out.columns) == sorted(clash.columns) and dict(out.dtypes)["score"] == "double" and out.count() == len(docs)
    assert toxicity.reject(clash, field).filter("score = 's' AND predicted = 'p' AND spans = 1").count() == kept.count()


def test_labels_without_a_class_or_without_rows(spark, frame):
    flat = toxicity.train(["a b", "c"], [0, 0])
    assert toxicity.describe("a", toxicity.Emissions(flat), flat)[0] < 0.5
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(frame(ODD), toxicity.learn(frame(ODD), labels)).count() == len(ODD)
    assert quality.classify(frame(ODD), quality.learn(frame(ODD), labels), *quality.document_site()).count() == len(ODD)


def test_only_labels_of_documents_at_hand_count(spark, frame, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 20)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 30)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, rate: seen.append((sorted(toxic), rate)))
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0 if i < 200 else i % 10 > 0)) for i in range(2000)], "doc_id long, quality int, toxic int")
    toxicity.learn(frame([(i, f"text {i}") for i in range(200)]), labels)
    kept = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert seen == [([0] * 30 + [1] * 20, (sum(i % 2 == 0 for i in kept) + 0.5) / (len(kept) + 1))]


def test_held_out_rows_are_not_learnt_from(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


# --- quality


def graded(seed=12, n=500):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        t, bad = " ".join(words(rng, rng.randint(20, 90))), rng.random() < 0.25
        if bad:
            t = rng.choice([lambda s: s.replace(" ", "$$$ "), lambda s: s.upper().replace(" ", "!! "), lambda s: s.replace(" ", " | "), lambda s: (s.split()[0] + " ") * 60])(t)
        texts.append(t)
        labels.append(int(not bad))
    return texts, labels


def test_held_out_quality():
    model = quality.train(*graded())
    texts, labels = graded(13, 300)
    z = model.logits(np.array([quality.measures(t) for t in texts]))
    x = np.array([quality.measures(t) for t in texts[:20]])
    assert np.allclose(model.rows(x) @ model.weights, model.logits(x))
    assert ((z >= 0) == np.array(labels)).mean() > 0.98


@pytest.mark.parametrize("most", [20_000, 3])
def test_site_posteriors(spark, monkeypatch, most):
    """Against sums over all other rows, one row at a time."""
    monkeypatch.setattr(quality, "BROADCAST_SITES", most)
    rng = random.Random(14)
    rows = []
    for host, share in (("good", 0.95), ("bad", 0.2), ("mixed", 0.6)):
        for path in ("a", "b"):
            p = min(0.97, max(0.05, share + (0.1 if path == "a" else -0.1)))
            rows += [(host, f"{host}/{path}", rng.gauss(0, 1) + (4.0 if rng.random() < p else -4.0)) for _ in range(60 if path == "a" else 25)]
    rows += [("lone", "lone/x", 6.0), ("two", "two/x", 5.0), ("two", "two/y", -5.0)]
    scored = spark.createDataFrame(rows, "__host string, __path string, __logit double")
    p = np.array([1 / (1 + math.exp(-z)) for _, _, z in rows])
    hosts, paths = np.array([h for h, _, _ in rows]), np.array([q for _, q, _ in rows])
    n, mean = len(rows), p.mean()

    def strength(labels, outer):
        """Between-group variance by the method of moments: groups `labels` within groups `outer`."""
        groups, around = sorted(set(labels)), sorted(set(outer))
        size = {g: (labels == g).sum() for g in groups}
        within = mean * (1 - mean)
        spread = sum(((labels == g) & (outer == o)).sum() * (p[labels == g].mean() - p[outer == o].mean()) ** 2 for o in around for g in groups if ((labels == g) & (outer == o)).any())
        scale = n - sum(size[g] ** 2 / (outer == o).sum() for o in around for g in groups if ((labels == g) & (outer == o)).any())
        between = (spread - (len(groups) - len(around)) * within) / scale
        return within / between - 1 if between > 1e-12 else math.inf

    sites, priors = quality.site_priors(scored)
    every = np.array(["all"] * n)
    assert priors.sites == 9 and np.isclose(priors.host_strength, max(0, strength(hosts, every))) and np.isclose(priors.path_strength, max(0, strength(paths, hosts)))
    got = {(r["__path"], round(r["__logit"], 9)): r for r in quality.with_posteriors(scored, sites, priors).collect()}
    assert len(got) == n
    for i, (h, q, z) in enumerate(rows):
        others = np.arange(n) != i
        all_others = p[others].mean()
        mine = others & (hosts == h)
        host = (p[mine].sum() + priors.host_strength * all_others) / (mine.sum() + priors.host_strength)
        mine = others & (paths == q)
        path = host if math.isinf(priors.path_strength) else (p[mine].sum() + priors.path_strength * host) / (mine.sum() + priors.path_strength)
        r = got[q, round(z, 9)]
        want = z + math.log(path / (1 - path)) - math.log(all_others / (1 - all_others))
        assert np.isclose(r["__host_posterior"], host) and np.isclose(r["__path_posterior"], path) and np.isclose(r["__score"], 1 / (1 + math.exp(-want)))
    assert np.isclose(got["lone/x", 6.0]["__path_posterior"], p[:-3].sum() / (n - 1) + (p[-2:].sum()) / (n - 1))


def test_sites_alike_are_not_told_apart(spark):
    rows = [(f"h{i % 5}", f"h{i % 5}/p", 2.0 if i % 3 else -2.0) for i in range(1500)]
    scored = spark.createDataFrame(rows, "__host string, __path string, __logit double")
    sites, priors = quality.site_priors(scored)
    assert math.isinf(priors.host_strength) and math.isinf(priors.path_strength)
    assert quality.with_posteriors(scored, sites, priors).filter("abs(__path_posterior - __host_posterior) > 1e-9").isEmpty()


def test_quality_keeps_columns_and_odd_rows(frame):
    model = quality.train(*graded())
    df = frame([*ODD, (30, "a$$$ b### c%%% " * 40)])
    out = quality.reject(df, model, *quality.document_site())
    assert out.columns == df.columns and 30 not in {r.doc_id for r in out.collect()}
    clash = df.withColumns({c: F.lit(0.25) for c in ("score", "path_posterior", "host_posterior", "predicted", "__host", "__path", "__logit", "__score", "__text", "__n", "a.b")})
    same = quality.reject(clash, model, *quality.document_site())
    assert same.columns == clash.columns and same.count() == out.count() and same.filter("score = 0.25 AND path_posterior = 0.25 AND __logit = 0.25 AND `a.b` = 0.25").count() == out.count()
    assert quality.classify(clash, model, *quality.document_site()).count() == len(ODD) + 1
    assert quality.classify(df, model, F.lit(None).cast("string"), F.lit(None).cast("string")).count() == len(ODD) + 1
    assert quality.classify(frame([]), model, *quality.document_site()).count() == 0 and quality.reject(frame([]), model, *quality.document_site()).count() == 0


def test_url_sites(spark):
    row = spark.createDataFrame([("https://me@Blog.x.org:80/en/825?page=2#t",), ("odd",), (None,)], "u string").select(*[c.alias(n) for n, c in zip("hp", quality.url_site(F.col("u")), strict=True)]).collect()
    assert (row[0].h, row[0].p) == ("blog.x.org", "blog.x.org/en") and row[1].h == ""


def test_words_in_pages_pattern():
    assert re.fullmatch(r"[a-z]+", "ok")
