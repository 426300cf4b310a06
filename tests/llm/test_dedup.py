"""Suffix dedup and near duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import near_dup, suffix_dedup

from .conftest import ODD

WORDS = [f"w{i}" for i in range(400)]


def passages(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute(docs):
    """Removed bytes by a scan of all strings: those that start in a document with a smaller id."""
    first = {}
    for i, data in docs:
        for s in range(len(data) - 49):
            g = data[s : s + 50]
            first[g] = min(first.get(g, i), i)
    out = []
    for i, data in docs:
        cover = np.zeros(len(data) + 51, bool)
        for s in range(len(data) - 49):
            if first[data[s : s + 50]] < i:
                cover[s : s + 50] = True
        cover = cover[: len(data)]
        kept = np.frombuffer(data, np.uint8)[~cover].tobytes()
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((len(data), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def planted(seed=1, n=60):
    rng = random.Random(seed)
    shared = [passages(rng, 60) for _ in range(4)] + ["x" * 200, "ab" * 90]
    docs = []
    for i in range(n):
        parts = [passages(rng, rng.randint(0, 40))] + [rng.choice(shared) if rng.random() < 0.4 else passages(rng, 12) for _ in range(rng.randint(0, 4))]
        docs.append((rng.randint(0, 50), "é ".join(parts)))
    return [*docs, docs[0], *[(i, t) for i, t in ODD if i not in (6,)]]


@pytest.mark.parametrize("cut", ["sampled", "everywhere", "one prefix"])
def test_suffix_dedup(spark, frame, monkeypatch, cut):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 6_000)
    monkeypatch.setattr(suffix_dedup, "SMALL", 8)
    docs = planted()
    if cut != "sampled":  # splitters within the very prefixes that documents share
        texts = [t.encode() for _, t in docs if t]
        a = suffix_dedup.Anchors(texts)
        keys = sorted({suffix_dedup.sort_key(texts[d][lo : hi + 50], p - lo) for d, p, lo, hi in zip(a.doc.tolist(), a.at.tolist(), a.lo.tolist(), a.hi.tolist(), strict=True)})
        if cut == "one prefix":
            by = {}
            for k in keys:
                by.setdefault(k[:26], []).append(k)
            keys = max(by.values(), key=len)
            assert len(keys) > 4
        monkeypatch.setattr(suffix_dedup, "sampled_cuts", lambda *args: np.array([keys[i * len(keys) // args[-1]] for i in range(1, args[-1])], f"S{suffix_dedup.KEY}"))
    got = suffix_dedup.digests(frame(docs)).collect()
    least = np.iinfo(np.int64).min
    want = brute([(least if i is None else i, (t or "").encode()) for i, t in docs])
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, *w)) for (i, _), w in zip(docs, want, strict=True))


def test_splitters_grow_with_the_ranges(frame):
    rows = frame(planted(3, 200), 8).selectExpr("doc_id AS c_0", "text AS c_1")
    n, size = rows.count(), sum(len((t or "").encode()) for _, t in planted(3, 200))
    for ranges in (1, 2, 40):
        cuts = suffix_dedup.sampled_cuts(rows, "c_0", "c_1", n, size, ranges)
        assert len(cuts) == ranges - 1 and (cuts[1:] >= cuts[:-1]).all()


def test_labels_spread_evenly(spark):
    from sievelight.llm import blocks

    x = np.arange(-50, 5000, 7, dtype=np.int32)
    rows = spark.createDataFrame([(int(v),) for v in x], "v int").selectExpr("v", "hash(v) AS h").collect()
    assert blocks.spark_hash(np.array([r.v for r in rows], np.int32)).tolist() == [r.h for r in rows]
    for n in (1, 3, 4, 1001):
        labels = blocks.even_labels(spark, n)
        assert len(set(labels.tolist())) == n
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert (blocks.spark_hash(labels).astype(int) % parts == np.arange(n) % parts).all()


def test_cleaned_texts_keep_all_columns(frame):
    text = passages(random.Random(4), 60)
    docs = [(1, text), (2, "é" * 30 + text + "ü" * 30), (3, None), (4, text)]
    df = frame(docs)
    out = suffix_dedup.clean(df)
    assert out.columns == df.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    clash = df.withColumns({c: F.lit("own") for c in ("kept", "n_spans", "n_removed", "__text", "c_0", "to", "a.b")})
    same = suffix_dedup.clean(clash)
    assert same.columns == clash.columns and {r.doc_id: r.text for r in same.collect()} == kept
    assert same.filter("kept = 'own' AND n_spans = 'own' AND `a.b` = 'own' AND c_0 = 'own'").count() == len(docs)
    assert dict(suffix_dedup.dedup(clash).dtypes)["n_spans"] == "bigint"
    assert kept[1] == text and kept[2] == "é" * 30 + "ü" * 30 and kept[3] is None and kept[4] == ""


def test_empty_tables(frame):
    assert suffix_dedup.digests(frame([])).count() == 0 and suffix_dedup.clean(frame([])).count() == 0
    assert near_dup.classes(frame([])).count() == 0 and near_dup.distinct(frame([])).count() == 0


def test_multikey_order(monkeypatch):
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    order = suffix_dedup.multikey_order(words)
    assert [tuple(words[i]) for i in order] == sorted(map(tuple, words))
    for small in (1, 7, 100):
        monkeypatch.setattr(suffix_dedup, "SMALL", small)
        for top in (1, 2, 1000):
            words = rng.integers(0, top, (900, 4)).astype(np.uint64)
            assert [tuple(words[i]) for i in suffix_dedup.multikey_order(words)] == sorted(map(tuple, words))
    assert len(suffix_dedup.multikey_order(words[:0])) == 0


def test_anchors_cover_all_strings_and_agree_on_equal_ones():
    rng = random.Random(8)
    text = passages(rng, 300).encode()
    docs = [b"", text[:49], text, b"zz" + text + b"yy"]
    a = suffix_dedup.Anchors(docs)
    for i, d in enumerate(docs):
        mine = a.doc == i
        covered = [s for lo, hi in zip(a.lo[mine], a.hi[mine], strict=True) for s in range(lo, hi + 1)]
        assert covered == list(range(max(0, len(d) - 49)))
    at = {i: {s: p for p, lo, hi in zip(a.at[a.doc == i], a.lo[a.doc == i], a.hi[a.doc == i], strict=True) for s in range(lo, hi + 1)} for i in (2, 3)}
    assert all(at[3][s + 2] == p + 2 for s, p in at[2].items())


def test_coding():
    v = np.sort(np.random.default_rng(2).integers(0, 2**41, 1000).astype(np.uint64))
    assert (suffix_dedup._decode(suffix_dedup._code(v)) == v).all() and len(suffix_dedup._decode(suffix_dedup._code(v[:0]))) == 0


def exact_jp(a, b):
    """Probability Jaccard by its definition."""
    x, y = (dict(zip(h.tolist(), c.tolist(), strict=True)) for h, c in (a, b))
    keys = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in x.keys() & y.keys())


def test_probability_jaccard_and_its_estimate():
    rng = random.Random(3)
    words = near_dup.WordHashes()
    errors = []
    for _ in range(60):
        base = [rng.choice(WORDS[:80]) for _ in range(120)]
        other = [w if rng.random() < 0.97 else rng.choice(WORDS) for w in base] + base[: rng.randint(0, 60)]
        a, b = (near_dup.shingles(" ".join(t), words) for t in (base, other))
        j = exact_jp(a, b)
        assert abs(near_dup.probability_jaccard(a, b) - j) < 1e-9
        s = near_dup.sketches([a, b], 256)
        errors.append((s[0] == s[1]).mean() - j)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def near(seed=5):
    rng = random.Random(seed)
    docs, i = [], 0
    for g in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice((3, 30, 150, 400)))]
        for _ in range(rng.choice((1, 2, 9))):
            words = [w if rng.random() > rng.choice((0.0, 0.004, 0.02, 0.2)) else rng.choice(WORDS) for w in base]
            docs.append((i, " ".join(words)))
            i += 1
    return docs


@pytest.mark.parametrize("block", [1024, 4])
def test_classes(frame, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "MEMBERS", 3)
    docs = near() + [(1000, None), (1001, ""), (1002, "  "), (0, near()[0][1]), (None, near()[0][1]), (1003, near()[0][1].upper())]
    words = near_dup.WordHashes()
    lists = [near_dup.shingles(t or "", words) for _, t in docs]
    parent = list(range(len(docs)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if docs[a][0] is not None and docs[b][0] is not None and near_dup.probability_jaccard(lists[a], lists[b]) >= 0.8:
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(docs)):
        groups.setdefault(find(k), []).append(docs[k][0])
    want = sorted(repr((docs[k][0], min((i for i in groups[find(k)] if i is not None), default=None))) for k in range(len(docs)))
    got = near_dup.classes(frame(docs))
    assert sorted(repr((r.doc_id, r.class_id)) for r in got.collect()) == want
    kept = near_dup.distinct(frame(docs))
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(i) for k, (i, _) in enumerate(docs) if i is None or i == min(x for x in groups[find(k)] if x is not None))


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40) if i != 20], "a binary, b binary")
    found = {r.node[0]: r.label[0] for r in near_dup.components(pairs).collect()}
    assert found == {i: 0 if i <= 20 else 21 for i in range(41)}


def exact_classes(docs):
    """Least doc_id by document over all pairs whose exact probability Jaccard is 0.8 or more, and how many such pairs there are."""
    words = near_dup.WordHashes()
    lists = {i: near_dup.shingles(t or "", words) for i, t in docs}
    where, parent, pairs = {}, {i: i for i in lists}, 0
    for i, (h, _) in lists.items():
        for x in h.tolist():
            where.setdefault(x, []).append(i)

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, (h, _) in lists.items():
        shared = {}
        for x in h.tolist():
            for j in where[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j in shared:
            if near_dup.probability_jaccard(lists[i], lists[j]) >= 0.8:
                pairs += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in lists}, pairs


def test_recall_against_all_pairs(spark):
    """Every link of all pairs of a whole table is found: classes are those of the exact similarities."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, pairs = exact_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert pairs > 20 and len(got) == len(want) and len(wrong) <= 0.01 * pairs
