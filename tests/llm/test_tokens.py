"""Encoding, packing and the token store against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sievelight.llm import blocks, bpe, packing, token_store  # noqa: E402

from .conftest import LONG, ODD  # noqa: E402

JSON = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
RANKS = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def whole():
    return JSON.encoders()[0]


def test_random_texts_encode_as_a_whole():
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=RANKS.pattern, mergeable_ranks=bpe.read_ranks(RANKS.path), special_tokens={})
    parts = ["a", "bb", " ", "  ", "\n", "\r\n", "\t", "don't", "'ll", "'", "é", "1", "..", "wordword", "☃", "x.", ",y", " ", "　", "<|endoftext|>", "_", "Straße", "\x1c", "日本"]
    rng = random.Random(3)
    for encoder, one in ((coder.encode_ordinary, RANKS.cache()), (JSON.encoders()[0], JSON.cache())):
        for _ in range(400):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
            want = encoder(text)
            assert np.frombuffer(one.text_ids(text), "<u4").tolist() == want, repr(text)
            for chunk, overlap in ((16, 8), (40, 12), (5, 4)):
                assert np.frombuffer(bpe.encode_text(one, text, chunk, overlap), "<u4").tolist() == want, repr(text)


def test_texts_at_once_encode_as_one_by_one(whole, monkeypatch):
    parts = ["a", "bb", " ", " ", " ", "  ", "\n", "\r\n", "\t", "don't", "'ll", "'", "é", "é,", "1", "²", "..", "wordword", "☃", "x.", ",y", "\u3000", "<|endoftext|>", "_", "Straße", "\x1c", "日本", "日本.", "x" * 90, "!" * 70]
    rng = random.Random(5)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += [None, "", " ", "  ", "a ", " a", ".", " .", "a. b., \n", *(t for _, t in ODD)]
    rng.shuffle(texts)
    want = [whole(t or "") for t in texts]
    for limit, size in ((400_000, bpe.SLICE_CHARS), (400_000, 500), (50, 3000), (3, 1)):
        cache = bpe.PieceCache(*JSON.encoders(), JSON.added(), limit)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(cache, texts, size)] == want
        assert len(cache.table.keys) <= limit and all(len(k) <= 64 for k in cache.table.keys.to_pylist())
    monkeypatch.setattr(bpe, "SPREAD_CHARS", 40)
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(JSON.cache(), iter(texts))] == want
    assert list(bpe.encode_texts(JSON.cache(), [])) == []


def test_a_word_is_encoded_once_whatever_marks_follow():
    encode, one = JSON.encoders()
    calls = []
    cache = bpe.PieceCache(encode, lambda word: calls.append(word) or one(word), JSON.added())
    words = ["zorp", "quandle", "éxtrème"]
    texts = ["So " + " ".join(w + m for w in words for m in ("", ",", ".", "?!", ")")) for _ in range(50)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(cache, texts)] == [encode(t) for t in texts]
    assert sorted(calls) == sorted(["So", *(" " + w for w in words)])
    assert not cache.known


def test_strings_of_special_tokens_encode_as_the_library_does(frame):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON.path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y " * 400, "<|endoftext| >", "word " * 20_000 + "<|endoftext|>" + " z" * 9_000]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(bpe.encode_text(JSON.cache(), t), "<u4").tolist() for t in texts] == want
    rows = bpe.encode(frame(list(enumerate(texts))), "text", JSON, ["doc_id"], spread_chars=1000).collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in sorted(rows, key=lambda r: r.doc_id)] == want
    packed = packing.pack(frame([(0, texts[0])]), JSON, 0, with_ids=True).collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in packed] == [[*want[0], 0]]


def test_a_run_longer_than_any_overlap():
    text = "x" * 5000 + " y " + "1" * 3000
    one = RANKS.cache()
    assert bpe.encode_text(one, text, 100, 10) == one.text_ids(text)


@pytest.mark.parametrize("spread", [1 << 20, 1000])
def test_encode_and_decode(frame, whole, spread):
    rows = bpe.digests(bpe.encode(frame(ODD), "text", RANKS, ["doc_id"], spread_chars=spread), RANKS.path, ["doc_id"]).collect()
    want = []
    for i, t in ODD:
        ids = RANKS.encoders()[0](t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_packing(frame, whole):
    rows = packing.pack(frame([r for r in ODD if r[0] != 7]), JSON, 0, with_ids=True).collect()
    texts = dict(r for r in ODD if r[0] != 7)
    docs, windows = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for i, pieces in docs.items():
        ids = np.array([*whole(texts[i] or ""), 0], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.ids == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 3000, 300)
    windows, tree = packing.best_fit(lengths)
    rooms = []  # best-fit decreasing by a scan of all windows; equally tight ones are alike
    for n in sorted((int(n) % 1024 for n in lengths if n % 1024), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            k = min(fits, key=rooms.__getitem__)
            rooms[k] -= n
        else:
            rooms.append(1024 - n)
    assert sorted(1024 - sum(n for _, _, n in w) for w in windows) == sorted([*rooms, *[0] * int(sum(lengths // 1024))])
    assert sorted(room for room, ats in enumerate(tree.open) for _ in ats) == sorted(room for room in rooms if room)
    packed = packing.filled(windows, tree)
    assert sum(n for w in packed for _, _, n in w) == lengths.sum()
    assert all(sum(n for _, _, n in w) <= 1024 for w in packed)
    assert sum(sum(n for _, _, n in w) < 1024 for w in packed) <= 1
    tree, rooms = packing.Capacities(64), []
    for step in range(400):
        need = int(rng.integers(1, 65))
        want = min((r for r in rooms if r >= need), default=0)
        assert tree.tightest(need) == want
        if want and step % 2:
            tree.take(want)
            rooms.remove(want)
        else:
            tree.put(step, need)
            rooms.append(need)


def test_token_store(spark, frame, whole, tmp_path):
    uri = f"file://{tmp_path}/store"
    files = token_store.write(frame(ODD), uri, JSON, 2, 50_257)
    rows = token_store.read(spark, uri, files, with_ids=True).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    got = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in order]
    for r, (_, text) in zip(got, order, strict=True):
        ids = [*whole(text or ""), 2]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("width", [2, 4])
def test_one_short_document_and_a_wrong_dictionary(width):
    few = b"\1\0\2\0\7\0\0\0"
    data = token_store.file_bytes(np.array([3, 5, 5]), [np.array(x, "<u4").tobytes() for x in ([1, 2], [7], [])], few, width)
    held = token_store.TokenFile(lambda a, n: data[a : a + n], few)
    assert [x.tolist() for x in held.document(5)] == [[7], []] and held.document(4) == []
    with pytest.raises(ValueError):
        token_store.TokenFile(lambda a, n: data[a : a + n], b"other")


def test_a_short_document_is_read_by_its_own_bytes(tmp_path):
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 50_000, n).astype("<u4").tobytes() for n in (200_000, 12, 300_000)]
    few = rng.integers(0, 50_000, 2000).astype("<u2").tobytes()
    path = tmp_path / "tokens-000000.bin"
    path.write_bytes(token_store.file_bytes(np.array([1, 2, 3]), ids, few, 2))
    with token_store.opened(f"file://{path}", few) as held:
        read, plain = [], held.read
        held.read = lambda start, size: read.append(size) or plain(start, size)
        assert held.document(2)[0].tobytes() == ids[1]
    assert len(read) == 1 and read[0] < 100 < 10_000 < path.stat().st_size


def test_there_always_is_a_dictionary(frame):
    """Too few samples, samples all alike, and no text: plain content instead of a trained dictionary."""
    for docs in ([(1, "just one text")], [(i, "the same words") for i in range(40)], [(1, ""), (2, None)], []):
        for width in (2, 4):
            made = token_store.train_dictionary(frame(docs), JSON, width, 2)
            assert 0 < len(made) <= token_store.DICT_BYTES
            ids = np.array([*JSON.encoders()[0](docs[0][1] or "" if docs else ""), 2], "<u4").tobytes()
            data = token_store.file_bytes(np.array([4]), [ids], made, width)
            assert token_store.TokenFile(lambda a, n, data=data: data[a : a + n], made).document(4)[0].tobytes() == ids


def test_runs_of_documents():
    rng = np.random.default_rng(4)
    offsets = np.concatenate([[0], np.cumsum(rng.integers(1, 400, 300))])
    for most, size in ((500, 1 << 20), (7, 1000), (500, 1), (1, 1 << 20)):
        got = list(token_store.runs(offsets, most, size))
        assert [x for a, b in got for x in range(a, b)] == list(range(300))
        assert all(b - a <= most and (b == a + 1 or offsets[b] - offsets[a] <= size) for a, b in got)
    assert list(token_store.runs(np.array([0]))) == []


def test_a_shared_dictionary_is_trained_and_used(spark, frame, tmp_path):
    rng = random.Random(2)
    docs = [(i, " ".join(f"w{rng.randint(0, 900)}" for _ in range(700))) for i in range(60)]
    uri = f"file://{tmp_path}/d"
    files = token_store.write(frame(docs), uri, JSON, 2, 50_257)
    fs, path = blocks.filesystem(uri)
    sizes = [x.size for x in fs.get_file_info(token_store._selector(path)) if x.path.endswith(".dict")]
    assert len(sizes) == 1 and sizes[0] > 0
    assert token_store.read(spark, uri, files).count() == 60


def test_the_dictionary_is_trained_on_any_documents_and_any_part_of_them(frame, monkeypatch):
    rng = random.Random(4)
    docs = [(i, " ".join(f"{'early' if i < 100 else 'late'}{w}{rng.randint(0, 900)}" for w in ("start",) * 1500 + ("end",) * 1500)) for i in range(200)]
    seen = []
    monkeypatch.setattr(token_store.zstandard, "train_dictionary", lambda size, samples: seen.extend(samples) or token_store.zstandard.ZstdCompressionDict(b"d"))
    token_store.train_dictionary(frame(docs, 4), JSON, 2, 2, docs=60)
    decode = bpe.decoder(RANKS.path)
    texts = [decode(np.frombuffer(s, "<u2").astype("<u4").tobytes()) for s in seen]
    assert len(texts) == 60 and all(len(s) <= 2 * token_store.DICT_IDS for s in seen)
    for a, b in ((b"early", b"late"), (b"start", b"end")):
        assert sum(a in t for t in texts) > 10 and sum(b in t for t in texts) > 10


def test_empty_tables(spark, frame, tmp_path):
    empty = frame([])
    assert bpe.encode(empty, "text", RANKS, ["doc_id"]).count() == 0
    assert packing.pack(empty, JSON, 0).count() == 0
    uri = f"file://{tmp_path}/e"
    assert token_store.read(spark, uri, token_store.write(empty, uri, JSON, 2, 50_257)).count() == 0


def test_long_texts_are_whole():
    one = RANKS.cache()
    assert bpe.encode_text(one, LONG) == one.text_ids(LONG)


def test_batches_are_bounded_in_bytes(spark):
    """Texts of 8 MB: no Arrow batch holds more than a few of them."""
    import pyarrow as pa

    blocks.session_limits(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 400

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    got = [r.n for r in spark.range(0, 12, 1, 1).selectExpr("repeat('12345678', 1 << 20) AS text").mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 12 * (8 << 20) and max(got) <= blocks.BATCH_BYTES + (9 << 20)


def test_shared_folders_go_with_the_driver(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\nfrom pyspark.sql import SparkSession\nfrom sievelight.llm import blocks\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()\n"
        "import os\nassert blocks.settle(s.range(5), 'x').count() == 5\n"
        f"print('held', sum(x.startswith('x-') for x in os.listdir({str(tmp_path)!r})))\ns.stop()\n"
    )
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert "held 1" in said and not any(x.startswith("x-") for x in os.listdir(tmp_path))


def test_other_patterns_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(RANKS.path, r"\w+|\W+").encoders()
