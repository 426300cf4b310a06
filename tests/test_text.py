from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.functions import embedding, markdown, porter
from sievelight.functions import text as T
from sievelight.operators import chunking


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_tokens_fold_case_and_marks(spark):
    assert one(spark, T.tokens, "Café, NIÑO_2 ß") == ["cafe", "nino", "2", "ß"]
    assert T.query_tokens("Café, NIÑO_2 ß") == ["cafe", "nino", "2", "ß"]


def test_sanitize_keeps_hyphen_and_underscore(spark):
    assert one(spark, T.sanitize, " a-b  c_d!? (e) ") == "a-b c_d e"
    assert T.sanitize_query(" a-b  c_d!? (e) ") == "a-b c_d e"


def test_preview_ends_at_a_line_and_never_inside_a_character(spark):
    assert one(spark, lambda x: T.preview(x, 10), "abcdefgh\nijk") == "abcdefgh\n\n... [truncated, 12 bytes total]"
    assert one(spark, lambda x: T.preview(x, 4), "aaaé") == "aaa\n\n... [truncated, 5 bytes total]"
    assert one(spark, lambda x: T.preview(x, 100), "short") == "short"


def test_head_and_tail(spark):
    text = "h" * 60 + "m" * 100 + "t" * 40
    assert one(spark, lambda x: T.head_and_tail(x, 100, 0.6), text) == "h" * 60 + "\n\n... [100 bytes omitted] ...\n\n" + "t" * 40


def test_first_byte_counts_bytes(spark):
    assert one(spark, lambda x: T.first_byte(x, "b"), "éab") == 3
    assert one(spark, lambda x: T.first_byte(x, "z"), "éab") is None


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "running": "run", "relational": "relat", "hopping": "hop", "agreed": "agre", "happy": "happi", "electricity": "electr", "adjustment": "adjust", "controlling": "control", "sky": "sky", "tokens": "token"}
    assert {w: porter.stem(w) for w in pairs} == pairs


def test_markdown():
    html = "<html><head><title>x</title></head><body><h1>A &amp; B</h1><p>one <b>two</b> <a href='/u'>three</a></p><ul><li>x</li><li>y</li></ul><script>no()</script></body>"
    assert markdown.to_markdown(html) == "# A & B\n\none **two** [three](/u)\n\n- x\n- y"
    assert markdown.to_markdown(None) is None


def test_byte_sum_embedding_native_and_python_agree(spark):
    embedder = embedding.ByteSumEmbedder(8)
    for text in ("", "a", "hello world, é"):
        native = one(spark, lambda x: embedding.byte_sum_vector(x, 8), text)
        assert all(abs(a - b) < 1e-5 for a, b in zip(native, embedder.batch([text])[0].tolist(), strict=True))


def test_kinds(spark):
    kind = lambda t: one(spark, chunking.content_kind, t)
    assert kind("# Title\ntext\n## Section\ntext") == "markdown"
    assert kind("fn a() {\n x;\n}\n") == "code"
    assert kind("<?php echo 1; ?>") == "code"
    assert kind("#FFD700 is a colour\n* {\n a: b;\n}\nc {\n d: e;\n}") == "code"
    assert kind("plain words\nand more") == "plain"
    assert kind("") == "plain"


def test_markdown_headings_in_fences_do_not_split():
    found = chunking.pieces("# A\n```\n# not\n```\n## B\ntext", "markdown")
    assert [(p.title, p.line_start, p.line_end) for p in found] == [("A", 1, 4), ("B", 5, 6)]


def test_code_titles_and_sizes():
    text = "".join(f"function f{i}() {{\n" + "  call();\n" * 30 + "}\n" for i in range(20))
    found = chunking.pieces(text, "code")
    assert len(found) >= 5 and all(len(p.content.encode()) <= chunking.MOST for p in found)
    assert found[0].title == "function f0() {"


def test_one_long_line_is_cut_between_characters():
    found = chunking.pieces("é" * 5000, "plain")
    assert "".join(p.content for p in found) == "é" * 5000
    assert all(len(p.content.encode()) <= chunking.MOST for p in found)


def test_blank_text_has_no_plain_chunk_but_one_code_chunk():
    assert chunking.pieces(" \n\n ", "plain") == []
    assert len(chunking.pieces("", "code")) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\né ", max_size=900), max_size=12))
def test_plain_chunks_keep_all_letters(parts):
    text = "\n\n".join(parts)
    found = chunking.pieces(text, "plain")
    strip = lambda s: "".join(s.split())
    assert strip("".join(p.content for p in found)) == strip(text)
    assert all(a.line_start <= a.line_end for a in found)
