"""The pipeline, stage by stage, and the queries over the smallest tables."""

import zlib

import duckdb
import numpy as np
import pytest

from ..conftest import SF


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline
    from sievelight.llm import blocks, bpe, near_dup
    from sievelight.llm.queries import tokenizers_vocabulary

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        docs = blocks.settle(stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert seen[0] >= seen[1] >= seen[2] == seen[3] and len(seen[3]) > 50
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lost = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0 and i not in seen[1]]
    assert len(lost) <= 0.03 * len(labels)
    words = near_dup.WordHashes()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(texts) == len(seen[3])
    rows = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    cache = tokenizers_vocabulary().cache()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, r.ids))
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for i, text in texts.items():
        assert b"".join(x for _, x in sorted(by[i])) == bpe.encode_text(cache, text) + np.array([0], "<u4").tobytes()
    assert words is not None


def test_run(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", ["op2_top_k"])
def test_sql(spark, name):
    from sievelight.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = queries.queries()[name](spark, SF)
    result = con.execute(queries.oracle_sql()[name])
    assert [d[0] for d in result.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op3_token_store", "op4_bpe_round_trip", "op5_fingerprints", "op6_quality", "op7_main_text", "op8_toxicity", "op10_near_duplicates"])
def test_one_row_for_each_input_row(spark, name):
    from sievelight.llm import queries

    key, table = ("page_id", "pages") if name.startswith("op7") else ("doc_id", "documents")
    got = sorted(r[key] for r in queries.queries()[name](spark, SF).select(key).collect())
    assert got == sorted(r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())


def test_stages_on_clashing_columns_and_on_nothing(spark):
    from pyspark.sql import functions as F

    import corpus_pipeline as pipeline
    from sievelight.llm import blocks

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ("score", "predicted", "spans", "path_posterior", "host_posterior", "__host", "kept", "n_spans", "node", "label", "class_id", "text_", "c_0", "block", "a.b")
    clash = docs.withColumns({c: F.lit(c) for c in names})
    for rows in (clash, docs.limit(0), docs.withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes if c != "doc_id"}).limit(5)):
        columns = rows.columns
        for name, stage in pipeline.STAGES[:-1]:
            rows = blocks.settle(stage(spark, rows, SF), "stage")
            assert rows.columns == columns, name
        for c in set(names) & set(columns):
            assert rows.filter(blocks.column(c) != c).isEmpty()
        pipeline.STAGES[-1][1](spark, rows, SF).count()
