"""Every query with SQL gives the same rows as DuckDB over the smallest tables; the others run."""

import datetime

import duckdb
import pytest

from sievelight import queries

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, duck):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in queries.SQL:
        return
    result = duck.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)


def test_bm25_is_one_scan_without_a_shuffle_of_rows(spark):
    from sievelight.operators import search

    plan = search.bm25(queries.corpus(spark, SF), "thing heat", 15)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    assert "BroadcastNestedLoopJoin" in plan or "BroadcastExchange" in plan


def test_corrections_look_at_the_whole_vocabulary(spark, tmp_path):
    text = " ".join(f"a{i:06d}" for i in range(100_100)) + " thing heat"
    spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: r.corrected for r in queries.fuzzy_correct(spark, str(tmp_path)).collect()}
    assert got == {"thinng": "thing", "heatt": "heat", "zzzzzzzz": "zzzzzzzz"}


def test_filters_reach_the_scan(spark):
    plan = queries.read_chunks(spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(source,src3)" in plan
