"""Every registered query beside its SQL twin, and properties of the plans."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, rows  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# dozens of fits, minutes even on the smallest tables; tests/test_crossval.py, tests/test_topics.py and tests/test_operators.py run the same code on smaller ones
SLOW = {"ml_05_topic_errors", "ml_18_experiments", "ml_19_replication_matrix"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_equals_twin(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.collect(), df.columns) == rows(cur.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["token", "tf", "df", "idf"] and df.count() == 1000


@pytest.mark.parametrize("name", ["slice_top_ngrams", "agg_01_term_stats", "agg_04_top_features", "txt_05_tokens_all", "ml_02_tfidf_smooth", "jn_02_tokens_to_clusters", "agg_11_f_score_dense_sum"])
def test_plans_stay_in_the_jvm(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "Python" not in text and "ArrowEval" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_term_counts_take_one_exchange(spark):
    from gramloom.functions.tokens import analyze
    from gramloom.operators import vocab

    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    counts = vocab.term_counts(docs, "doc_id", analyze("text"))
    assert plan(counts).count("Exchange hashpartitioning") == 1 and "Sort " not in plan(counts)


def test_large_top_lists_need_no_single_task(spark):
    from gramloom.operators import vocab

    df = spark.range(50_000).selectExpr("concat('t', id) AS token", "id % 100 AS tf", "1L AS df")
    got = vocab.most_common(df, 20_000)
    assert "TakeOrdered" not in plan(got) and "GlobalLimit" not in plan(got)
    want = sorted(((99 - i % 100, f"t{i}") for i in range(50_000)))[:20_000]
    assert sorted((99 - r["tf"], r["token"]) for r in got.collect()) == want
    assert vocab.most_common(df, 60_000).count() == 50_000
