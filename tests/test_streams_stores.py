"""Blockwise n-grams over restarts, token rates, and the bucketed author store."""

import random

import pytest
from pyspark.sql import functions as F

from gramloom.operators import vocab
from gramloom.sinks import writers as wr
from gramloom.streaming import jobs


def whole_grams(text, lo, hi):
    return [text[e - n:e] for e in range(1, len(text) + 1) for n in range(lo, hi + 1) if e >= n]


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_block_grams_equal_those_of_the_glued_text(size):
    text = "abcdefgh_ij" * 3
    tail, got = "", []
    for i in range(0, len(text), size):
        got += jobs.block_grams(tail, text[i:i + size], 2, 4)
        tail = (tail + text[i:i + size])[-3:]
    assert got == whole_grams(text, 2, 4)


def test_blocks_in_any_order_and_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    texts = {k: "".join(rng.choice("abc de") for _ in range(60)) for k in (1, 2, 3)}
    rows = [(k, i, t[7 * i:7 * i + 7]) for k, t in texts.items() for i in range(9)]
    rng.shuffle(rows)
    schema, source = "key long, block long, piece string", str(tmp_path / "in")
    for part in (rows[:13], rows[13:20] + rows[:3], rows[20:]):  # a run for each, some blocks twice
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.block_ngram_lines(spark.readStream.schema(schema).parquet(source), "key", "block", "piece", 3, 4)
        jobs.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 27
    for k, t in texts.items():
        lines = [r["line"] for r in sorted((r for r in got if r["key"] == k), key=lambda r: r["block"])]
        assert " ".join(x for x in lines if x).split(" ") == whole_grams(t.replace(" ", "_"), 3, 4)


def test_token_rate(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], "id int, t array<string>")
    got = vocab.token_rate(df, F.col("t")).first()
    assert (got["n_docs"], got["n_tokens"]) == (3, 3) and got["tokens_per_second"] > 0
    for i in range(3):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rates = jobs.stream_rates(stream, F.col("t"), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert len(rates) == 3 and all((r["n_docs"], r["n_tokens"]) == (3, 3) and r["tokens_per_second"] > 0 for r in rates)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_author_store_joins_without_exchange_and_prunes(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 97).alias("author_id"), F.col("id").alias("conv_id"), F.lit("text").alias("content"))
    wr.write_author_store(df, "authors_test", str(tmp_path), buckets=8)
    store, keys = wr.open_author_store(spark, "authors_test", str(tmp_path), "author_id bigint, conv_id bigint, content string", buckets=8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = store.join(keys, ["author_id", "conv_id"])
        assert joined.count() == 5000
        plan = store.join(keys, "author_id").groupBy("author_id").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        one = store.where("author_id = 5")
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # the plan then names the buckets it reads
        assert "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().executedPlan().toString()
        assert one.count() == keys.where("author_id = 5").count() == 52
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
        spark.sql("DROP TABLE authors_test")
        spark.sql("DROP TABLE authors_test_keys")
