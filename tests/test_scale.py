"""Steps that must grow no faster than their input: what their plans shuffle and sort, and their results beside brute force."""

from __future__ import annotations

import random

import numpy as np

from gramloom.operators import features, joins, wiki
from gramloom.session import by_key


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_summed_without_a_sort(spark):
    rng = random.Random(2)
    tf = [(d, f"w{w}", rng.randint(1, 5)) for d in range(300) for w in rng.sample(range(40), 7)]
    vectors = {f"w{w}": [rng.uniform(-1, 1) for _ in range(6)] for w in range(30)}
    bags = spark.createDataFrame(tf, "doc_id int, token string, tf long")
    table = spark.createDataFrame(list(vectors.items()), "token string, vec array<double>")
    summed = features.embed_documents(bags, table, "sum")
    assert "ObjectHashAggregate" not in plan_of(summed) and "SortAggregate" not in plan_of(summed)
    want = {}
    for d, w, n in tf:
        if w in vectors:
            want[d] = want.get(d, np.zeros(6)) + n * np.array(vectors[w])
    got = {r.doc_id: r.vec for r in summed.collect()}
    assert set(got) == set(want) and all(np.allclose(got[d], want[d]) for d in want)
    assert features.embed_documents(bags, table.limit(0), "mean").count() == 0


def test_only_rare_keys_of_a_large_dictionary_are_shuffled(spark):
    rng = random.Random(3)
    tokens = [(i, f"w{min(int(rng.paretovariate(0.7)), 900)}") for i in range(6000)] + [(i, None) for i in range(50)]
    dictionary = [(f"w{i}", i) for i in range(0, 900, 2)] + [("w2", -2), (None, 5)]
    left = spark.createDataFrame(tokens, "doc_id int, token string")
    right = spark.createDataFrame(dictionary, "token string, v int")
    # as much as some 100 of the 450 keys take
    got = joins.join_dictionary(left, right, limit=2000, share=50)
    by_word = {}
    for w, v in dictionary:
        by_word.setdefault(w, []).append(v)
    want = sorted((d, w, v) for d, w in tokens if w is not None for v in by_word.get(w, ()))
    assert sorted((r.doc_id, r.token, r.v) for r in got.collect()) == want
    assert "Union" in plan_of(got) and "BroadcastHashJoin" in plan_of(got)
    assert joins.join_dictionary(left, right, limit=0).count() == len(want)


def test_parts_follow_the_measured_size(spark):
    # the planner takes the join for the product of both sides
    few = spark.range(100_000).join(spark.range(99_990, 200_000), "id")
    parts = by_key(few, "id")
    assert parts.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism and parts.count() == 10


def test_dictionaries_beyond_a_broadcast_go_in_slices(spark):
    """Tokens are not shuffled, so the vector sums of a document are made where its tokens lie."""
    tokens = spark.createDataFrame([(d, f"w{(d * 7 + i) % 90}", 1) for d in range(60) for i in range(20)] + [(1, None, 1)], "doc_id int, token string, tf int")
    vectors = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(5, 200)] + [(None, [1.0, 1.0])], "token string, vec array<double>")
    vectors = vectors.repartition(4)
    got = joins.join_dictionary(tokens, vectors, limit=2000)
    want = tokens.join(vectors, "token")
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    assert "Exchange hashpartitioning" not in plan_of(got) and "Union" in plan_of(got)


def test_links_with_many_pipes(spark):
    """A link without an end, and one with an end, before thousands of pipes; each took stack for every pipe."""
    pipes = "a |" * 20_000
    texts = ["[[open " + pipes + " z", "[[x|" + pipes + " b ]] y", "[[x|b [[y|c ]] ]]", "[[|]]", "[[a| | c d  ]]"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [r["clean"] for r in wiki.clean_pages(df, "t").orderBy("id").select("clean").collect()]
    assert got == ["[[open " + pipes + " z", "b y", "b c", "", "c d"]
