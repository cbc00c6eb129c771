"""Frequent n-grams beside a plain count of all of them."""

import numpy as np
from pyspark.sql import functions as F

from gramloom.functions.tokens import word_ngrams
from gramloom.operators import ngrams
from gramloom.operators.vocab import term_counts


def _texts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{int(w)}" for w in rng.zipf(1.3, rng.integers(0, 60)) if w < 5000)) for i in range(300)]
    return spark.createDataFrame([*rows, (300, None), (301, ""), (302, "one")], "doc_id long, text string").repartition(5)


def _check(spark, n, bits):
    df, words = _texts(spark), F.split("text", " ")
    every = {tuple(r) for r in term_counts(df, "doc_id", word_ngrams(words, 1, 3)).collect()}
    got = {tuple(r) for r in ngrams.frequent_ngrams(df, "doc_id", words, 1, 3, n, bits).collect()}
    assert got <= every
    order = lambda rows: sorted(rows, key=lambda r: (-r[1], r[0]))[:n]
    assert order(got) == order(every)
    return got, every


def test_frequent_ngrams_are_exact(spark):
    got, every = _check(spark, 50, 16)
    assert len(got) < len(every) // 2


def test_crowded_places_lower_the_floor(spark):
    """Few places hold many n-grams each, so that their counts say little."""
    _check(spark, 50, 8)


def test_small_corpora_are_counted_whole(spark):
    got, every = _check(spark, 10**6, 16)
    assert got == every


def test_only_frequent_ngrams_become_strings(spark, monkeypatch):
    """A plain count of all n-grams writes and shuffles each of them; here those of the last round alone are counted by name."""
    seen = []
    monkeypatch.setattr(ngrams, "term_counts", lambda *a: seen.append(term_counts(*a).count()) or term_counts(*a))
    _, every = _check(spark, 50, 16)
    assert len(seen) == 1 and seen[0] < len(every) // 2
