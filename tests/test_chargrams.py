"""Counts of character grams beside a count in plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gramloom.functions.tokens import char_gram_range
from gramloom.operators import chargrams, vocab
from gramloom.plans import features, text

TEXTS = ["ab cd ab cd", "a", "", None, "ab", "naïve 中文 \U0001f600\U0001f600 x", "\x00a\x00\n\ta\x00", "ab cd ab cd", "aaaa" * 50]
MANY = ["".join(chr(0x4e00 + i * 7 % 20_000) for i in range(20_000)), "".join(chr(0x4e00 + i) for i in range(20_000)) * 2]


def counted(texts, lo, hi):
    tf, df = Counter(), Counter()
    for t in texts:
        s = (t or "").replace(" ", "_")
        grams = Counter(s[i:i + n] for n in range(lo, hi + 1) for i in range(len(s) - n + 1))
        tf += grams
        df.update(grams.keys())
    return {g: (tf[g], df[g]) for g in tf}


@pytest.mark.parametrize("lo,hi,slice_bytes", [(4, 4, 1 << 22), (1, 6, 1 << 22), (2, 3, 8)])
def test_grams_are_counted_as_in_plain_python(spark, lo, hi, slice_bytes):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(2)
    got = chargrams.gram_counts(df, F.col("text"), lo, hi, slice_bytes)
    assert {r["token"]: (r["tf"], r["df"]) for r in got.collect()} == counted(TEXTS, lo, hi)
    twin = vocab.term_counts(df, "doc_id", char_gram_range("text", lo, hi))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, twin.collect()))


def test_alphabets_too_large_for_one_number():
    for lo, hi in ((4, 5), (6, 6)):
        got = {}
        for grams, tf, df in chargrams._counted(MANY, lo, hi):
            got |= {"".join(map(chr, g)): (int(a), int(b)) for g, a, b in zip(grams, tf, df)}
        assert got == counted(MANY, lo, hi)


def test_no_row_for_each_gram(spark, sf):
    """Occurrences are counted before they become rows of strings."""
    for query in (features.ml_04_chars(spark, sf), text._preset(spark, sf, 6), text._preset(spark, sf, (3, 6))):
        plan = query._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "MapInArrow" in plan
