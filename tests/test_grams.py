"""Character grams of several orders."""

from gramloom.functions.tokens import char_grams_interleaved


def test_interleaved_grams_are_not_sorted(spark):
    grams = char_grams_interleaved("t", 2, 4)
    assert "sort_array" not in str(grams)
    rows = spark.createDataFrame([("ab cd",), ("a",), ("ab",), ("",), (None,)], "t string").select("t", grams.alias("g")).collect()
    for t, g in rows:
        s = t and t.replace(" ", "_")
        assert g == (None if t is None else [s[e - n:e] for e in range(2, len(s) + 1) for n in range(2, min(4, e) + 1)])
