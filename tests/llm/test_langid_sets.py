"""Language filters beside plain sets of n-grams."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from gramloom.llm.langid import fit_language_filters, score_floors

SHARE = 1e-3


def grams(text):
    """All 3- and 4-grams of lower-case letters, with one space for anything else and at both ends."""
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in s:
        s = s.replace("  ", " ")
    return [s[i:i + n] for n in (3, 4) for i in range(len(s) - n + 1)]


@pytest.mark.parametrize("n_langs", [3, 11, 70])
def test_shares_equal_plain_sets_and_no_stored_ngram_is_missed(spark, n_langs):
    rng = random.Random(n_langs)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçøåжшя"
    langs = {f"l{i:02d}": rng.sample(letters, 9) for i in range(n_langs)}

    def text(lang):
        return "".join(rng.choice([*langs[lang], *langs[lang], " ", ", ", "7 ", "\n"]) for _ in range(rng.randrange(5, 200)))

    rows = [(i, text(lang), lang) for i, lang in enumerate(sorted(langs) * 6)]
    model = fit_language_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"), min_share=SHARE, sample_docs=None)
    sets = {}
    for lang in langs:
        count = Counter(g for _, t, of in rows if of == lang for g in grams(t))
        sets[lang] = {g for g, n in count.items() if n >= SHARE * sum(count.values())}
    assert model.languages == sorted(langs)
    texts = [t for _, t, _ in rows] + ["", "12 !", "abc", "Mixed жшя abc \n äö", "a"]
    got, has_letter = model.shares(pa.array(texts))
    for j, t in enumerate(texts):
        every = grams(t)
        assert has_letter[j] == any(c.isalpha() for c in t)
        if not has_letter[j]:
            continue
        for i, lang in enumerate(model.languages):
            plain = sum(g in sets[lang] for g in every) / len(every)
            # never fewer hits than the set has, and hardly more by chance
            assert (got[i, j] * (1 - model.chance[i]) + model.chance[i]) >= plain - 1e-9 or got[i, j] == 1
            assert abs(got[i, j] - plain) < 0.02
    assert np.all(model.chance < 1e-3)


def test_filters_and_floors_count_every_labelled_row(spark):
    common, rare = "the water of the river and the stone", "zyx wvu qpo"
    # a fifth of the rows, those of the highest hashes, which the 10,000 of the lowest leave out
    last = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) >= int((1 << 30) * 0.85)
    docs = spark.range(12_500).select(F.col("id").alias("doc_id"), F.when(last, rare).otherwise(common).alias("text"), F.lit("en").alias("lang"))
    model = fit_language_filters(docs)
    assert min(model.shares(pa.array([common, rare]))[0][0]) > 0.9
    scored = docs.select("text", "lang", F.lit("en").alias("lang_pred"), ((F.when(last, 20_000).otherwise(0) + F.col("doc_id")) / 40_000).alias("score"))
    own = sorted(scored.select("score").toPandas()["score"])
    short = sorted(scored.where(F.col("text") == rare).select("score").toPandas()["score"])
    floors = {r["size"]: r["floor"] for r in score_floors(scored, share=0.01).collect()}
    assert floors[None] == own[124] and floors[3] == short[-(-len(short) // 100) - 1]
