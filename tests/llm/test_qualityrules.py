"""Quality rules beside brute force in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gramloom.llm import qualityrules as qr

SCHEMA = "doc_id long, text string, lang string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    out = {"n_chars": len(text), "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
           "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_lines": len(lines),
           "n_alpha_words": sum(any(c.isalpha() for c in w) for w in words), "n_stop_words": sum(w.lower() in {s for ws in qr.STOP_WORDS.values() for s in ws} for w in words),
           "n_bullet_lines": sum(bool(re.match(r"[ \t-\r]*[-*•‣▪]", x)) for x in lines), "n_ellipsis_lines": sum(x.rstrip(" \t\n\x0b\f\r").endswith(("...", "…")) for x in lines)}
    return out


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "a", "word", "x#", "***", "é1", "12", "Und", "中文", "-", "end...", "a b", "…", " "]
    out = [None, "", " \n\t ", "\n\n", "a", "- x\n- x\n- x", " lead and trail \x0b\f\r", "the of and"]
    for _ in range(n):
        base = rng.choices(words, k=rng.randrange(1, 60))
        if rng.random() < 0.4:
            base += base[rng.randrange(len(base)):] + base[:rng.randrange(1, len(base) + 1)]
        out.append("".join(w + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in base))
    return out


def test_measures_equal_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts(1))]
    got = {r.doc_id: r.quality.asDict() for r in qr.judge(spark.createDataFrame(rows, SCHEMA), lang="lang").collect()}
    for i, t, _ in rows:
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, t
        assert got[i]["kept"] == (not got[i]["failed"])
        few, repeated = want["n_words"] < 20, 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert ("few_words" in got[i]["failed"], "repeated_words" in got[i]["failed"]) == (few, repeated)
    assert sum(d["n_repeat_words"] > 0 for d in got.values()) > 20


def test_table_of_rules_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "one two three", "en"), (2, "one", None), (3, "eins zwei drei", "de")], SCHEMA)
    rules = (qr.Rule("short", "n_words", "one", 2000, None), qr.Rule("foreign", "n_stop_words", "n_words", 1, None, ("de",)))
    got = {r.doc_id: r.quality.failed for r in qr.judge(docs, rules, lang="lang").collect()}
    assert got == {1: [], 2: ["short", "foreign"], 3: ["foreign"]}
    assert all(r.quality.kept for r in qr.judge(docs, ()).collect())
    with pytest.raises(ValueError):
        qr.judge(docs, (qr.Rule("x", "no_measure", "one", 1, 2),))


def test_each_rule_finds_its_kind(spark):
    rng = random.Random(2)
    plain = "the house of water and light was in a winter with green paper on it".split()
    clean = "\n".join(" ".join(rng.sample(plain, 12)) for _ in range(12))
    bad = {
        "few_words": "the of and", "repeated_words": " ".join(plain) + " " + " ".join(plain), "word_length": " ".join("abcdefgh" * 8 for _ in range(25)),
        "symbols": " ".join(w + "##" for w in clean.split()), "letters": " ".join(w if i % 2 else "123" for i, w in enumerate(clean.split())),
        "stop_words": " ".join(f"qq{i}" for i in range(40)), "same_lines": "\n".join(["the one line of it"] * 10), "bullet_lines": "\n".join("- " + x for x in clean.split("\n")),
        "ellipsis_lines": "\n".join(x + "..." for x in clean.split("\n")),
    }
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([clean, *bad.values()])], SCHEMA)
    got = {r.doc_id: r.quality.failed for r in qr.judge(docs, lang="lang").collect()}
    assert got[0] == []
    assert all(name in got[i + 1] for i, name in enumerate(bad))


def test_edge_cases(spark):
    assert qr.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"w{i % 997}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long, None), (1, long, None), (None, None, None)], SCHEMA).withColumns({c: F.lit(1) for c in ["_text", "_words", "_lines", "_row", "quality", "a.b", "_m_n_words"]})
    got = qr.judge(docs, lang="lang")
    assert got.columns == ["doc_id", "text", "lang", "_text", "_words", "_lines", "_row", "a.b", "_m_n_words", "quality"]
    rows = got.select("doc_id", "quality.*").collect()
    assert [(r.doc_id, r.n_words, r.n_repeat_words) for r in sorted(rows, key=lambda r: r.doc_id or 0)] == [(None, 0, 0), (1, 200_000, 200_000), (1, 200_000, 200_000)]


def test_one_projection_without_user_functions(spark, sf):
    plan = qr.op12_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
