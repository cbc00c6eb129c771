"""Phrase collocations beside brute force."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gramloom.llm import collocations as co

SCHEMA = "text string, lang string"


def pieces_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", low)]


def brute(rows, least, longest, most):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for words in pieces_of(text):
            total[lang or "und" if lang is None else lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    count["und" if lang is None else lang][tuple(words[i:i + m])] += 1
    out = []
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        scored = []
        for p, a in cand.items():
            if inside[p] < a:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((lang, " ".join(p), a, f[p[:k]], f[p[k:]], total[lang], score))
        scored.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(scored[:most])]
    return sorted(out)


def prose(seed, n=400):
    rng = random.Random(seed)
    words = ["a", "b", "the", "The", "of", "é", "É", "\x01c", "x\x1fy", "中", "A\x01", "zz", "a b", "ﬁ"]
    marks = [" ", "  ", "\t", ", ", ". ", "\n", "! ", " ;", "\r\n"]
    passage = "one two three four five six seven"

    def text():
        out = "".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))])[0] + rng.choices(marks, [20, 1, 1, 2, 2, 1, 1, 1, 1])[0] for _ in range(rng.randrange(0, 40)))
        return out + passage if rng.random() < 0.3 else out

    return [(text(), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(n)] + [(None, "en"), ("", "de"), (" ., ", "fr"), ("solo", "it")]


@pytest.mark.parametrize("seed,least,longest,most", [(1, 3, 5, 2000), (2, 10, 4, 7), (3, 1, 3, 5000), (4, 2, 2, 100)])
def test_equals_brute_force(spark, seed, least, longest, most):
    rows = prose(seed)
    got = co.top_phrases(co.phrase_scores(spark.createDataFrame(rows, SCHEMA), least, longest), most).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, longest, most)


def test_streams_over_many_partitions_and_tiny_filters(spark, monkeypatch):
    """Phrases whose beginnings lie in earlier partitions, filters that let all through, and slices of a few words."""
    monkeypatch.setattr(co, "SLICE_BYTES", 300)
    monkeypatch.setattr(co, "HELD_HASHES", 100)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 61)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = prose(9)
        got = co.top_phrases(co.phrase_scores(spark.createDataFrame(rows, SCHEMA), 2, 5, filter_bits=64), 3000).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == brute(rows, 2, 5, 3000)


def test_walk_carries_beginnings_over_borders():
    phrases = sorted({tuple(random.Random(i).choices("abc", k=k)) for i in range(200) for k in (1, 2, 3, 4)})
    phrases = sorted({p[:k] for p in phrases for k in range(1, len(p) + 1)})
    rows = [("en", list(p), 1000 - i) for i, p in enumerate(phrases)]
    want = {tuple(w): (b, e) for _, w, _, b, e in co._walk(iter(rows), {})}
    f = {tuple(w): n for _, w, n in rows}
    assert all(b == [f[p[:k]] for k in range(1, len(p))] and e == max([f[q] for q in f if q[:-1] == p], default=0) for p, (b, e) in want.items())


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 10 ** 12 + 7, 10 ** 15 + 3, 10 ** 13 + 9, 3 * 10 ** 12 + 1
    got = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(co._score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert co.phrase_scores(empty).count() == 0
    rows = [("x y z " * 50_000, "en"), ("x y z", None)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ["words", "f", "n", "total", "_text", "rank"]})
    got = co.phrase_scores(clash, 100).collect()
    assert {tuple(r["words"]) for r in got} == {tuple((["x", "y", "z"] * 3)[i:i + 5]) for i in range(3)} | {tuple((["x", "y", "z"] * 3)[i:i + m]) for m in (2, 3, 4) for i in range(3)} - {
        tuple(p) for p in ((["x", "y", "z"] * 3)[i:i + m] for m in (2, 3, 4) for i in range(3)) if any(tuple(p) == q for q in dropped(rows[0][0]))}


def dropped(text):
    """Phrases of 2 to 4 words that stand inside a longer candidate as often as alone."""
    words = text.split()
    f = Counter(tuple(words[i:i + m]) for m in range(2, 6) for i in range(len(words) - m + 1))
    return {p for p in f if len(p) < 5 and any(f[q] == f[p] for q in f if len(q) == len(p) + 1 and (q[:-1] == p or q[1:] == p))}


def test_hash_counts_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(co, "BATCH_ROWS", 7)
    monkeypatch.setattr(co, "HELD_HASHES", 20)
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=30)) for _ in range(20)]
    part = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * 20})
    got = list(co._hash_counts({}, range(1, 3))(iter([part])))
    assert max(b.num_rows for b in got) <= 7
    count = Counter()
    for b in got:
        count.update(dict(zip(b.column(0).to_pylist(), [0] * b.num_rows)))
        for key, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            count[key] += n
    want = Counter(p for t in texts for m in (1, 2) for p in zip(*[t.split()[j:] for j in range(m)]))
    assert sorted(count.values()) == sorted(want.values())
    phrases = list(co._phrase_counts({}, range(1, 3))(iter([part])))
    assert max(b.num_rows for b in phrases) <= 7
    told = Counter()
    for b in phrases:
        for words, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            told[tuple(words)] += n
    assert told == want
