"""Blocks of the analogy questions and words: few, so that copies of rows grow with the rows, and without influence on the answers."""

import numpy as np

from gramloom.operators import evaluation as ev


def test_blocks_stay_few():
    assert ev._n_blocks(0, 4096, 12) == 1 and ev._n_blocks(4096, 4096, 12) == 1 and ev._n_blocks(8193, 4096, 12) == 3
    assert ev._n_blocks(100_000, 4096, 12) == 7 and ev._n_blocks(630_000, 4096, 12) == 10  # 25 and 154 by size alone


def test_answers_do_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    table = rng.normal(size=(60, 8))
    words = spark.createDataFrame([(str(i), i, [float(x) for x in v]) for i, v in enumerate(table)], "token string, id long, vec array<double>")
    asked = spark.createDataFrame([(str(i % 3), str(i), str(i + 1), str(i + 2), str(i + 3)) for i in range(57)], "section string, a string, b string, c string, expected string")
    unit = table / np.linalg.norm(table, axis=1, keepdims=True)
    right = {}
    for i in range(57):
        scores = unit @ (unit[i + 1] - unit[i] + unit[i + 2])
        scores[[i, i + 1, i + 2]] = -np.inf
        right[str(i % 3)] = right.get(str(i % 3), 0) + int(scores.argmax() == i + 3)
    want = sorted([*((s, 19, n) for s, n in right.items()), ("total", 57, sum(right.values()))])
    assert want == sorted(map(tuple, ev.analogy_accuracy(words, asked).collect()))
    monkeypatch.setattr(ev, "SCORES", 100)  # few questions at a time
    assert want == sorted(map(tuple, ev.analogy_accuracy(words, asked, block=7).collect()))
