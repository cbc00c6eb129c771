"""Scores of predictions, target encoding and analogy accuracy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.operators.joins import join_dictionary
from gramloom.session import settled


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"))


def f1(df: DataFrame, positive: str | None = None) -> DataFrame:
    """F1 by average (macro, weighted, micro, and of one positive class) from one pass over (label, prediction)."""
    pairs = df.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    sides = pairs.select("label", F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"),
                         F.col("n").alias("ap"), F.lit(0).cast("bigint").alias("pp")).unionByName(
        pairs.select(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("ap"), F.col("n").alias("pp")))
    per = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "ap", "pp")])
    per = per.withColumn("f", 2 * F.col("tp") / (F.col("ap") + F.col("pp")))
    scores = [F.struct(F.lit("macro").alias("average"), F.avg("f").alias("f1")),
              F.struct(F.lit("weighted").alias("average"), (F.sum(F.col("f") * F.col("ap")) / F.sum("ap")).alias("f1")),
              F.struct(F.lit("micro").alias("average"), (2 * F.sum("tp") / (F.sum("ap") + F.sum("pp"))).alias("f1"))]
    if positive is not None:
        scores.append(F.struct(F.lit(f"binary:{positive}").alias("average"), F.max(F.when(F.col("label") == positive, F.col("f"))).alias("f1")))
    return per.agg(F.array(*scores).alias("s")).select(F.inline("s"))


def binarize(df: DataFrame, topics: str, names: list[str]) -> DataFrame:
    """One 0/1 column per topic."""
    return df.select("*", *[F.array_contains(topics, n).cast("int").alias(n) for n in names])


# rows of a block at most (vectors of 64 numbers then take 32 MB), and scores that a task holds at a time
BLOCK_ROWS = 1 << 16
SCORES = 1 << 24


def _n_blocks(n: int, block: int, cores: int) -> int:
    """Blocks of `n` rows: as few as keep all cores busy and within BLOCK_ROWS, as every row is copied for each block of the other side; none below `block` rows."""
    return max(1, min(math.ceil(n / block), max(math.ceil(n / BLOCK_ROWS), math.ceil(math.sqrt(4 * cores)))))


def analogy_accuracy(vectors: DataFrame, questions: DataFrame, cutoff: int | None = None, block: int = 4096) -> DataFrame:
    """Correct answers to a : b = c : ? by section and in total.

    `vectors` is (token, id, vec) with ids by falling frequency; with a `cutoff` words of that id and beyond do not
    take part. Unit vectors are compared in square blocks: each task multiplies one block of questions with one
    block of words and keeps its best word per question, so no pair rows exist.
    """
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x))
    taking_part = vectors if cutoff is None else vectors.where(F.col("id") < cutoff)
    words = settled(taking_part.select("token", "id", F.transform("vec", lambda x: x / size).alias("vec")))
    asked = ["section", "a", "b", "c", "expected"]
    q = questions.groupBy(*asked).agg(F.count("*").alias("times"))
    for role in ("a", "b", "c"):
        q = join_dictionary(q, words.select(F.col("token").alias(role), F.col("vec").alias(f"v_{role}")), role)
    q = join_dictionary(q, words.select(F.col("token").alias("expected")), "expected")
    target = F.zip_with(F.zip_with("v_b", "v_a", lambda x, y: x - y), "v_c", lambda x, y: x + y)
    n_words = (words.agg(F.max("id")).first()[0] or 0) + 1
    cores = words.sparkSession.sparkContext.defaultParallelism
    n_blocks = _n_blocks(n_words, block, cores)
    targets = settled(q.select(*asked, "times", target.alias("vec")))
    # ids fill the word blocks; questions are spread over as many blocks as needed
    n_q = _n_blocks(targets.count(), block, cores)
    left = targets.withColumn("qb", F.pmod(F.xxhash64(*asked), F.lit(n_q))).withColumn(
        "wb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = words.withColumn("wb", F.floor(F.col("id") / math.ceil(n_words / n_blocks)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))))

    def score(qs: pd.DataFrame, ws: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or ws.empty:
            return pd.DataFrame(columns=[*asked, "times", "best", "score"])
        ws = ws.sort_values("id")
        tokens = ws["token"].to_numpy()
        place = {t: i for i, t in enumerate(tokens)}
        there, asked_for = np.stack(ws["vec"].to_numpy()).T, np.stack(qs["vec"].to_numpy())
        given = list(zip(qs["a"], qs["b"], qs["c"]))
        best, top = np.zeros(len(qs), dtype=np.int64), np.zeros(len(qs))
        step = max(1, SCORES // len(ws))
        for lo in range(0, len(qs), step):
            sims = asked_for[lo:lo + step] @ there
            for row, three in enumerate(given[lo:lo + step]):
                sims[row, [place[t] for t in three if t in place]] = -np.inf
            at = sims.argmax(axis=1)
            best[lo:lo + step], top[lo:lo + step] = at, sims[np.arange(len(sims)), at]
        out = qs[[*asked, "times"]].copy()
        out["best"] = tokens[best]
        out["score"] = top
        return out[np.isfinite(out["score"])]

    schema = ", ".join(f"{c} string" for c in asked) + ", times bigint, best string, score double"
    local = left.groupBy("qb", "wb").cogroup(right.groupBy("qb", "wb")).applyInPandas(score, schema)
    best = local.groupBy(*asked, "times").agg(F.max_by("best", "score").alias("best"))
    return best.rollup("section").agg(
        F.sum("times").alias("n"), F.sum(F.when(F.col("best") == F.col("expected"), F.col("times")).otherwise(0)).alias("correct")
    ).withColumn("section", F.coalesce("section", F.lit("total")))
