"""Reproducible sampling, splitting and folding by a hash of the row key.

`md5(seed:key)` gives every row a place that any engine can recompute. Quotas are met through a
histogram of its first hexadecimal digits, so that no class is ever ranked as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gramloom.operators.order import global_rank, top_n_per_group
from gramloom.session import broadcast_if_small, settled


def place_of(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


SLICE_ROWS = 50_000


def _flag_quota(df: DataFrame, group: list[str], quotas: DataFrame, key: str, seed: int, flag: str) -> DataFrame:
    """Adds `flag`: the row is among the `quota` rows of lowest hash of its group; `quotas` has one row (group..., quota) each.

    Keys and hashes are read once and kept. A histogram of the hashes' first digits, as many as keep a slice at
    some thousand rows, tells in which slice each quota runs out; only those slices are ranked, for the hash and
    key of their last row. A second pass over the rows compares with that row.
    """
    light = settled(df.select(*group, F.col(key).alias("_k"), place_of(key, seed).alias("_h")))
    digits = max(1, math.ceil(math.log(max(light.count(), 1) / SLICE_ROWS, 16))) if light.take(1) else 1
    sliced = light.withColumn("_b", F.substring("_h", 1, digits))
    counts = settled(sliced.groupBy(*group, "_b").agg(F.count("*").alias("_n")))
    upto = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        counts.withColumn("_cum", F.sum("_n").over(upto)).join(quotas, group)
        .select(*group, "_b", (F.col("quota") - F.col("_cum") + F.col("_n")).alias("_left"), "_n").where("_left > 0 AND _left <= _n")
    )
    rank = Window.partitionBy(*group, "_b").orderBy("_h", "_k")
    ranked = sliced.join(broadcast_if_small(cuts), [*group, "_b"]).withColumn("_rn", F.row_number().over(rank))
    last = ranked.where("_rn = _left").select(*group, F.col("_h").alias("_ch"), F.col("_k").alias("_ck"))
    sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_size"))
    limits = sizes.join(quotas, group).select(*group, (F.col("quota") >= F.col("_size")).alias("_whole")).join(last, group, "left")
    h = place_of(key, seed)
    within = F.col("_whole") | (h < F.col("_ch")) | ((h == F.col("_ch")) & (F.col(key) <= F.col("_ck")))
    return df.join(broadcast_if_small(limits), group, "left").withColumn(flag, F.coalesce(within, F.lit(False))).select(*df.columns, flag)


def _by_quota(df: DataFrame, group: list[str], quotas: DataFrame, key: str, seed: int) -> DataFrame:
    """The `quota` rows of lowest hash in every group."""
    return _flag_quota(df, group, quotas, key, seed, "_in").where("_in").drop("_in")


def class_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n"))


def stratified_sample(df: DataFrame, c: str, size: int, key: str, seed: int = 0) -> DataFrame:
    """About `size` rows, every class in proportion; class shares are rounded half to even."""
    counts = class_counts(df, c)
    total = df.agg(F.count("*")).scalar()
    quotas = counts.select(c, F.bround(F.col("n") * size / total).cast("bigint").alias("quota"))
    return _by_quota(df, [c], quotas, key, seed)


def cap_per_class(df: DataFrame, c: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """At most n rows of every class."""
    quotas = class_counts(df, c).select(c, F.least(F.col("n"), F.lit(n)).cast("bigint").alias("quota"))
    return _by_quota(df, [c], quotas, key, seed)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0, replace: bool = False) -> DataFrame:
    """n rows drawn uniformly, without or with replacement."""
    if not replace:
        whole = df.withColumn("_all", F.lit(1))
        quotas = df.sparkSession.createDataFrame([(1, n)], "_all int, quota bigint")
        return _by_quota(whole, ["_all"], quotas, key, seed).drop("_all")
    ranked = global_rank(df.withColumn("_h", place_of(key, seed)), [F.col("_h"), F.col(key)], "_rank")
    total = df.agg(F.count("*")).scalar()
    spark = df.sparkSession
    # 60 bits of a hash of (seed, draw) choose the row of each draw
    bits = F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), F.col("draw").cast("string"))), 1, 15), 16, 10)
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("_rank", F.pmod(bits.cast("bigint"), total) + 1)
    return draws.join(ranked, "_rank").drop("_rank", "_h")


def stratified_split(df: DataFrame, c: str, test_size: int | float, key: str, seed: int = 0) -> DataFrame:
    """Adds `is_test`; the test part holds the same share of every class.

    `test_size` below 1 is a fraction of each class; otherwise a total that is shared out.
    """
    counts = class_counts(df, c)
    total = df.agg(F.count("*")).scalar()
    share = F.col("n") * test_size if test_size < 1 else F.col("n") * test_size / total
    quotas = counts.select(c, F.bround(share).cast("bigint").alias("quota"))
    return _flag_quota(df, [c], quotas, key, seed, "is_test")


def hash_folds(df: DataFrame, k: int, key: str, seed: int = 0, name: str = "fold") -> DataFrame:
    """Shuffled folds: a row's fold depends on its key and the seed alone."""
    bits = F.conv(F.substring(place_of(key, seed), 1, 15), 16, 10).cast("bigint")
    return df.withColumn(name, F.pmod(bits, F.lit(k)).cast("int"))


def holdout(df: DataFrame, frac: float, order: list[Column]) -> DataFrame:
    """Adds `is_train` for the first floor(frac * N) rows of an order."""
    ranked = global_rank(df, order, "_rank")
    total = df.agg(F.count("*")).scalar()
    return ranked.withColumn("is_train", F.col("_rank") <= F.floor(total * frac)).drop("_rank")


def random_holdout(df: DataFrame, frac: float, key: str, seed: int = 0) -> DataFrame:
    """Adds `is_train` for about a share `frac` of the rows, by a hash of their key."""
    bits = F.conv(F.substring(place_of(key, seed), 1, 15), 16, 10).cast("bigint")
    return df.withColumn("is_train", bits < int(frac * (1 << 60)))


def sample_dirs(df: DataFrame, path_col: str, n: int, seed: int = 0) -> DataFrame:
    """The first n files after the directories were put in hash order, files by name within each."""
    placed = df.withColumn("_dir", F.regexp_extract(path_col, "^(.*)/[^/]*$", 1))
    placed = placed.withColumn("_h", place_of("_dir", seed))
    return placed.orderBy("_h", "_dir", path_col).limit(n).drop("_h", "_dir")


def first_n_per_class(df: DataFrame, c: str, n: int, key: str, total: int | None = None) -> DataFrame:
    """The first n rows of every class in key order, and of those at most `total` overall."""
    kept = top_n_per_group(df, [c], [F.col(key)], n, key)
    return kept if total is None else kept.orderBy(key).limit(total)


def top_classes(df: DataFrame, c: str, n: int) -> DataFrame:
    """Rows of the n most frequent classes."""
    best = class_counts(df, c).orderBy(F.desc("n"), c).limit(n).select(c)
    return df.join(F.broadcast(best), c, "left_semi")
