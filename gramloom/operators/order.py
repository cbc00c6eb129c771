"""Global order without a one-task window: ranks, running sums, carried-down values, top-n per group.

A sorted copy is checkpointed with a row id whose high bits are the partition and whose low bits
are the place inside it. One small table with a row per partition then turns local results into
global ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gramloom.session import checkpointed

_LOW = (1 << 33) - 1


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Sorted, checkpointed copy with `_part` (partition) and `_place` (0, 1, ... within it)."""
    ordered = df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id())
    return (
        checkpointed(ordered)
        .withColumn("_part", F.shiftright("_row", 33))
        .withColumn("_place", F.col("_row").bitwiseAND(F.lit(_LOW)))
        .drop("_row")
    )


def _before(per_part: DataFrame, value: str, name: str) -> DataFrame:
    """Sum of `value` over all earlier partitions; the table has one row per partition."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias(name))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based position of every row in the total order `order` (must be unique)."""
    placed = _placed(df, order)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = _before(counts, "_n", "_off")
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_off") + F.col("_place") + 1).cast("bigint"))
        .drop("_part", "_place", "_off")
    )


def running_sum(df: DataFrame, value: str, order: list[Column], name: str) -> DataFrame:
    """Adds the sum of `value` over all rows up to and including this one."""
    placed = _placed(df, order)
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_s"))
    offsets = _before(sums, "_s", "_off")
    local = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_local", F.sum(value).over(local))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_off") + F.col("_local")).cast("bigint"))
        .drop("_part", "_place", "_off", "_local")
    )


def carry_down(df: DataFrame, names: dict[str, str], order: list[Column]) -> DataFrame:
    """Adds, for each source column, the last non-null value at or before the row: {source: new name}."""
    placed = _placed(df, order)
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_place"))).alias(f"_v_{c}") for c in names]
    per_part = placed.groupBy("_part").agg(*latest)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_part.select("_part", *[F.last(f"_v_{c}", ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in names])
    local = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.withColumns({f"_l_{c}": F.last(c, ignorenulls=True).over(local) for c in names}).join(F.broadcast(carried), "_part")
    out = {new: F.coalesce(f"_l_{c}", f"_in_{c}") for c, new in names.items()}
    return joined.withColumns(out).drop("_part", "_place", *[f"_l_{c}" for c in names], *[f"_in_{c}" for c in names])


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, salt_on: str,
                    salts: int = 64, name: str = "rn") -> DataFrame:
    """First n rows of every group; a hot group is cut down in `salts` slices first."""
    sliced = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    part = Window.partitionBy(*group, "_salt").orderBy(*order)
    kept = sliced.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    final = Window.partitionBy(*group).orderBy(*order)
    return kept.withColumn(name, F.row_number().over(final)).where(F.col(name) <= n)


def first_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Exact row limit in a given order."""
    return df.orderBy(*order).limit(n)


def slice_rows(df: DataFrame, start: int, stop: int, order: list[Column]) -> DataFrame:
    """Rows at positions start..stop-1 (0-based) of the total order."""
    return global_rank(df, order, "_rank").where(F.col("_rank").between(start + 1, stop)).drop("_rank")


def contiguous_folds(df: DataFrame, k: int, order: list[Column], name: str = "fold") -> DataFrame:
    """k contiguous folds that cover all rows: fold f holds the ranks above ceil(f*N/k)."""
    ranked = global_rank(df, order, "_rank")
    total = df.agg(F.count("*")).scalar()
    # row i (0-based) is in fold f when ceil(f*N/k) <= i, i.e. f*N <= i*k
    fold = F.floor((F.col("_rank") - 1) * k / total).cast("int")
    return ranked.withColumn(name, fold).drop("_rank")


def word_budget(df: DataFrame, words: str, limit: int, order: list[Column]) -> DataFrame:
    """Documents up to and including the one whose running word count passes `limit`."""
    return running_sum(df, words, order, "running").where(F.col("running") - F.col(words) <= limit)


def epoch_batches(df: DataFrame, key: str, size: int, epochs: int, seed: int, shuffle: bool = True) -> DataFrame:
    """Rows in batches of `size`, newly shuffled each epoch; no empty batch."""
    repeated = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.col(key).cast("string"))) if shuffle else F.lit("")
    ranked = global_rank(repeated.withColumn("_h", place), [F.col("epoch"), F.col("_h"), F.col(key)], "_rank")
    total = df.agg(F.count("*")).scalar()
    local = F.col("_rank") - 1 - F.col("epoch") * total
    return ranked.withColumn("batch", F.floor(local / size).cast("int")).drop("_rank", "_h")


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Value of the last definition of every key."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
