"""Helpers shared by the operators: kept tables, Arrow batches, fixed-size bit filters, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.session import scratch_path

PIECE_BYTES = 1 << 20
ROW_GROUP_BYTES = 32 << 20


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared scratch folder and read back: computed once, and safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)  # a task holds a row group in memory
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def release() -> None:
    """Gives back what Arrow and the allocator keep for later: a Python worker stays between tasks and stages, and other workers begin beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in slices of about `limit` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        bins = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1), len(sizes)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)
    batch = None
    release()


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first `n_keys` integer columns; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            key = tuple(keys[:, lo])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)
    held, batch = [], None
    release()


def bit_filter(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """Bitmap of `bits` bits with bit `key mod bits` set for every key: a filter that never misses.

    Its size does not depend on the data; at most bits/64 rows come to the driver. With many keys it
    fills up and lets more through, which costs time and never a row.
    """
    bit = F.pmod(F.col(key), F.lit(bits))
    words = (
        keys.where(F.col(key).isNotNull())
        .groupBy(F.shiftright(bit, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, {bits}) % 64 as int))")).alias("mask"))
        .toArrow()
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out.view(np.uint64)


def in_filter(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit key is set; `keys` are read as signed, as Spark's pmod does."""
    bit = keys.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)  # a power of two, where pmod is a mask
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp): the smallest node of the connected component of every node of `edges` (a, b; longs).

    Alternating large and small stars; every round is written to the shared folder, so that nothing is
    recomputed, and only (count, checksum) pairs come to the driver.
    """
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = kept(large.where("a <> b").distinct(), name)
        low = kept(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = kept(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def sha_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
