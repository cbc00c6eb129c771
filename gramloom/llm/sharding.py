"""Contiguous shards of nearly equal size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.tables import kept, table

SHARDS = 16
LAW = "bytes"


def assign_shards(sized: DataFrame, size: str, order: list[str], shards: int = SHARDS) -> DataFrame:
    """`sized` with shard (0 to shards - 1) and slot (0, 1, ... within its shard, without gaps).

    Rows are taken in the order of the columns `order` (nulls first); rows equal in all of them, repeated rows
    above all, follow each other in any order. A row belongs to the shard in which the middle of its bytes falls
    when all bytes are cut into `shards` equal parts, so shards are contiguous and differ from the target by half
    a row at either end. Sizes are at least 1; a null size counts as 1.

    Rows are range-partitioned once and kept with their partition; equal keys are spread over partitions by a
    second random-free key, the row's place in its scan. Totals per partition give each partition its offset, a
    running sum inside the partition does the rest.
    """
    names = [c for c in sized.columns if c not in ("shard", "slot")]
    spread = sized.select(*names).withColumn("_place", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(*order, "_place").sortWithinPartitions(*order, "_place")
    placed = kept(ordered.withColumns({"_part": F.spark_partition_id(), "_bytes": F.greatest(F.coalesce(F.col(size), F.lit(1)), F.lit(1)).cast("bigint")}), "shard-rows")

    parts = placed.groupBy("_part").agg(F.sum("_bytes").alias("_sum"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = parts.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in ("_sum", "_n")], F.sum("_sum").over(whole).alias("_total"))
    inside = Window.partitionBy("_part").orderBy(*order, "_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.withColumns({"_upto": F.sum("_bytes").over(inside), "_rank": F.row_number().over(inside)}).join(F.broadcast(offsets), "_part")
    middle = (F.col("_before_sum") + F.col("_upto")).cast("decimal(38,0)") * 2 - F.col("_bytes")
    cut = sums.withColumn("shard", F.floor(middle * shards / (F.col("_total").cast("decimal(38,0)") * 2)).cast("int"))
    cut = kept(cut.withColumn("_rank", F.col("_before_n") + F.col("_rank") - 1), "shard-cut")
    first = cut.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row for each shard
    return cut.join(F.broadcast(first), "shard").select(*names, "shard", (F.col("_rank") - F.col("_first")).cast("bigint").alias("slot"))


def op6_sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit("")).cast("binary")
    sized = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return assign_shards(sized, "size", ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# CRC-32 bit by bit: eight shifts of the reflected polynomial 0xEDB88320 for each byte
SQL = """
WITH RECURSIVE crc AS (SELECT n::UBIGINT AS n, n::UBIGINT AS v, 0 AS k FROM range(256) t(n)
    UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8),
t AS (SELECT list(v ORDER BY n) AS l FROM crc WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT) AS b FROM documents),
c AS (SELECT doc_id, size, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, b),
    lambda x, y: xor(x >> 8, t.l[(xor(x, y) & 255)::BIGINT + 1])))::BIGINT AS text_crc32 FROM d, t),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM c),
p AS (SELECT *, ((2 * upto - size) * 16 // (2 * total))::INT AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM p
"""
