"""Wiki dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.operators.textops import flatten_struct, int_or

PAGE = ("title string, ns string, id string, redirect struct<_title: string>, revision struct<id: string, parentid: string, "
        "timestamp: string, contributor: struct<username: string, id: string, ip: string>, comment: string, text: string>")


def read_wiki_pages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row per page of a dump (plain or bzip2): nested metadata flattened, ids as numbers (-1 if absent)."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    flat = flatten_struct(raw.withColumn("redirect", F.col("redirect._title")), "revision")
    ids = [c for c in flat.columns if c == "id" or c.endswith("_id") or c.endswith("parentid")]
    flat = flat.withColumns({c: int_or(F.col(c)) for c in ids})
    return flat if limit is None else flat.orderBy("id").limit(limit)
