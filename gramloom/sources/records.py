"""JSON, CSV and archive readers, and tables of vectors."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.operators.filters import dedupe, drop_nulls, is_page
from gramloom.operators.joins import attach_texts
from gramloom.operators.sampling import sample_dirs, sample_rows
from gramloom.operators.textops import flatten_struct

ACTION = "index struct<_id: string, _type: string>"
SOURCE = "title string, text string"


def search_pages(records: DataFrame) -> DataFrame:
    """(id, title, text) of pages from records that hold an action line's tail and a source line."""
    lines = F.split("value", "\n")
    action = F.from_json(F.concat(F.lit('{"index":'), lines[0]), ACTION)
    source = F.from_json(F.try_element_at(lines, F.lit(2)), SOURCE)
    parsed = records.withColumn("_a", action).withColumn("_s", source)
    return parsed.where(is_page(F.col("_a"), F.col("_s"))).select(
        F.col("_a.index._id").alias("id"), F.col("_s.title").alias("title"), F.col("_s.text").alias("text"))


def read_search_dump(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Pages of an index dump with alternating action and source lines (plain, gzip or bzip2)."""
    records = spark.read.option("lineSep", '{"index":').text(path).where(F.length(F.trim("value")) > 0)
    out = search_pages(records)
    return out if limit is None else out.orderBy(F.col("id").try_cast("bigint"), "id").limit(limit)


def read_json_tree(spark: SparkSession, path: str, schema: str, limit: int | None = None, shuffle_seed: int | None = None) -> DataFrame:
    """One object per file below a folder, unreadable files skipped; `limit` files, directories shuffled if seeded."""
    corrupt = "_corrupt_record"
    rows = (
        spark.read.schema(f"{schema}, {corrupt} string")
        .option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
        .select("*", F.col("_metadata.file_path").alias("path"))
    )
    good = rows.where(F.col(corrupt).isNull()).drop(corrupt)
    if limit is None:
        return good
    return sample_dirs(good, "path", limit, shuffle_seed) if shuffle_seed is not None else good.orderBy("path").limit(limit)


def read_json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None, order: str | None = None) -> DataFrame:
    """One object per line; the first `limit` by the field `order`."""
    rows = spark.read.schema(schema).json(path)
    return rows if limit is None else rows.orderBy(order or rows.columns[0]).limit(limit)


# Fields of the review dumps.
REVIEW_SCHEMA = ("reviewerID string, asin string, reviewerName string, helpful array<int>, reviewText string, "
                 "overall double, summary string, unixReviewTime bigint, reviewTime string")
STAR_SCHEMA = ("review_id string, user_id string, business_id string, stars int, date string, text string, type string, "
               "votes struct<useful: bigint, cool: bigint, funny: bigint>")


def read_reviews_with_source(spark: SparkSession, path: str, schema: str = REVIEW_SCHEMA, limit: int | None = None) -> DataFrame:
    """JSON-lines reviews with the name of the file they come from; the first `limit` by product and reviewer."""
    if limit is not None:
        return read_reviews_with_source(spark, path, schema).orderBy("asin", "reviewerID").limit(limit)
    return spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("sourcefile"))


def flatten_votes(df: DataFrame) -> DataFrame:
    flat = flatten_struct(df, "votes")
    votes = [c for c in flat.columns if c.startswith("votes_")]
    return flat.withColumns({c: F.col(c).cast("int") for c in votes})


def read_star_reviews(spark: SparkSession, path: str, limit: int | None = None, schema: str = STAR_SCHEMA) -> DataFrame:
    """JSON-lines reviews with the vote counters as integer columns."""
    flat = flatten_votes(spark.read.schema(schema).json(path))
    return flat if limit is None else flat.orderBy("review_id").limit(limit)


def read_indexed_texts(spark: SparkSession, index: str, folder: str, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Rows of a CSV index (file name, prompt, first language, difficulty) with the text of their files."""
    rows = spark.read.schema("filename string, prompt string, l1 string, difficulty string").csv(index)
    texts = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))
    joined = attach_texts(rows, texts)
    return joined if sample is None else sample_rows(joined, sample, "filename", seed)


def class_rows(df: DataFrame, order: str = "_row") -> DataFrame:
    """Rows without nulls, one per (category, abstract): the first in file order."""
    kept = drop_nulls(df, "title", "abstract")
    return dedupe(kept, ["category", "abstract"], [order]).drop(order)


# The classes of the ontology sample.
ONTOLOGY_CLASSES = ["SportsTeam", "SocietalEvent", "MeanOfTransportation", "Plant", "EducationalInstitution", "OfficeHolder",
                    "WrittenWork", "NaturalPlace", "Building", "Company", "Infrastructure", "Film", "SoccerPlayer", "Artist"]


def read_class_csvs(spark: SparkSession, path: str, classes: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Union of one CSV (title, abstract) per class, the first `limit` rows of each, cleaned per class."""
    parts = [
        spark.read.schema("title string, abstract string").csv(f"{path}/{name.lower()}.csv", header=True, multiLine=True, escape='"')
        .withColumn("category", F.lit(name)).withColumn("_row", F.monotonically_increasing_id())
        for name in classes or ONTOLOGY_CLASSES
    ]
    if limit is not None:
        parts = [part.orderBy("_row").limit(limit) for part in parts]
    return class_rows(reduce(DataFrame.unionByName, parts))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word vectors (token, vec) from parquet."""
    return spark.read.schema("token string, vec array<float>").parquet(path)


def unpack_archives(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries: archive, name, content; corrupt archives: archive, error) of zip bytes (archive, content).

    An archive is unpacked inside the task that holds its bytes.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["archive"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            if not name.endswith("/"):
                                yield pd.DataFrame({"archive": [archive], "name": [name], "content": [z.read(name)], "error": [None]})
                except Exception as exc:  # noqa: BLE001 - any damage sends the archive to quarantine
                    yield pd.DataFrame({"archive": [archive], "name": [None], "content": [None], "error": [str(exc)]})

    rows = files.mapInPandas(unpack, "archive string, name string, content binary, error string")
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("archive", "error")


def explode_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries and corrupt archives of the zip files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return unpack_archives(files.select(F.regexp_extract("path", "([^/]+)[.]zip$", 1).alias("archive"), "content"))
