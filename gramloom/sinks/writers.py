"""Writers: articles, hashed buckets, quoted CSV, conversations, vocabularies, size-bounded files, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramloom.functions.text import title_bucket, title_key
from gramloom.operators.filters import dedupe
from gramloom.operators.order import running_sum


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_articles(df: DataFrame, path: str) -> None:
    """id, title and text as JSON lines."""
    df.select("id", "title", "text").write.mode("overwrite").json(path)


def bucket_keys(df: DataFrame, order: str) -> DataFrame:
    """Adds `key` (hash of the normalised title) and `bucket`; of titles with one key the first row stays."""
    keyed = df.withColumn("_t", title_key("title")).withColumn("key", F.sha2("_t", 256)).withColumn("bucket", title_bucket("_t")).drop("_t")
    return dedupe(keyed, ["key"], [order])


def key_collisions(df: DataFrame) -> DataFrame:
    """Keys that several titles share."""
    return df.groupBy(F.sha2(title_key("title"), 256).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def write_bucketed(df: DataFrame, path: str, order: str, repeat: bool = False, slices: int = 16) -> None:
    """Articles under path/run=N/bucket=xx; keys already written are skipped unless `repeat`.

    Every call adds a run and touches no older one. A bucket is cut into `slices` write tasks.
    """
    spark, rows, run = df.sparkSession, bucket_keys(df, order), 0
    if path_exists(spark, path):
        done = spark.read.parquet(path)
        run = done.agg(F.coalesce(F.max("run") + 1, F.lit(0))).first()[0]
        if not repeat:
            rows = rows.join(done.select("key").distinct(), "key", "left_anti")
    rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(slices))).write.partitionBy("bucket").parquet(f"{path}/run={run}")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """Latest version of every article written by `write_bucketed`."""
    rows = spark.read.parquet(path)
    latest = rows.groupBy("key").agg(F.max("run").alias("run"))
    return rows.join(latest, ["key", "run"])


def write_quoted_csv(df: DataFrame, path: str, sep: str = "|") -> None:
    """CSV with header, every value quoted, array columns joined by `sep`."""
    cols = [F.array_join(f.name, sep).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_conversations(df: DataFrame, path: str) -> None:
    """Conversation store: folders by language, files sorted by author and conversation for pruning."""
    ordered = df.repartitionByRange("lang", "author_id", "conv_id").sortWithinPartitions("lang", "author_id", "conv_id")
    ordered.write.mode("overwrite").partitionBy("lang").parquet(path)


AUTHOR_BUCKETS = 64


def _open_bucketed(spark: SparkSession, name: str, path: str, columns: str, buckets: int) -> DataFrame:
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({columns}) USING parquet CLUSTERED BY (author_id) SORTED BY (author_id, conv_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_author_store(df: DataFrame, name: str, path: str, buckets: int = AUTHOR_BUCKETS) -> DataFrame:
    """Conversations and their key index as tables `name` and `name`_keys, bucketed by author and sorted by author and conversation.

    Joins of the two, or with another table in as many buckets, need no exchange; one author is read from one bucket.
    `open_author_store` finds both again from another session.
    """
    for part, rows in ((name, df), (f"{name}_keys", df.select("author_id", "conv_id"))):
        shuffled = rows.repartition(buckets, "author_id")  # a task fills one bucket
        shuffled.write.bucketBy(buckets, "author_id").sortBy("author_id", "conv_id").option("path", f"{path}/{part}").mode("overwrite").saveAsTable(part)
    return df.sparkSession.table(name)


def open_author_store(spark: SparkSession, name: str, path: str, columns: str, buckets: int = AUTHOR_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(conversations, keys) of a store that `write_author_store` wrote with these columns and buckets."""
    kinds = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(columns)}
    keys = ", ".join(f"{c} {kinds[c]}" for c in ("author_id", "conv_id"))
    return _open_bucketed(spark, name, f"{path}/{name}", columns, buckets), _open_bucketed(spark, f"{name}_keys", f"{path}/{name}_keys", keys, buckets)


def build_key_index(df: DataFrame, path: str) -> DataFrame:
    """(author_id, conv_id) index, written once and read from then on."""
    spark = df.sparkSession
    if not path_exists(spark, f"{path}/_SUCCESS"):
        df.select("author_id", "conv_id").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_vocab(df: DataFrame, path: str) -> None:
    """Vocabulary and document frequencies: compressed text for people, parquet for jobs."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    df.select("token", "tf", "df").write.mode("overwrite").option("compression", "bzip2").csv(f"{path}/text", sep="\t")


def assign_output_files(df: DataFrame, max_bytes: int, order: list, size: str = "size", per_dir: int = 100) -> DataFrame:
    """Adds `file_no` and `dir_no` of files that hold at most `max_bytes`, in order; numbers may have gaps.

    Rows of up to half the limit are cut where their running size passes a multiple of that half, so a file is never
    over the limit; a larger row is a file of its own, the only kind that can be.
    """
    half = max(max_bytes // 2, 1)
    large = (F.col(size) > half).cast("bigint")
    placed = df.withColumns({"_large": large, "_small": F.when(F.col(size) > half, 0).otherwise(F.col(size)).cast("bigint")})
    both = running_sum(running_sum(placed, "_small", order, "_end"), "_large", order, "_n_large")
    run = F.floor((F.col("_end") - F.col("_small")) / half)
    placed = both.withColumn("file_no", (run + 2 * F.col("_n_large") - F.col("_large")).cast("bigint"))
    return placed.withColumn("dir_no", F.floor(F.col("file_no") / per_dir).cast("bigint")).drop("_end", "_n_large", "_large", "_small")


def write_split(df: DataFrame, path: str, max_bytes: int, order: list, compression: str = "none") -> None:
    """JSON-lines files of bounded size, 100 per folder. Rows of one file stay together and in order."""
    sized = df.withColumn("size", F.octet_length(F.to_json(F.struct(*df.columns))) + 1)
    files = assign_output_files(sized, max_bytes, order)
    files = files.repartition("file_no").sortWithinPartitions("dir_no", "file_no", *order)
    files.drop("size").write.mode("overwrite").option("compression", compression).partitionBy("dir_no", "file_no").json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def write_templates(df: DataFrame, path: str) -> None:
    """(name, body) definitions for reuse."""
    df.select("name", "body").write.mode("overwrite").parquet(path)
