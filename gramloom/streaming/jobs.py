"""Structured Streaming jobs. Each is the streaming form of a batch job and gives the same rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gramloom.functions.text import plain_alphabet
from gramloom.functions.tokens import analyze, char_grams_interleaved, wiki_tokens
from gramloom.operators.filters import starts_alpha
from gramloom.session import scratch_path
from gramloom.sinks.writers import path_exists


def clean_lines(df: DataFrame, mode: str, text: str = "text") -> DataFrame:
    """One tokenised line per document; lines that do not start with a letter are dropped."""
    line = F.array_join(wiki_tokens(F.trim(text), mode), " ")
    return df.withColumn("line", line).where(starts_alpha(F.col("line"))).drop(text)


def ngram_lines(df: DataFrame, lo: int, hi: int, text: str = "text") -> DataFrame:
    """One line of interleaved n-grams per document."""
    return df.withColumn("line", F.array_join(char_grams_interleaved(plain_alphabet(text), lo, hi), " ")).drop(text)


def article_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Article text on one line."""
    return df.withColumn("line", F.regexp_replace(text, r"[\r\n]+", " ")).drop(text)


def throughput(df: DataFrame, ts: str, tokens: Column, every: str = "10 seconds", watermark: str | None = "1 minute") -> DataFrame:
    """Documents and tokens per time window.

    Events later than the watermark are dropped, which bounds the state of a live stream. A backfill, whose files come
    in any order, is run without one: every event counts and a window stays in the state until the run ends.
    """
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        (timed if watermark is None else timed.withWatermark(ts, watermark))
        .groupBy(F.window(ts, every))
        .agg(F.count("*").alias("n"), F.sum(F.size(tokens)).cast("bigint").alias("tokens"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "tokens")
    )


def append_to(stream: DataFrame, path: str, state: str) -> None:
    """Write everything that is available to parquet, exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def count_tokens(stream: DataFrame, path: str, state: str, text: str = "text") -> None:
    """Adds each micro-batch's token counts as its own folder; a repeated batch replaces its folder.

    No token is kept in streaming state, so memory does not grow with the vocabulary. `compact_counts` keeps the
    number of folders small.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = batch.select(F.explode(analyze(text)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batches/batch={batch_id}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def _numbered(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete `name=number` folders below a path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n.partition("=")[2]) for n in names if path_exists(spark, f"{path}/{n}/_SUCCESS"))


def _counts(spark: SparkSession, path: str, batches: list[int]) -> tuple[DataFrame | None, int]:
    """Counts of the latest base and of the batches after it, and the number of the base (-1: none)."""
    base = max(_numbered(spark, f"{path}/base"), default=-1)
    folders = [f"{path}/base/upto={base}"] * (base >= 0) + [f"{path}/batches/batch={b}" for b in batches if b > base]
    return (spark.read.schema("token string, n bigint").parquet(*folders) if folders else None), base


def compact_counts(spark: SparkSession, path: str) -> int:
    """Sums all batches but the last, which may still be repeated, into one base folder; returns the batches removed.

    A base counts from the moment it is complete, and batches up to it no longer do, so a run that breaks off between
    writing and removing leaves the same counts.
    """
    batches = _numbered(spark, f"{path}/batches")
    counts, base = _counts(spark, path, batches[:-1])
    done = [b for b in batches[:-1]]
    if counts is None or not [b for b in done if b > base]:
        return 0
    counts.groupBy("token").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/base/upto={done[-1]}")
    old = [f"{path}/batches/batch={b}" for b in done] + [f"{path}/base/upto={base}"] * (base >= 0)
    for folder in map(spark._jvm.org.apache.hadoop.fs.Path, old):
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(done)


def counted_vocabulary(spark: SparkSession, path: str, min_count: int = 1) -> DataFrame:
    """Vocabulary so far: sum of the base and the batch counts after it."""
    counts, _ = _counts(spark, path, _numbered(spark, f"{path}/batches"))
    counts = counts if counts is not None else spark.createDataFrame([], "token string, n bigint")
    return counts.groupBy("token").agg(F.sum("n").alias("tf")).where(F.col("tf") >= min_count)


def upsert_windows(stream: DataFrame, path: str, state: str) -> None:
    """Changed windows of every micro-batch, each batch in its own folder."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("start").agg(F.max_by("n", "batch").alias("n"), F.max_by("tokens", "batch").alias("tokens"))


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drains a stateless stream into the shared folder and reads the result."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    append_to(stream, path, scratch_path(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(path)


# ---- n-grams of unbroken streams that come in blocks ----

def block_grams(tail: str, block: str, lo: int, hi: int) -> list[str]:
    """n-grams of orders lo..hi that end in `block`, by end and order; `tail` are the characters before it."""
    text = tail + block
    return [text[e - n:e] for e in range(len(tail) + 1, len(text) + 1) for n in range(lo, hi + 1) if e >= n]


def block_ngram_lines(stream: DataFrame, key: str, block: str, text: str, lo: int, hi: int) -> DataFrame:
    """(key, block, line): the n-grams that end in each block of a stream of characters, blanks and line ends as underscores.

    Blocks of a key are numbered 0, 1, ... and may come in any micro-batch and order; one that comes early waits in the
    state until those before it are there. Besides, the state of a key holds its last hi - 1 characters and the next number. Glued
    in order of their blocks, the lines hold the n-grams of the unbroken text, however it was cut. A repeated block is ignored.
    """
    kind = stream.schema[key].dataType.simpleString()

    def run(group, frames, state):
        tail, due, waiting = (state.get if state.exists else ("", 0, "{}"))
        held = {int(k): v for k, v in json.loads(waiting).items()}
        for frame in frames:
            held |= {int(b): t or "" for b, t in zip(frame["block"], frame["text"]) if b >= due and b not in held}
        rows = []
        while due in held:
            piece = held.pop(due)
            rows.append((group[0], due, " ".join(block_grams(tail, piece, lo, hi))))
            tail, due = (tail + piece)[len(tail + piece) - (hi - 1):] if hi > 1 and len(tail + piece) >= hi else (tail + piece if hi > 1 else ""), due + 1
        state.update((tail, due, json.dumps(held)))
        yield pd.DataFrame(rows, columns=["key", "block", "line"])

    blocks = stream.select(F.col(key).alias("key"), F.col(block).cast("bigint").alias("block"), F.translate(text, " \t\r\n", "____").alias("text"))
    told = blocks.groupBy("key").applyInPandasWithState(run, f"key {kind}, block bigint, line string", "tail string, due bigint, waiting string", "append", "NoTimeout")
    return told.withColumnsRenamed({"key": key, "block": block})


# ---- token rates ----

class RateListener(StreamingQueryListener):
    """Keeps documents, tokens and seconds of every micro-batch that `observe_tokens` counts."""

    def __init__(self, name: str = "tokens"):
        super().__init__()
        self.name, self.rows = name, []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if seen is not None and seen["n_docs"]:
            self.rows.append((p.batchId, seen["n_docs"], seen["n_tokens"], max(p.durationMs.get("triggerExecution", 0), 1) / 1000))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """(batch_id, n_docs, n_tokens, seconds, tokens_per_second)."""
        rows = spark.createDataFrame(self.rows, "batch_id bigint, n_docs bigint, n_tokens bigint, seconds double")
        return rows.withColumn("tokens_per_second", F.col("n_tokens") / F.col("seconds"))


def observe_tokens(df: DataFrame, tokens: Column, name: str = "tokens") -> DataFrame:
    """The same rows; whoever runs them can read the number of documents and tokens that went by."""
    return df.observe(name, F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size(tokens)), F.lit(0)).cast("bigint").alias("n_tokens"))


def stream_rates(stream: DataFrame, tokens: Column, path: str, state: str) -> DataFrame:
    """Drains a stream into parquet and tells the token rate of each micro-batch."""
    spark, listener = stream.sparkSession, RateListener()
    spark.streams.addListener(listener)
    try:
        query = observe_tokens(stream, tokens).writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    return listener.table(spark)
