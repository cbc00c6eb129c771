"""Term statistics, vocabularies and their pruning."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gramloom.operators.order import global_rank, running_sum
from gramloom.session import checkpointed

TOTAL_ROW = "###TOTAL###"


def term_counts(df: DataFrame, key: str, tokens: Column, base: Column | None = None) -> DataFrame:
    """(token, tf, df) over all documents: one exchange, of one row per distinct token and task."""
    return corpus_counts(doc_term_counts(df, key, tokens, base))


def corpus_counts(bags: DataFrame) -> DataFrame:
    """(token, tf, df) from the bags of words (key, token, tf) of all documents."""
    return bags.groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def doc_term_counts(df: DataFrame, key: str, tokens: Column, base: Column | None = None, unique: bool = True) -> DataFrame:
    """Bag of words in long form: (key, token, tf).

    A document is one row, so its tokens are sorted and counted in place: texts are never shuffled. With
    `unique=False`, for keys that span several rows, the counts of a key's rows are added up.
    `base` is computed once per document as column `_base`, for `tokens` that read it many times.
    """
    if base is not None:
        df = df.select(key, base.alias("_base"))
    # arrays get projections of their own, where each is computed once
    arrays = df.select(key, F.sort_array(tokens).alias("_t"))
    firsts = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i == 0) | ~F.get("_t", i).eqNullSafe(F.get("_t", i - 1)))
    firsts = arrays.select(key, "_t", F.when(F.size("_t") > 0, firsts).alias("_f"))
    counted = F.transform("_f", lambda at, n: F.struct(
        F.get("_t", at).alias("token"), (F.coalesce(F.get("_f", n + 1), F.size("_t")) - at).cast("bigint").alias("tf")))
    # the outer form keeps the optimizer from adding a size test that computes the array again
    bags = firsts.select(key, F.explode_outer(counted).alias("_w")).select(key, "_w.token", "_w.tf").where(F.col("token").isNotNull())
    return bags if unique else bags.groupBy(key, "token").agg(F.sum("tf").alias("tf"))


def term_stats(df: DataFrame, key: str, tokens: Column, min_count: int = 1, totals: bool = False) -> DataFrame:
    """(token, tf, df, idf = ln(N / df)) of terms seen at least `min_count` times.

    With `totals` a row ###TOTAL### gives the token total and the number of documents.
    """
    counts = term_counts(df, key, tokens)
    n_docs = df.agg(F.count("*")).scalar()
    if not totals:
        return counts.where(F.col("tf") >= min_count).withColumn("idf", F.log(n_docs / F.col("df")))
    counts = checkpointed(counts)
    stats = counts.where(F.col("tf") >= min_count).withColumn("idf", F.log(n_docs / F.col("df")))
    total = counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tf")).select(
        F.lit(TOTAL_ROW).alias("token"), "tf", n_docs.alias("df"), F.lit(None).cast("double").alias("idf")
    )
    return stats.unionByName(total)


def min_count(df: DataFrame, n: int, col: str = "tf") -> DataFrame:
    return df.where(F.col(col) >= n)


def build_vocab(counts: DataFrame) -> DataFrame:
    """Adds ids 0, 1, ... by descending frequency, ties by token."""
    ranked = global_rank(counts, [F.desc("tf"), F.asc("token")], "id")
    return ranked.withColumn("id", F.col("id") - 1)


SMALL_TOP = 10_000


def _top(df: DataFrame, n: int | None, by: str, token: str = "asc") -> DataFrame:
    """The n rows of largest count `by`, of equal counts those with the smaller (`asc`) or larger (`desc`) token.

    A list too long for one task is cut at a count: rows above the count at which n is passed are kept without
    any order, and only rows with that very count are ranked.
    """
    if n is None:
        return df
    tie = F.asc("token") if token == "asc" else F.desc("token")
    if n <= SMALL_TOP:
        return df.orderBy(F.desc(by), tie).limit(n)
    df = checkpointed(df)
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    upto = running_sum(sizes, "_n", [F.desc(by)], "_upto")
    cut = upto.where(F.col("_upto") >= n).agg(F.max_by(F.struct(by, (n - F.col("_upto") + F.col("_n")).alias("left")), by).alias("c")).first()["c"]
    if cut is None:
        return df
    tied = global_rank(df.where(F.col(by) == cut[by]), [tie], "_rank").where(F.col("_rank") <= cut["left"]).drop("_rank")
    return df.where(F.col(by) > cut[by]).unionByName(tied)


def prune_vocab(counts: DataFrame, n_docs: Column, no_below: int = 5, no_above: float = 0.5,
                keep_n: int | None = None) -> DataFrame:
    """Terms in at least `no_below` and at most `no_above` x N documents; the `keep_n` most common by df."""
    kept = counts.where((F.col("df") >= no_below) & (F.col("df") <= n_docs * no_above))
    return _top(kept, keep_n, "df")


def top_features(counts: DataFrame, n_docs: Column, n: int | None, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """The n most frequent terms of the corpus after document-frequency pruning."""
    kept = counts.where((F.col("df") >= min_df) & (F.col("df") <= n_docs * max_df))
    return _top(kept, n, "tf")


def most_common(counts: DataFrame, n: int | None) -> DataFrame:
    return _top(counts, n, "tf")


def initial_clusters(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent words, which seed the cluster learner; of equal counts the later word comes first."""
    return _top(counts, n, "tf", "desc")


def cutoff_table(counts: DataFrame, sizes: list[int]) -> DataFrame:
    """Frequency of the token at each vocabulary size that the vocabulary reaches."""
    ranked = global_rank(counts.select("token", "tf"), [F.desc("tf"), F.asc("token")], "size")
    return ranked.where(F.col("size").isin(sizes)).select("size", "tf")


def score_band(df: DataFrame, score: str, lower: float, upper: float) -> DataFrame:
    """Terms whose score lies between two percentiles of all scores, ends included.

    Percentiles interpolate between the two nearest scores, which are found by running counts over the
    distinct scores.
    """
    hist = df.groupBy(score).agg(F.count("*").alias("_n"))
    upto = checkpointed(running_sum(hist, "_n", [F.asc(score)], "_upto"))
    places = upto.agg(F.max("_upto").alias("n"))
    bounds = []
    for p in (lower, upper):
        place = places.select((F.lit(p) * (F.col("n") - 1))).scalar()
        at = [upto.where(F.col("_upto") > f(place)).agg(F.min(score)).scalar() for f in (F.floor, F.ceil)]
        bounds.append(at[0] + (place - F.floor(place)) * (at[1] - at[0]))
    return df.withColumns({"_lo": bounds[0], "_hi": bounds[1]}).where(F.col(score).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def token_totals(df: DataFrame, tokens: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n_docs"), F.sum(F.size(tokens)).cast("bigint").alias("n_tokens"))


def token_rate(df: DataFrame, tokens: Column, write: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(n_docs, n_tokens, seconds, tokens_per_second) of one run over `df`: counted by the way while `write` consumes the rows.

    Without `write` the rows are only read. No second pass counts them.
    """
    seen = Observation("tokens")
    watched = df.observe(seen, F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size(tokens)), F.lit(0)).cast("bigint").alias("n_tokens"))
    began = time.perf_counter()
    (write or (lambda rows: rows.write.format("noop").mode("overwrite").save()))(watched)
    seconds, got = max(time.perf_counter() - began, 1e-9), seen.get
    row = (got["n_docs"], got["n_tokens"], seconds, got["n_tokens"] / seconds)
    return df.sparkSession.createDataFrame([row], "n_docs bigint, n_tokens bigint, seconds double, tokens_per_second double")


def max_length(df: DataFrame, tokens: Column) -> DataFrame:
    return df.agg(F.max(F.size(tokens)).alias("max_len"))


def topic_counts(df: DataFrame, topics: str) -> DataFrame:
    """Articles per topic beside the number of all articles."""
    n = df.agg(F.count("*")).scalar()
    counts = df.select(F.explode(topics).alias("topic")).groupBy("topic").agg(F.count("*").alias("n_articles"))
    return counts.withColumn("n_total", n)


def topic_summary(df: DataFrame, topics: str) -> DataFrame:
    """Item count, mean topics per item, and the histogram of topics."""
    n = df.agg(F.count("*")).scalar()
    mean = df.agg(F.avg(F.size(topics))).scalar()
    counts = df.select(F.explode(topics).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    return counts.withColumn("n_items", n).withColumn("mean_topics", mean)
