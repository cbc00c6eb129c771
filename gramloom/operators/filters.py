"""Row filters and data-quality reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.functions.tokens import topic_overlap
from gramloom.session import broadcast_if_small, settled


def article_pages(df: DataFrame, namespaces: Iterable[str] = ()) -> DataFrame:
    """Pages of the main or an accepted namespace that are no redirects and no templates."""
    colon = F.instr("title", ":") > 0
    prefix = F.substring_index("title", ":", 1)
    accepted = prefix.isin(list(namespaces)) if list(namespaces) else F.lit(False)
    return df.where((~colon | (accepted & (F.lower(prefix) != "template"))) & F.col("redirect").isNull())


def usable_articles(df: DataFrame, raw: str, cleaned: str, min_chars: int = 30) -> DataFrame:
    """Articles worth keeping after cleaning; the cheap tests on the raw columns come first."""
    return df.where(
        ~F.startswith(F.col(raw), F.lit("#REDIRECT"))
        & ~F.startswith(F.col("title"), F.lit("Wikipedia:"))
        & (F.length(cleaned) >= min_chars))


def is_page(action: Column, source: Column) -> Column:
    """Action line indexes a page and the source has title and text."""
    index = action["index"]
    return F.coalesce(
        index["_id"].isNotNull() & (index["_type"] == "page") & source["title"].isNotNull() & source["text"].isNotNull(),
        F.lit(False))


def with_any_topic(df: DataFrame, col: str, topics: list[str]) -> DataFrame:
    """Rows with at least one of the topics; only those topics stay."""
    wanted = F.array(*[F.lit(t) for t in topics])
    return df.where(F.arrays_overlap(F.col(col), wanted)).withColumn(col, topic_overlap(col, topics))


def keep_topics(df: DataFrame, col: str, topics: list[str]) -> DataFrame:
    """Topic lists cut down to an allowed list, order and repeats kept."""
    return df.withColumn(col, F.filter(F.col(col), lambda t: t.isin(topics)))


def require_body(df: DataFrame, body: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a body, rows without)."""
    empty = F.col(body).isNull() | (F.trim(body) == "")
    return df.where(~empty), df.where(empty)


def starts_alpha(c: Column) -> Column:
    """Text begins with a letter (or other non-digit word character)."""
    return c.rlike(r"^[\p{L}\p{Nl}\p{No}_]")


def drop_nulls(df: DataFrame, *cols: str) -> DataFrame:
    return df.na.drop(subset=list(cols) or None)


def select_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys, on, "left_semi")


def _recurring(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hashes of keys (`_h`) that more than one row has: only hashes are shuffled."""
    return settled(df.select(F.xxhash64(*keys).alias("_h")).groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h"))


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """(key..., n) of keys with several rows. Long keys are grouped by their hash first, then in full where a hash recurs."""
    likely = df.select(*key, F.xxhash64(*key).alias("_h")).join(broadcast_if_small(_recurring(df, list(key))), "_h", "left_semi")
    return likely.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def consistency_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations, rows) for boolean columns that are true where a rule is broken; one pass."""
    checks = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).cast("bigint").alias("bad")) for n, c in rules.items()])
    flagged = df.select(F.explode(checks).alias("s"))
    return flagged.groupBy(F.col("s.rule").alias("rule")).agg(
        F.sum("s.bad").alias("violations"), F.count("*").alias("rows"))


def declared_vs_actual(df: DataFrame, key: str, declared: str) -> DataFrame:
    """Counts per key beside the declared count."""
    counts = df.groupBy(key).agg(F.count("*").alias("actual"), F.max(declared).cast("bigint").alias("declared"))
    return counts.withColumn("consistent", F.col("actual") == F.col("declared"))


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every key in the given order; a struct minimum, so hot keys combine map-side.

    Rows whose key has a hash of its own need no grouping.
    """
    recurring = broadcast_if_small(_recurring(df, keys))
    hashed = df.withColumn("_h", F.xxhash64(*keys))
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.min(F.struct(*[F.col(c) for c in order + rest]))
    firsts = hashed.join(recurring, "_h", "left_semi").groupBy(*keys).agg(row.alias("_r")).select(*keys, "_r.*").select(*df.columns)
    return hashed.join(recurring, "_h", "left_anti").select(*df.columns).unionByName(firsts)
