"""Line-oriented readers: tagged sentences, token streams, term scores, word clusters, labelled files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.functions.text import strip_tag
from gramloom.operators.clusters import parse_clusters
from gramloom.operators.order import carry_down
from gramloom.operators.vocab import TOTAL_ROW

# GB18030 text may be cut at ASCII markup: no byte of a wider character equals '<', '/' or a line end.
CHARSET_SWITCH = "spark.sql.legacy.javaCharsets"


def numbered_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines with a sortable place `line` (file, split, row): the order in which files hold them."""
    text = spark.read.options(**options).text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    return text.select("value", F.struct("_f", "_b", F.monotonically_increasing_id().alias("_r")).alias("line"))


def take(df: DataFrame, limit: int | None, order: str = "line") -> DataFrame:
    return df if limit is None else df.orderBy(order).limit(limit)


def read_tagged_sentences(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Token lists of <s> ... </s> lines; empty and untagged lines are dropped. Gzip is read as is."""
    lines = numbered_lines(spark, path)
    tokens = F.filter(F.split(strip_tag("value"), r"\s+"), lambda t: t != "")
    return take(lines.select("line", tokens.alias("tokens")).where(F.size("tokens") > 0), limit)


def read_token_stream(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of an unbroken stream; a space ends a record, so the file splits anywhere."""
    pieces = spark.read.option("lineSep", " ").text(path)
    return pieces.select(F.explode(F.split("value", r"\s+")).alias("token")).where("token <> ''")


def read_term_scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms with tf, df, idf; the totals row with n_tokens, n_docs)."""
    rows = spark.read.schema("term string, tf bigint, df bigint, idf double").csv(path, sep="\t", quote="")
    totals = rows.where(F.col("term") == TOTAL_ROW).select(F.col("tf").alias("n_tokens"), F.col("df").alias("n_docs"))
    return rows.where(F.col("term") != TOTAL_ROW), totals


def read_clusters(spark: SparkSession, path: str, prefix_size: int = 16) -> tuple[DataFrame, DataFrame]:
    return parse_clusters(numbered_lines(spark, path), prefix_size)


def read_labelled_files(spark: SparkSession, files: dict[str, str], limit: int | None = None) -> DataFrame:
    """(sentence, polarity) of one file per label, the first `limit` lines of each; bytes that are no UTF-8 are left out."""
    parts = [
        take(numbered_lines(spark, path), limit).select(F.trim(F.translate(F.make_valid_utf8("value"), "�", "")).alias("sentence"), F.lit(label).alias("polarity"))
        for label, path in files.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_code_list(spark: SparkSession, path: str) -> DataFrame:
    """(code, term) pairs of a tab-separated list; blank lines and ';' comments are skipped."""
    line = F.trim("value")
    lines = spark.read.text(path).select(line.alias("value")).where("value <> '' AND NOT startswith(value, ';')")
    parts = F.split("value", "\t")
    return lines.select(parts[0].alias("code"), F.try_element_at(parts, F.lit(2)).alias("term")).where("term IS NOT NULL")


def line_xml_fields(value: Column, fields: list[str]) -> list[Column]:
    return [F.regexp_extract(value, f"(?s)<{f}>(.*)</{f}>", 1).alias(f) for f in fields]


# Elements of a news item that takes one line.
NEWS_FIELDS = ["source", "url", "title", "image", "category", "description", "rank", "pubdate"]


def read_line_xml(spark: SparkSession, path: str, fields: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """One XML element per line, its children as columns; the first `limit` elements."""
    fields = fields or NEWS_FIELDS
    lines = numbered_lines(spark, path).where(F.col("value").contains(f"<{fields[0]}>"))
    return take(lines, limit).select(*line_xml_fields(F.col("value"), fields))


def decode_charset(df: DataFrame, col: str, charset: str) -> DataFrame:
    """Bytes of a text column decoded from any charset the JVM knows."""
    spark = df.sparkSession
    before = spark.conf.get(CHARSET_SWITCH)
    spark.conf.set(CHARSET_SWITCH, "true")
    try:
        return df.withColumn(col, F.decode(F.col(col).cast("binary"), charset))
    finally:
        spark.conf.set(CHARSET_SWITCH, before)


def encode_charset(df: DataFrame, col: str, charset: str) -> DataFrame:
    """A text column whose bytes are those of the charset, ready to be written as lines."""
    spark = df.sparkSession
    before = spark.conf.get(CHARSET_SWITCH)
    spark.conf.set(CHARSET_SWITCH, "true")
    try:
        return df.withColumn(col, F.encode(F.col(col), charset).cast("string"))
    finally:
        spark.conf.set(CHARSET_SWITCH, before)


def read_block_docs(spark: SparkSession, path: str, charset: str = "GB18030", limit: int | None = None) -> DataFrame:
    """(url, docno, contenttitle, content) of <doc> blocks, one record per block."""
    blocks = decode_charset(numbered_lines(spark, path, lineSep="</doc>"), "value", charset)
    blocks = blocks.where(F.col("value").contains("<doc>"))
    fields = [F.regexp_extract("value", f"<{f}>(.*)</{f}>", 1).alias(f) for f in ("url", "docno", "contenttitle", "content")]
    return take(blocks.select("line", *fields), limit)


def url_categories(lines: DataFrame) -> DataFrame:
    """(site, cat, prefix, ord) from a list of site headings, category lines and URL lines."""
    text = F.trim("value")
    rows = lines.select("line", text.alias("v")).where("v <> ''")
    is_site, is_url = F.col("v").rlike(r"^\d+\.\s*[\p{L}\p{N}_]"), F.col("v").rlike("^http:")
    rows = rows.withColumn("s", F.when(is_site, F.regexp_extract("v", r"^\d+\.\s*([\p{L}\p{N}_]+)", 1)))
    rows = rows.withColumn("c", F.when(~is_site & ~is_url, F.regexp_replace("v", "：$", "")))
    carried = carry_down(rows, {"s": "site", "c": "cat"}, [F.col("line")])
    return carried.where(F.col("v").rlike("^http:")).select("site", "cat", F.col("v").alias("prefix"), F.col("line").alias("ord"))


def read_url_categories(spark: SparkSession, path: str, charset: str = "GB18030") -> DataFrame:
    return url_categories(decode_charset(numbered_lines(spark, path), "value", charset))
