"""Newsgroup posts, news wire in SGML and XML, author-profiling corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.functions.text import decode_entities


def first(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first `limit` rows in an order; all without a limit."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def post_body(c: Column) -> Column:
    """Text after the first blank line, up to the signature."""
    body = F.try_element_at(F.split(c, "\n\n", 2), F.lit(2))
    return F.regexp_replace(F.split(body, "\n-- \n", 2)[0], r"^\s+", "")


def post_field(c: Column, field: str) -> Column:
    """Values of a header field, one per line."""
    head = F.split(c, "\n\n", 2)[0]
    hits = F.filter(F.split(head, "\n"), lambda line: F.startswith(F.lower(line), F.lit(f"{field}:")))
    return F.array_join(F.transform(hits, lambda line: F.trim(F.substring(line, len(field) + 2, 1 << 30))), "\n")


def parse_posts(df: DataFrame, text: str, fields: list[str]) -> DataFrame:
    cols = {f: post_body(F.col(text)) if f == "body" else post_field(F.col(text), f) for f in fields}
    return df.withColumns(cols).drop(text)


def read_posts(spark: SparkSession, path: str, fields: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(id, group, fields...) of posts stored as folder/group/id; the first `limit` by group and id."""
    files = spark.read.text(f"{path}/*/*", wholetext=True).select(
        F.translate(F.make_valid_utf8("value"), "�", "").alias("value"),
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("group"),
        F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).cast("int").alias("id"))
    return parse_posts(first(files, limit, "group", "id"), "value", fields or ["body", "subject"])


# List-valued elements and attributes of a news-wire document.
SGML_LISTS = ["topics", "places", "people", "orgs", "exchanges", "companies"]
SGML_ATTRS = {"id": "newid", "oldid": "oldid", "has_topics": "topics", "lewissplit": "lewissplit", "cgisplit": "cgisplit"}


def _element(c: Column, tag: str) -> Column:
    found = F.regexp_extract(c, f"(?is)<{tag}(?: [^>]*)?>(.*?)</{tag}>", 1)
    return F.when(c.rlike(f"(?is)<{tag}(?: [^>]*)?>"), F.trim(decode_entities(found)))


def parse_sgml(df: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(documents, documents without a body) from one SGML document per row."""
    c = F.col(text)
    head = F.regexp_extract(c, "(?is)<reuters([^>]*)>", 1)
    attrs = [F.regexp_extract(head, f'(?i)(?:^|\\s){name}="([^"]*)"', 1).alias(out) for out, name in SGML_ATTRS.items()]
    lists = [
        F.transform(F.regexp_extract_all(F.regexp_extract(c, f"(?is)<{tag}>(.*?)</{tag}>", 1), F.lit("(?is)<d>(.*?)</d>"), F.lit(1)),
                    decode_entities).alias(tag)
        for tag in SGML_LISTS
    ]
    body = F.regexp_extract(c, "(?is)<text[^>]*>(.*?)</text>", 1)
    docs = df.where(c.rlike("(?i)<reuters")).select(
        *attrs, _element(c, "date").alias("date_str"), *lists, _element(c, "unknown").alias("unknown"),
        _element(body, "title").alias("title"), _element(body, "dateline").alias("dateline"), _element(body, "body").alias("body"))
    docs = docs.withColumns({"id": F.col("id").try_cast("int"), "oldid": F.col("oldid").try_cast("int")})
    return docs.where("body IS NOT NULL"), docs.where("body IS NULL").select("id")


def read_sgml_news(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """News-wire documents of SGML files, the first `limit` by id; records end at the closing tag, so files split."""
    return first(parse_sgml(spark.read.option("lineSep", "</REUTERS>").text(path))[0], limit, "id")


NEWSITEM = ("_itemid string, _date string, title string, headline string, byline string, text struct<p: array<string>>, "
            "metadata struct<codes: array<struct<_class: string, code: array<struct<_code: string>>>>>")


def code_classes(codes: str) -> Column:
    """Map of code class -> codes; a class that appears again replaces the earlier one."""
    entries = F.transform(codes, lambda c: F.struct(
        F.split(c["_class"], ":")[1].alias("k"), F.coalesce(c["code"]["_code"], F.array().cast("array<string>")).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(
        k, F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"])))


def read_xml_news(spark: SparkSession, path: str, limit: int | None = None, pattern: str = "*.xml") -> DataFrame:
    """(id, date, title, headline, byline, text, codes) of news items below a folder, the first `limit` by id."""
    items = (spark.read.format("xml").option("rowTag", "newsitem").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).schema(NEWSITEM).load(path))
    return first(items, limit, "_itemid").select(F.col("_itemid").alias("id"), F.col("_date").alias("date"), "title", "headline", "byline",
                        F.col("text.p").alias("text"), code_classes("metadata.codes").alias("codes"))


def _attr(c: Column, name: str) -> Column:
    return F.regexp_extract(c, f'(?:^|\\s){name}="([^"]*)"', 1)


def _blocks(c: Column, tag: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(?is)(<{tag}[\\s>].*?</{tag}>|<{tag}[^>]*/>)"), F.lit(1))


def _text(block: Column, tag: str) -> Column:
    """Text of a block before its first child element; CDATA is taken as it stands."""
    inner = F.regexp_extract(block, f"(?is)^<{tag}[^>]*>(.*)</{tag}>$", 1)
    cdata = F.regexp_extract(inner, r"(?is)^\s*<!\[CDATA\[(.*?)\]\]>", 1)
    return F.when(inner.rlike(r"(?is)^\s*<!\[CDATA\["), cdata).otherwise(decode_entities(F.regexp_extract(inner, "(?s)^([^<]*)", 1)))


def _tag(c: Column, tag: str) -> Column:
    return F.regexp_extract(c, f"(?is)<{tag}([^>]*)>", 1)


def parse_conversations(df: DataFrame, text: str, filename: str) -> DataFrame:
    """One row per conversation with author data from the file name, and the stored values for checks."""
    name = F.split(F.regexp_extract(filename, r"([^/]+?)(?:\.[^./]*)?$", 1), "_")
    author, outer = _tag(F.col(text), "author"), _tag(F.col(text), "conversations")
    heads = df.select(
        name[0].alias("author_id"), name[1].alias("lang"), name[2].alias("age"), name[3].alias("gender"),
        _attr(author, "lang").alias("stored_lang"), _attr(author, "gender").alias("stored_gender"), _attr(author, "age_group").alias("stored_age"),
        _attr(outer, "count").try_cast("int").alias("declared"), _blocks(F.col(text), "conversation").alias("_b"))
    rows = heads.withColumn("actual", F.size("_b")).withColumn("_c", F.explode("_b"))
    return rows.select(_attr(_tag(F.col("_c"), "conversation"), "id").alias("conv_id"), "author_id", "lang", "gender", "age",
                       _text(F.col("_c"), "conversation").alias("content"), "stored_lang", "stored_gender", "stored_age", "declared", "actual")


def read_author_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversations of files named author_lang_age_gender.xml."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.xml").select("value", F.col("_metadata.file_name").alias("_f"))
    return parse_conversations(files, "value", "_f")


def parse_author_documents(df: DataFrame, text: str, author_id: str) -> DataFrame:
    """One row per document of an author; an id that appears again replaces the earlier document."""
    c = F.col(text)
    author, outer = _tag(c, "author"), _tag(c, "documents")
    rows = df.where(c.rlike("(?i)<author")).select(
        F.col(author_id).alias("author_id"), _attr(author, "lang").alias("lang"), _attr(author, "type").alias("type"),
        _attr(outer, "count").try_cast("int").alias("declared"), F.posexplode(_blocks(c, "document")).alias("_p", "_d"))
    head = _tag(F.col("_d"), "document")
    rows = rows.select("author_id", "lang", "type", "declared", "_p", _attr(head, "id").alias("document_id"),
                       _attr(head, "url").alias("url"), _text(F.col("_d"), "document").alias("text"))
    last = rows.groupBy("author_id", "document_id").agg(F.max(F.struct("_p", "lang", "type", "declared", "url", "text")).alias("_r"))
    return last.select("author_id", "document_id", "_r.lang", "_r.type", "_r.declared", "_r.url", "_r.text")


# Folders of the sub-corpora of author documents.
AUTHOR_SUBCORPORA = {
    "blogs": "pan14-author-profiling-training-corpus-english-blogs-2014-04-16",
    "reviews": "pan14-author-profiling-training-corpus-english-reviews-2014-04-16",
    "socialmedia": "pan14-author-profiling-training-corpus-english-socialmedia-2014-04-16",
    "twitter": "pan14-author-profiling-training-corpus-english-twitter-2014-04-16",
}


def read_author_documents(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.xml").select(
        "value", F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1).alias("_id"))
    return parse_author_documents(files, "value", "_id")


def read_author_subcorpora(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Documents of the named sub-corpora below `path` (all by default), each with its truth: (corpus, author, ..., gender, age)."""
    parts = []
    for name in names or AUTHOR_SUBCORPORA:
        folder = f"{path}/{AUTHOR_SUBCORPORA[name]}"
        rows = read_author_documents(spark, folder).join(read_truth(spark, f"{folder}/truth.txt"), "author_id", "left")
        parts.append(rows.select(F.lit(name).alias("corpus"), "*"))
    return reduce(DataFrame.unionByName, parts)


def parse_truth(df: DataFrame) -> DataFrame:
    parts = F.split(F.trim("value"), ":::")
    return df.where(F.size(parts) == 3).select(parts[0].alias("author_id"), parts[1].alias("gender"), parts[2].alias("age"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(author_id, gender, age) lines separated by ':::'."""
    return parse_truth(spark.read.text(path))
