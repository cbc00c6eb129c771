"""Readers and writers over the given tables: a table is written in a corpus format and read back."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from gramloom.functions.tokens import analyze
from gramloom.operators import joins as jn
from gramloom.operators import order, vocab
from gramloom.plans import sqlkit as k
from gramloom.plans.base import documents, pages, query, table
from gramloom.session import scratch_path, settled, spread
from gramloom.sinks import writers as wr
from gramloom.sources import lines as ln
from gramloom.sources import news as nw
from gramloom.sources import records as rc
from gramloom.sources import wiki as wk

ONE_LINE = r"regexp_replace(trim(text), '\s+', ' ', 'g')"


def _one_line(c="text"):
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def _write_lines(spark, df, name, **options):
    path = scratch_path(spark, name)
    df.write.options(**options).text(path)
    return path


def _xml_text(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query("src_01_post_fields", """
SELECT doc_id, lang AS subject, source || chr(10) || 'x' AS "from",
  regexp_replace(replace(text, chr(10) || chr(10), chr(10) || ' ' || chr(10)), '^\\s+', '') AS body FROM documents""")
def src_01(spark, sf):
    post = F.concat(F.lit("From: "), "source", F.lit("\nSubject:  "), "lang", F.lit("\nfrom: x\n\n"), F.replace("text", F.lit("\n\n"), F.lit("\n \n")), F.lit("\n-- \nsig"))
    posts = documents(spark, sf, "doc_id", "source", "lang", "text").select("doc_id", post.alias("value"))
    return nw.parse_posts(posts, "value", ["subject", "from", "body"])


@query("src_02_sgml_news", f"""
SELECT CAST(doc_id AS INTEGER) AS id, CAST(doc_id + 5 AS INTEGER) AS oldid, lang || '|' || source AS topics, '' AS places, trim({ONE_LINE}) AS body
FROM documents WHERE doc_id % 10 > 0""")
def src_02(spark, sf):
    body = F.when(F.col("doc_id") % 10 > 0, F.concat(F.lit("<BODY>"), _xml_text(_one_line()), F.lit("</BODY>"))).otherwise("")
    sgml = F.concat(
        F.lit('<REUTERS TOPICS="YES" LEWISSPLIT="TRAIN" CGISPLIT="X" OLDID="'), (F.col("doc_id") + 5).cast("string"), F.lit('" NEWID="'), F.col("doc_id").cast("string"),
        F.lit('">\n<DATE>26-FEB-1987</DATE>\n<TOPICS><D>'), "lang", F.lit("</D><D>"), "source", F.lit("</D></TOPICS>\n<PLACES></PLACES>\n<TEXT>\n<TITLE>t</TITLE>"), body, F.lit("</TEXT>\n</REUTERS>"))
    path = _write_lines(spark, documents(spark, sf, "doc_id", "lang", "source", "text").select(sgml), "sgml")
    docs = nw.read_sgml_news(spark, path)
    return docs.select("id", "oldid", F.array_join("topics", "|").alias("topics"), F.array_join("places", "|").alias("places"), "body")


@query("src_03_xml_news", r"""
SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, '1996-08-20' AS date,
  array_to_string(list_transform(string_split(text, chr(10)), lambda p: 'p ' || regexp_replace(trim(p), '\s+', ' ', 'g')), '|') AS paragraphs, lang || ' ' || source AS topics FROM documents""")
def src_03(spark, sf):
    docs = documents(spark, sf, "doc_id", "text", "lang", "source")
    codes = F.array(F.struct(F.lit("bip:topics:1.0").alias("_class"), F.array(F.struct(F.col("lang").alias("_code")), F.struct(F.col("source").alias("_code"))).alias("code")))
    line = lambda p: F.concat(F.lit("p "), F.regexp_replace(F.trim(p), r"\s+", " "))
    items = docs.select(F.col("doc_id").cast("string").alias("_itemid"), F.lit("1996-08-20").alias("_date"), F.col("source").alias("title"),
                        F.struct(F.transform(F.split("text", "\n"), line).alias("p")).alias("text"), F.struct(codes.alias("codes")).alias("metadata"))
    path = scratch_path(spark, "xmlnews")
    items.write.format("xml").option("rowTag", "newsitem").option("rootTag", "items").save(path)
    # Spark names its own files, so the corpus' file pattern does not hold
    rows = nw.read_xml_news(spark, path, pattern="part-*")
    paragraphs = F.array_join(F.transform("text", lambda p: F.rtrim(p)), "|")
    return rows.select("id", "title", "date", paragraphs.alias("paragraphs"), F.array_join(F.col("codes")["topics"], " ").alias("topics"))


@query("src_05_author_conversations", f"""
SELECT conv_id || 't' || turn AS author_id, 'en' AS lang, '20s' AS age, x.i AS conv_id, {ONE_LINE} AS content, role AS stored_gender, 2 AS actual
FROM conversations, (VALUES ('c1'), ('c2')) AS x(i)""")
def src_05(spark, sf):
    conv = spread(table(spark, sf, "conversations"), "conv_id")
    body = _xml_text(_one_line())
    piece = lambda i: F.concat(F.lit(f'<conversation id="{i}">'), body, F.lit("</conversation>\n"))
    xml = F.concat(F.lit('<author lang="en" gender="'), "role", F.lit('" age_group="20s">\n<conversations count="2">\n'), piece("c1"), piece("c2"), F.lit("</conversations></author>"))
    name = F.concat(F.col("conv_id").cast("string"), F.lit("t"), F.col("turn").cast("string"), F.lit("_en_20s_male.xml"))
    rows = nw.parse_conversations(conv.select(name.alias("f"), xml.alias("value")), "value", "f")
    return rows.select("author_id", "lang", "age", "conv_id", "content", "stored_gender", "actual")


@query("src_06_author_documents", f"""
SELECT 'a' || d.doc_id AS author_id, x.i AS document_id, {ONE_LINE} || x.i AS text, CASE WHEN quality = 1 THEN 'f' ELSE 'm' END AS gender
FROM documents d JOIN labels l USING (doc_id), (VALUES ('1'), ('2')) AS x(i)""")
def src_06(spark, sf):
    doc = lambda i: F.concat(F.lit(f'<document id="{i}" url="u{i}"><![CDATA['), _one_line(), F.lit(f"{i}]]></document>\n"))
    xml = F.concat(F.lit('<author type="blog" lang="en">\n<documents count="2">\n'), doc(1), doc(2), F.lit("</documents></author>"))
    authors = documents(spark, sf, "doc_id", "text").select(F.concat(F.lit("a"), "doc_id").alias("id"), xml.alias("value"))
    truth = table(spark, sf, "labels").select(F.concat(F.lit("a"), "doc_id", F.lit(":::"), F.when(F.col("quality") == 1, "f").otherwise("m"), F.lit(":::20s")).alias("value"))
    rows = nw.parse_author_documents(authors, "value", "id").join(nw.parse_truth(truth), "author_id")
    return rows.select("author_id", "document_id", "text", "gender")


@query("src_07_tagged_sentences", rf"""
SELECT array_to_string(regexp_split_to_array({ONE_LINE}, '\s+'), '|') AS tokens, CAST(len(regexp_split_to_array({ONE_LINE}, '\s+')) AS INTEGER) AS n FROM documents""")
def src_07(spark, sf):
    tagged = documents(spark, sf, "doc_id", "text").select(F.concat(F.lit("<s> "), _one_line(), F.lit(" </s>")))
    rows = ln.read_tagged_sentences(spark, _write_lines(spark, tagged, "tagged", compression="gzip"))
    return rows.select(F.array_join("tokens", "|").alias("tokens"), F.size("tokens").alias("n"))


@query("src_08_wiki_pages", """
SELECT doc_id AS id, 'T' || source || doc_id AS title, CASE WHEN doc_id % 9 = 0 THEN 'elsewhere' END AS redirect, doc_id * 10 AS revision_id,
  -1 AS revision_parentid, lang AS revision_contributor_username, trim(text) AS revision_text FROM documents""")
def src_08(spark, sf):
    docs = documents(spark, sf, "doc_id", "text", "source", "lang")
    xml = docs.select(
        F.concat(F.lit("T"), "source", "doc_id").alias("title"), F.lit("0").alias("ns"), F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 9 == 0, F.struct(F.lit("elsewhere").alias("_title"))).alias("redirect"),
        F.struct((F.col("doc_id") * 10).alias("id"), F.struct(F.col("lang").alias("username")).alias("contributor"),
                 F.struct(F.col("text").alias("_VALUE"), F.lit("preserve").alias("_space")).alias("text")).alias("revision"))
    path = scratch_path(spark, "wiki")
    xml.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return wk.read_wiki_pages(spark, path).select("id", "title", "redirect", "revision_id", "revision_parentid", "revision_contributor_username", F.trim("revision_text").alias("revision_text"))


@query("src_09_search_dump", """
SELECT CAST(page_id AS VARCHAR) AS id, url AS title, html AS text FROM pages WHERE page_id % 6 > 0 AND page_id % 7 > 0""")
def src_09(spark, sf):
    kind = F.when(F.col("page_id") % 6 > 0, "page").otherwise("redirect")
    action = F.to_json(F.struct(F.struct(kind.alias("_type"), F.col("page_id").cast("string").alias("_id")).alias("index")))
    source = F.to_json(F.struct(F.when(F.col("page_id") % 7 > 0, F.col("url")).alias("title"), F.col("html").alias("text")))
    path = _write_lines(spark, pages(spark, sf).select(F.concat(action, F.lit("\n"), source)), "search")
    return rc.read_search_dump(spark, path)


@query("src_10_json_lines", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def src_10(spark, sf):
    events = spread(table(spark, sf, "events").select("event_id", "props"), "event_id")
    rows = events.select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "props": '), "props", F.lit("}")))
    out = rc.read_json_lines(spark, _write_lines(spark, rows, "jsonl"), "event_id bigint, props struct<k: bigint>")
    return out.select("event_id", F.col("props.k").alias("k"))


@query("src_10_json_tree", "SELECT item_id, text FROM benchmark")
def src_10_tree(spark, sf):
    path = scratch_path(spark, "tree")
    table(spark, sf, "benchmark").repartition(4).write.option("maxRecordsPerFile", 1).json(f"{path}/a")
    return rc.read_json_tree(spark, path, "item_id bigint, text string").select("item_id", "text")


@query("src_11_reviews_with_source", "SELECT CAST(doc_id AS VARCHAR) AS asin, text AS \"reviewText\", n_chars * 1.0::DOUBLE AS overall, true AS has_source FROM documents")
def src_11(spark, sf):
    docs = documents(spark, sf, "doc_id", "text", "n_chars").select(F.col("doc_id").cast("string").alias("asin"), F.col("text").alias("reviewText"), F.col("n_chars").cast("double").alias("overall"))
    path = scratch_path(spark, "reviews")
    docs.write.option("compression", "gzip").json(path)
    rows = rc.read_reviews_with_source(spark, path)
    return rows.select("asin", "reviewText", "overall", F.endswith("sourcefile", F.lit(".json.gz")).alias("has_source"))


@query("src_12_star_reviews", """
SELECT CAST(doc_id AS VARCHAR) AS review_id, CAST(n_chars % 5 + 1 AS INTEGER) AS stars, CAST(doc_id % 3 AS INTEGER) AS votes_useful,
  CAST(doc_id % 4 AS INTEGER) AS votes_cool, CAST(doc_id % 5 AS INTEGER) AS votes_funny FROM documents""")
def src_12(spark, sf):
    d = F.col("doc_id")
    docs = documents(spark, sf, "doc_id", "text", "n_chars").select(
        d.cast("string").alias("review_id"), (F.col("n_chars") % 5 + 1).alias("stars"), "text", F.struct((d % 3).alias("useful"), (d % 4).alias("cool"), (d % 5).alias("funny")).alias("votes"))
    path = scratch_path(spark, "stars")
    docs.write.json(path)
    return rc.read_star_reviews(spark, path).select("review_id", "stars", "votes_useful", "votes_cool", "votes_funny")


@query("src_13_line_xml", r"""
SELECT url AS source, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS category FROM pages""")
def src_13(spark, sf):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    cat = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    line = F.concat(F.lit("<source>"), "url", F.lit("</source><title>"), title, F.lit("</title><category>"), cat, F.lit("</category>"))
    path = _write_lines(spark, pages(spark, sf).select(line), "linexml")
    return ln.read_line_xml(spark, path, ["source", "title", "category"])


@query("src_14_labelled_files", f"""
SELECT trim({ONE_LINE}) AS sentence, CASE WHEN item_id % 2 = 0 THEN 'pos' ELSE 'neg' END AS polarity FROM benchmark""")
def src_14(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", _one_line().alias("s"))
    files = {label: _write_lines(spark, items.where(F.col("item_id") % 2 == rest).select("s"), label) for label, rest in (("pos", 0), ("neg", 1))}
    return ln.read_labelled_files(spark, files)


@query("src_15_block_docs", f"SELECT url, CAST(page_id AS VARCHAR) AS docno, 't' || page_id AS contenttitle, '中文' || page_id AS content FROM pages")
def src_15(spark, sf):
    p = pages(spark, sf, "page_id", "url")
    d = F.col("page_id").cast("string")
    block = F.concat(F.lit("<doc>\n<url>"), "url", F.lit("</url>\n<docno>"), d, F.lit("</docno>\n<contenttitle>t"), d, F.lit("</contenttitle>\n<content>中文"), d, F.lit("</content>\n</doc>"))
    return ln.read_block_docs(spark, _write_lines(spark, p.select(block), "blocks"), charset="UTF-8").drop("line")


@query("src_15_charset_docs", r"""
SELECT url, CAST(page_id AS VARCHAR) AS docno, '标题' || page_id AS contenttitle, '中文 ' || regexp_replace(translate(html, '<>', '()'), '\s+', ' ', 'g') AS content FROM pages""")
def src_15_charset(spark, sf):
    """Whole pages as blocks in GB18030 files, read back through the reader."""
    content = F.concat(F.lit("中文 "), F.regexp_replace(F.translate("html", "<>", "()"), r"[ \t\n\f\r]+", " "))
    number = F.col("page_id").cast("string")
    block = F.concat(F.lit("<doc>\n<url>"), "url", F.lit("</url>\n<docno>"), number, F.lit("</docno>\n<contenttitle>标题"), number, F.lit("</contenttitle>\n<content>"), content, F.lit("</content>\n</doc>"))
    written = ln.encode_charset(pages(spark, sf, "page_id", "url", "html").select(block.alias("value")), "value", "GB18030")
    return ln.read_block_docs(spark, _write_lines(spark, written, "charset-blocks")).drop("line")


CATEGORY = "['体育', '财经', '教育', '旅游', '其他'][CAST(length(host) % 5 AS INTEGER) + 1]"


@query("jn_05_english_category", rf"""
WITH p AS (SELECT page_id, regexp_replace(url, '^https:', 'http:') AS url FROM pages), h AS (SELECT page_id, url, regexp_extract(url, '^http://([^/]+)/', 1) AS host FROM p),
  c AS (SELECT page_id, url, CASE WHEN host <> '' THEN 's' || length(host) END AS site, CASE WHEN host <> '' THEN {CATEGORY} END AS cat FROM h)
SELECT *, CASE cat WHEN '体育' THEN 'sports' WHEN '财经' THEN 'finance' WHEN '教育' THEN 'education' WHEN '旅游' THEN 'travel' END AS cat_en FROM c""")
def jn_05_english(spark, sf):
    """Pages by the categories of a GB18030 list of sites, category lines and URL prefixes, with their English names."""
    p = pages(spark, sf, "page_id", "url").withColumn("url", F.regexp_replace("url", "^https:", "http:"))
    hosts = p.select(F.regexp_extract("url", "^http://([^/]+)/", 1).alias("host")).where("host <> ''").distinct()
    n = F.length("host")
    names = F.array(*map(F.lit, ["体育", "财经", "教育", "旅游", "其他"]))
    lines = F.array(F.concat(F.lit("7. s"), n.cast("string"), F.lit(" home")), F.concat(F.get(names, n % 5), F.lit("：")), F.lit(""), F.concat(F.lit("http://"), "host", F.lit("/")))
    rows = hosts.select("host", F.posexplode(lines).alias("i", "value")).orderBy("host", "i").select("value")
    listed = ln.read_url_categories(spark, _write_lines(spark, ln.encode_charset(rows, "value", "GB18030"), "categories"))
    return jn.categorize_by_url(p, listed).withColumn("cat_en", jn.english_category(F.col("cat")))


@query("src_16_url_categories", """
SELECT 'site' || (page_id // 10) AS site, CASE WHEN page_id >= 4 THEN 'cat' || ((page_id - 4) // 5) END AS cat, 'http:' || page_id AS prefix FROM pages""")
def src_16(spark, sf):
    p = pages(spark, sf, "page_id")
    n = F.col("page_id")
    entries = F.array_compact(F.array(
        F.when(n % 10 == 0, F.concat(((n / 10).cast("bigint") + 1).cast("string"), F.lit(". site"), (n / 10).cast("bigint").cast("string"), F.lit(" home"))),
        F.when(n % 5 == 4, F.concat(F.lit("cat"), (n / 5).cast("bigint").cast("string"), F.lit("："))), F.lit(""), F.concat(F.lit("http:"), n.cast("string"))))
    rows = p.select("page_id", F.posexplode(entries).alias("i", "value")).select("value", F.struct("page_id", "i").alias("line"))
    return ln.url_categories(rows).drop("ord")


@query("src_17_indexed_texts", f"SELECT trim({ONE_LINE}) AS text, 'p' AS prompt, 'high' AS difficulty FROM benchmark")
def src_17(spark, sf):
    path, index = scratch_path(spark, "texts"), scratch_path(spark, "index")
    table(spark, sf, "benchmark").select(_one_line().alias("value")).repartition(4).write.option("maxRecordsPerFile", 1).text(path)
    names = spark.read.text(path).select(F.col("_metadata.file_name").alias("f")).distinct()
    names.select("f", F.lit("p"), F.lit("DE"), F.lit("high")).write.csv(index)
    return rc.read_indexed_texts(spark, index, path).select(F.regexp_replace("text", r"\s+$", "").alias("text"), "prompt", "difficulty")


@query("src_18_class_tables", """
SELECT source AS title, any_value(lang) AS category, regexp_replace(text, '\\s+', ' ', 'g') AS abstract FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, regexp_replace(text, '\\s+', ' ', 'g') ORDER BY doc_id) AS rn FROM documents WHERE n_chars % 13 > 0) WHERE rn = 1 GROUP BY ALL""")
def src_18(spark, sf):
    docs = documents(spark, sf, "doc_id", "source", "text", "lang", "n_chars").select(
        "source", F.when(F.col("n_chars") % 13 > 0, F.regexp_replace("text", r"\s+", " ")).alias("abstract"), "lang", "doc_id")
    named = docs.select(F.col("source").alias("title"), "abstract", F.col("lang").alias("category"), F.col("doc_id").alias("_row"))
    return rc.class_rows(named)


@query("src_18_class_files", r"""
WITH d AS (SELECT lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS abstract FROM documents)
SELECT DISTINCT 't' || length(abstract) AS title, lang AS category, abstract FROM d WHERE abstract <> '' AND lang IN ('de', 'en', 'es', 'fr')""")
def src_18_files(spark, sf):
    """One CSV per class, read back, cleaned and without repeats."""
    path, classes = scratch_path(spark, "classes"), ["de", "en", "es", "fr"]
    abstract = F.trim(F.regexp_replace("text", r"[ \t\n\f\r]+", " "))
    docs = settled(documents(spark, sf, "lang", "text").select("lang", F.concat(F.lit("t"), F.length(abstract).cast("string")).alias("title"), abstract.alias("abstract")).where("abstract <> ''"))
    for name in classes:
        docs.where(F.col("lang") == name).select("title", "abstract").write.csv(f"{path}/{name}.csv", header=True, quoteAll=True, escape='"')
    return rc.read_class_csvs(spark, path, classes).select("title", "category", "abstract")


@query("src_19_token_stream", r"""
SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(trim(text), '\s+')) AS token FROM documents) WHERE token <> '' GROUP BY 1""")
def src_19(spark, sf):
    path = _write_lines(spark, documents(spark, sf, "doc_id", "text").select(_one_line()), "stream")
    return ln.read_token_stream(spark, path).groupBy("token").agg(F.count("*").alias("n"))


@query("src_21_vectors", "SELECT 'w' || vec_id AS token, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * i)), 6) AS weighted FROM embeddings")
def src_21(spark, sf):
    path = scratch_path(spark, "vectors")
    table(spark, sf, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("token"), F.col("embedding").alias("vec")).write.parquet(path)
    return ln_vectors(rc.read_vectors(spark, path))


def ln_vectors(df):
    weighted = F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.select("token", F.size("vec").alias("n"), F.round(weighted, 6).alias("weighted"))


@query("src_22_term_scores", f"""
WITH c AS ({k.term_counts(k.words("text"))})
SELECT token AS term, tf, df, round(ln((SELECT count(*) FROM documents) * 1.0 / df), 6) AS idf, (SELECT count(*) FROM documents) AS n_docs FROM c""")
def src_22(spark, sf):
    stats = vocab.term_stats(documents(spark, sf, "doc_id", "text"), "doc_id", analyze("text"), totals=True)
    rows = stats.select(F.concat_ws("\t", "token", "tf", "df", F.round("idf", 6)).alias("value"))
    terms, totals = ln.read_term_scores(spark, _write_lines(spark, rows, "scores"))
    return terms.withColumn("idf", F.round("idf", 6)).withColumn("n_docs", totals.select("n_docs").scalar())


@query("src_23_archives", """
SELECT CAST(doc_id AS VARCHAR) AS archive, 'd/' || doc_id || '.txt' AS name, text, CAST(NULL AS VARCHAR) AS state FROM documents WHERE doc_id % 10 > 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, 'corrupt' FROM documents WHERE doc_id % 10 = 0""")
def src_23(spark, sf):
    def pack(batches):
        for batch in batches:
            packed = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"d/{doc_id}.txt", text)
                packed.append(out.getvalue() if doc_id % 10 else out.getvalue()[:20])
            yield pd.DataFrame({"archive": batch["doc_id"].astype(str), "content": packed})

    zips = documents(spark, sf, "doc_id", "text").mapInPandas(pack, "archive string, content binary")
    entries, corrupt = rc.unpack_archives(zips)
    good = entries.select("archive", "name", F.col("content").cast("string").alias("text"), F.lit(None).cast("string").alias("state"))
    none = F.lit(None).cast("string")
    return good.unionByName(corrupt.select("archive", none.alias("name"), none.alias("text"), F.lit("corrupt").alias("state")))


# ---- sinks ----

def _articles(spark, sf):
    return documents(spark, sf, "doc_id", "text", "source", "lang").select(F.col("doc_id").alias("id"), F.concat("lang", F.lit(" "), "source", F.lit("-"), (F.col("doc_id") % 700).cast("string")).alias("title"), "text")


ART = "a AS (SELECT doc_id AS id, lang || ' ' || source || '-' || (doc_id % 700) AS title, text FROM documents)"


@query("snk_01_json_articles", f"WITH {ART} SELECT id, title, text FROM a")
def snk_01(spark, sf):
    path = scratch_path(spark, "articles")
    wr.write_articles(_articles(spark, sf), path)
    return spark.read.schema("id bigint, title string, text string").json(path)


@query("snk_02_hashed_buckets", rf"""
WITH {ART}, n AS (SELECT id, title, lower(regexp_replace(title, '[^\p{{L}}\p{{N}}_]+', '', 'g')) AS t FROM a)
SELECT sha256(t) AS key, rpad(substr(t, 1, 2), 2, '_') AS bucket, min(id) AS id, arg_min(title, id) AS title FROM n GROUP BY t""")
def snk_02(spark, sf):
    path = scratch_path(spark, "buckets")
    arts = _articles(spark, sf).drop("text")
    wr.write_bucketed(arts.where("id % 2 = 0"), path, "id")
    # the second call meets existing keys and adds only the missing ones
    wr.write_bucketed(arts.where("id % 2 = 1").join(wr.bucket_keys(arts, "id").select("id"), "id", "left_semi"), path, "id")
    return wr.read_bucketed(spark, path).groupBy("key", "bucket").agg(F.min("id").alias("id"), F.min_by("title", "id").alias("title"))


@query("snk_03_quoted_csv", "SELECT doc_id, lang || '|' || source AS topics, replace(text, chr(10), ' ') AS text FROM documents")
def snk_03(spark, sf):
    path = scratch_path(spark, "csv")
    docs = documents(spark, sf, "doc_id", "lang", "source", "text").select("doc_id", F.array("lang", "source").alias("topics"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    wr.write_quoted_csv(docs, path)
    return spark.read.schema("doc_id bigint, topics string, text string").csv(path, header=True, escape='"')


@query("snk_04_conversation_store", "SELECT role AS lang, conv_id AS author_id, turn AS conv_id, text AS content FROM conversations")
def snk_04(spark, sf):
    path = scratch_path(spark, "store")
    conv = table(spark, sf, "conversations").select(F.col("role").alias("lang"), F.col("conv_id").alias("author_id"), F.col("turn").alias("conv_id"), F.col("text").alias("content"))
    wr.write_conversations(conv, path)
    return spark.read.schema("author_id bigint, conv_id bigint, content string, lang string").parquet(path)


@query("snk_04_author_store", """
WITH c AS (SELECT conv_id AS author_id, turn AS conv_id, text FROM conversations), k AS (SELECT author_id, count(*) AS keys FROM c GROUP BY 1)
SELECT author_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, any_value(keys) AS keys FROM c JOIN k USING (author_id) GROUP BY 1""")
def snk_04_store(spark, sf):
    """Turns, their characters and keys of each author, from the bucketed store joined with its index."""
    name = f"authors_{uuid.uuid4().hex}"
    conv = table(spark, sf, "conversations").select(F.col("conv_id").alias("author_id"), F.col("turn").alias("conv_id"), F.col("text").alias("content"))
    path = scratch_path(spark, "authors")
    wr.write_author_store(conv, name, path, buckets=16)
    keys = spark.table(f"{name}_keys").groupBy("author_id").agg(F.count("*").alias("keys"))
    rows = spark.table(name).groupBy("author_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    return rows.join(keys, "author_id")


@query("snk_05_vocabulary_files", k.term_counts(k.words("text")))
def snk_05(spark, sf):
    path = scratch_path(spark, "vocab")
    wr.write_vocab(vocab.term_counts(documents(spark, sf, "doc_id", "text"), "doc_id", analyze("text")), path)
    return spark.read.schema("token string, tf bigint, df bigint").csv(f"{path}/text", sep="\t")


@query("snk_06_output_files", """
WITH s AS (SELECT doc_id, octet_length(encode(text)) AS size FROM documents),
r AS (SELECT doc_id, size > 32768 AS large, sum(CASE WHEN size > 32768 THEN 0 ELSE size END) OVER w - CASE WHEN size > 32768 THEN 0 ELSE size END AS start,
  count(*) FILTER (size > 32768) OVER w AS n_large FROM s WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT doc_id, CAST(start // 32768 + 2 * n_large - large::INT AS BIGINT) AS file_no FROM r)
SELECT doc_id, file_no, file_no // 100 AS dir_no FROM f""")
def snk_06(spark, sf):
    docs = documents(spark, sf, "doc_id", "text").select("doc_id", F.octet_length("text").cast("bigint").alias("size"))
    return wr.assign_output_files(docs, 65536, [F.col("doc_id")]).drop("size")


@query("snk_06_split_files", "SELECT doc_id, lang, text FROM documents")
def snk_06_split(spark, sf):
    path = scratch_path(spark, "split")
    wr.write_split(documents(spark, sf, "doc_id", "lang", "text"), path, 65536, [F.col("doc_id")], compression="bzip2")
    return spark.read.schema("doc_id bigint, lang string, text string").json(path).select("doc_id", "lang", "text")


@query("snk_08_key_index", "SELECT conv_id AS author_id, turn AS conv_id FROM conversations")
def snk_08(spark, sf):
    path = scratch_path(spark, "index")
    conv = table(spark, sf, "conversations").select(F.col("conv_id").alias("author_id"), F.col("turn").alias("conv_id"))
    wr.build_key_index(conv, path)
    return wr.build_key_index(conv, path)
