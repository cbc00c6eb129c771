"""Text transform and filter queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.functions import text as t
from gramloom.functions import tokens as tk
from gramloom.operators import chargrams, filters, order, textops, vocab
from gramloom.plans import sqlkit as k
from gramloom.plans.base import documents, pages, query, table
from gramloom.session import settled, spread

WS = r"[ \t\n\r\f\v]+"


def _docs(spark, sf):
    return documents(spark, sf, "doc_id", "text")


@query("txt_01_plain_alphabet", f"SELECT doc_id, {k.clean('text')} AS clean FROM documents")
def txt_01(spark, sf):
    return _docs(spark, sf).select("doc_id", t.plain_alphabet("text").alias("clean"))


@query("txt_02_squeeze", f"SELECT doc_id, regexp_replace(text, '{WS}', ' ', 'g') AS squeezed FROM documents")
def txt_02(spark, sf):
    return _docs(spark, sf).select("doc_id", t.squeeze("text").alias("squeezed"))


def _gram_counts(lo, hi):
    g = k.gram_range(k.clean("text"), lo, hi)
    return f"SELECT gram, count(*) AS n FROM (SELECT unnest({g}) AS gram FROM documents) GROUP BY 1"


@query("txt_03_char_ngrams", _gram_counts(3, 4))
def txt_03(spark, sf):
    grams = textops.char_ngrams(_docs(spark, sf), "doc_id", tk.char_gram_range(t.plain_alphabet("text"), 3, 4))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("txt_03_raw_ngrams", f"""
SELECT gram, count(*) AS n FROM (SELECT unnest({k.gram_range('text', 4, 4)}) AS gram FROM documents) GROUP BY 1""")
def txt_03_raw(spark, sf):
    grams = textops.char_ngrams(_docs(spark, sf), "doc_id", tk.char_gram_range("text", 4, 4))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("txt_03_joined_ngrams", """
WITH b AS (SELECT item_id, replace(text, ' ', '_') AS s FROM benchmark),
     g AS (SELECT item_id, e, n, substr(s, e - n + 1, n) AS gram
           FROM b, unnest(generate_series(1, length(s))) AS x(e), (VALUES (3), (4), (5)) AS o(n) WHERE e >= n)
SELECT item_id, string_agg(gram, ' ' ORDER BY e, n) AS grams FROM g GROUP BY 1""")
def txt_03_joined(spark, sf):
    items = spread(table(spark, sf, "benchmark"), "item_id")
    return items.select("item_id", F.array_join(tk.char_grams_interleaved("text", 3, 5), " ").alias("grams"))


def _preset_sql(parts):
    lists = ", ".join(k.gram_range(k.clean("text"), lo, hi) for lo, hi in parts)
    arr = f"list_concat({lists})" if len(parts) > 1 else lists
    return f"SELECT gram, count(*) AS n FROM (SELECT unnest({arr}) AS gram FROM documents) GROUP BY 1"


def _preset(spark, sf, orders):
    """Counts of the grams that `tk.recipe` gives for these orders, made from the clean text."""
    clean = _docs(spark, sf).select(tk.recipe()(F.col("text")).alias("text"))
    ranges = map(tk.bounds, orders if isinstance(orders, list) else [orders])
    counts = reduce(DataFrame.unionByName, [chargrams.gram_counts(clean, F.col("text"), lo, hi) for lo, hi in ranges])
    return counts.groupBy(F.col("token").alias("gram")).agg(F.sum("tf").alias("n"))


for _name, _orders in tk.PRESETS.items():
    _b = (_orders, _orders) if isinstance(_orders, int) else _orders
    query(f"txt_04_preset_{_name}", _preset_sql([_b]))(lambda spark, sf, o=_orders: _preset(spark, sf, o))

query("txt_04_several_orders", _preset_sql([(2, 2), (5, 5)]))(lambda spark, sf: _preset(spark, sf, [2, 5]))


def _wiki_sql(mode):
    cls, mask, lower = tk.WIKI_MODES[mode]
    body = {"alpha": r"\p{L}\p{Nl}\p{No}", "nopunct": r"\p{L}\p{N}", "all": r"\p{L}\p{N}.,()\"&\\/!?:;''\-"}[cls]
    text = "lower(text)" if lower else "text"
    text = f"regexp_replace(replace({text}, '_', ' '), '''''+', '\"', 'g')"
    tokens = f"regexp_extract_all({text}, '[{body}]+')"
    if mask:
        tokens = f"list_transform({tokens}, lambda x: regexp_replace(x, '\\p{{Nd}}', '#', 'g'))"
    return f"SELECT doc_id, array_to_string({tokens}, ' ') AS line FROM documents"


for _mode in tk.WIKI_MODES:
    query(f"txt_05_tokens_{_mode.replace('-', '_')}", _wiki_sql(_mode))(
        lambda spark, sf, m=_mode: _docs(spark, sf).select("doc_id", F.array_join(tk.wiki_tokens("text", m), " ").alias("line")))


@query("txt_06_clean_sentence", r"""
SELECT item_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '[^A-Za-z0-9(),!?''`]', ' ', 'g'), '(''s|''ve|n''t|''re|''d|''ll)', ' \1', 'g'),
  '([,!])', ' \1 ', 'g'), '([()?])', ' \\\1 ', 'g'), '\s{2,}', ' ', 'g'))) AS sentence
FROM (SELECT doc_id AS item_id, text || ' (it''s, isn''t?)' AS text FROM documents)""")
def txt_06(spark, sf):
    docs = _docs(spark, sf).select(F.col("doc_id").alias("item_id"), F.concat("text", F.lit(" (it's, isn't?)")).alias("text"))
    return docs.select("item_id", t.clean_sentence("text").alias("sentence"))


@query("txt_07_word_tokens", rf"""
SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '{k.W}+'), ' ') AS tokens FROM documents""")
def txt_07(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(tk.word_tokens("text", lower=True), " ").alias("tokens"))


@query("txt_08_analyzer", rf"""
SELECT doc_id, array_to_string(regexp_extract_all(strip_accents(lower(text)), '{k.W}{{2,}}'), ' ') AS tokens FROM documents""")
def txt_08(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(tk.analyze("text"), " ").alias("tokens"))


@query("txt_08_custom_preprocessor", rf"""
SELECT doc_id, array_to_string(regexp_extract_all({k.clean('text')}, '{k.W}{{2,}}'), ' ') AS tokens FROM documents""")
def txt_08_custom(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(tk.analyze("text", t.plain_alphabet), " ").alias("tokens"))


@query("txt_09_alphabetic_tokens", rf"""
SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'),
  lambda x: regexp_matches(x, '^[A-Za-z]+$')), lambda x: lower(x)), ' ') AS tokens FROM documents""")
def txt_09(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(tk.alpha_tokens(F.split("text", r"\s+")), " ").alias("tokens"))


SENT = r"""[^.!?\n]+[.!?]*["'')\]]*|[.!?]+"""
TOK = k.W[:-1] + r"]+|''" + k.W[:-1] + r"]+|[^\p{L}\p{N}_\s'']|''"
SENTS = f"list_filter(regexp_extract_all(text, '{SENT}'), lambda s: trim(s) <> '')"


@query("txt_10_sentences", f"""
WITH s AS (SELECT doc_id, {SENTS} AS a FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS sent_no, array_to_string(regexp_extract_all(lower(a[i + 1]), '{TOK}'), ' ') AS tokens
FROM s, unnest(generate_series(0, len(a) - 1)) AS x(i)""")
def txt_10(spark, sf):
    out = textops.sentences(_docs(spark, sf), "doc_id", ["text"])
    return out.withColumn("tokens", F.array_join("tokens", " "))


@query("txt_10_flat_tokens", f"""
SELECT doc_id, array_to_string(flatten(list_transform({SENTS}, lambda s: regexp_extract_all(lower(s), '{TOK}'))), ' ') AS tokens
FROM documents""")
def txt_10_flat(spark, sf):
    out = textops.sentences(_docs(spark, sf), "doc_id", ["text"], flatten=True)
    return out.withColumn("tokens", F.array_join("tokens", " "))


WORDS = k.term_counts(k.words("text"))


@query("txt_11_stop_words", f"""
WITH c AS ({WORDS}), stop AS (SELECT token FROM c ORDER BY tf DESC, token LIMIT 50),
     tok AS (SELECT doc_id, unnest({k.words('text')}) AS token FROM documents)
SELECT doc_id, token, count(*) AS n FROM tok WHERE token NOT IN (SELECT token FROM stop) GROUP BY 1, 2""")
def txt_11(spark, sf):
    docs = _docs(spark, sf)
    stop = vocab.most_common(vocab.term_counts(docs, "doc_id", tk.analyze("text")), 50).select("token")
    kept = textops.drop_stopwords(tk.explode_tokens(docs, tk.analyze("text"), "doc_id"), stop)
    return kept.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


TITLE = "CASE WHEN doc_id % 3 = 0 THEN 'talk: ' ELSE '' END || '  ' || lang || '_' || source || ' ' || text"


@query("txt_12_canonical_title", rf"""
WITH x AS (SELECT doc_id, trim(regexp_replace({TITLE}, '[\s_]+', ' ', 'g')) AS s FROM documents),
     p AS (SELECT *, trim(regexp_extract(s, '^([^:]*):', 1)) AS ns, ltrim(regexp_extract(s, '(?s)^[^:]*:(.*)$', 1)) AS rest FROM x)
SELECT doc_id, CASE WHEN contains(s, ':') AND lower(ns) IN ('talk', 'user')
  THEN upper(substr(lower(ns), 1, 1)) || substr(lower(ns), 2) || ':' || upper(substr(rest, 1, 1)) || substr(rest, 2)
  ELSE upper(substr(s, 1, 1)) || substr(s, 2) END AS title FROM p""")
def txt_12(spark, sf):
    return _docs_title(spark, sf).select("doc_id", t.canonical_title("raw", ["Talk", "User"]).alias("title"))


def _docs_title(spark, sf):
    prefix = F.when(F.col("doc_id") % 3 == 0, F.lit("talk: ")).otherwise("")
    return documents(spark, sf, "doc_id", "lang", "source", "text").select(
        "doc_id", F.concat(prefix, F.lit("  "), "lang", F.lit("_"), "source", F.lit(" "), "text").alias("raw"))


@query("txt_12_title_key", rf"SELECT doc_id, lower(regexp_replace({TITLE}, '[^\p{{L}}\p{{N}}_]+', '', 'g')) AS key FROM documents")
def txt_12_key(spark, sf):
    return _docs_title(spark, sf).select("doc_id", t.title_key("raw").alias("key"))


@query("txt_13_entities", """
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
  '&middot;', '·'), '&nbsp;', chr(160)), '&copy;', '©'), '&amp;', '&')
  || chr(CAST(200 + page_id % 9000 AS INTEGER)) || ' ' || chr(CAST(128512 + page_id % 60 AS INTEGER)) AS decoded FROM pages""")
def txt_13(spark, sf):
    numbers = F.concat("html", F.lit("&#"), (200 + F.col("page_id") % 9000).cast("string"), F.lit("; &#x"),
                       F.lower(F.hex(128512 + F.col("page_id") % 60)), F.lit(";"))
    return pages(spark, sf, "page_id", "html").select("page_id", t.decode_entities(numbers).alias("decoded"))


_IDS: dict[str, int] = {}
for _i, _c in enumerate(tk.ALPHABET):
    _IDS.setdefault(_c, _i)
_KEYS = "[" + ", ".join(f"chr({ord(c)})" for c in _IDS) + "]"
_VALS = "[" + ", ".join(str(v) for v in _IDS.values()) + "]"
_CODES = f"""list_transform(regexp_extract_all(substr(text, 1, 1014), '(?s).'),
  lambda c: coalesce({_VALS}[list_position({_KEYS}, c)], {len(tk.ALPHABET)}))"""


@query("txt_19_character_ids", f"""
WITH x AS (SELECT doc_id, {_CODES} AS a FROM documents)
SELECT doc_id, array_to_string(list_concat(a, list_transform(generate_series(1, 1014 - len(a)), lambda i: {_IDS[' ']})), ' ') AS ids FROM x""")
def txt_19(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(tk.char_ids("text").cast("array<string>"), " ").alias("ids"))


PADDED = """array_to_string(list_concat(a[1:n], list_transform(generate_series(1, n - len(a)), lambda i: '<PAD/>')), ' ')"""


@query("txt_20_pad_fixed", f"WITH x AS (SELECT doc_id, {k.words('text')} AS a, 100 AS n FROM documents) SELECT doc_id, {PADDED} AS tokens FROM x")
def txt_20(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(tk.pad(tk.analyze("text"), 100, "<PAD/>"), " ").alias("tokens"))


@query("txt_20_pad_longest", f"""
WITH x AS (SELECT item_id, {k.words('text')} AS a FROM benchmark), m AS (SELECT max(len(a)) AS n FROM x)
SELECT item_id, {PADDED} AS tokens FROM x, m""")
def txt_20_longest(spark, sf):
    items = spread(table(spark, sf, "benchmark"), "item_id").select("item_id", tk.analyze("text").alias("a"))
    longest = vocab.max_length(items, F.col("a")).scalar()
    return items.select("item_id", F.array_join(tk.pad("a", longest, "<PAD/>"), " ").alias("tokens"))


@query("txt_21_vocabulary_ids", f"""
WITH c AS ({WORDS}), v AS (SELECT token, row_number() OVER (ORDER BY tf DESC, token) AS code FROM c
                           WHERE df >= 5 QUALIFY row_number() OVER (ORDER BY tf DESC, token) <= 5000),
     tok AS (SELECT doc_id, a, unnest(generate_series(0, len(a) - 1)) AS pos FROM (SELECT doc_id, {k.words('text')} AS a FROM documents))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, code FROM tok JOIN v ON v.token = a[pos + 1]""")
def txt_21(spark, sf):
    docs = _docs(spark, sf)
    counts = vocab.term_counts(docs, "doc_id", tk.analyze("text")).where("df >= 5")
    ids = vocab.build_vocab(vocab.most_common(counts, 5000))
    return textops.encode_ids(tk.explode_tokens(docs, tk.analyze("text"), "doc_id", pos=True), ids)


@query("txt_22_strip_tag", r"SELECT item_id, regexp_replace(trim(text), '\s+', ' ', 'g') AS line FROM benchmark")
def txt_22(spark, sf):
    tagged = F.concat(F.lit("<s> "), F.regexp_replace(F.trim("text"), r"\s+", " "), F.lit(" </s>"))
    return spread(table(spark, sf, "benchmark"), "item_id").select("item_id", t.strip_tag(tagged).alias("line"))


@query("txt_23_flatten_metadata", """
SELECT event_id, user_id AS revision_contributor_id, event_type AS revision_comment,
       coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS revision_k,
       coalesce(TRY_CAST(event_type AS BIGINT), -1) AS revision_parentid FROM events""")
def txt_23(spark, sf):
    events = spread(table(spark, sf, "events").select("event_id", "user_id", "event_type", "props"), "event_id")
    props = F.from_json("props", "k string")
    nested = events.select("event_id", F.struct(
        F.struct(F.col("user_id").alias("id")).alias("contributor"), F.col("event_type").alias("comment"),
        textops.int_or(props["k"]).alias("k"), textops.int_or(F.col("event_type")).alias("parentid")).alias("revision"))
    return textops.flatten_struct(nested, "revision")


@query("txt_24_join_columns", "SELECT doc_id, concat_ws(' ', lang, source, text) AS joined FROM documents")
def txt_24(spark, sf):
    docs = documents(spark, sf, "doc_id", "lang", "source", "text")
    return docs.select("doc_id", t.join_text(["lang", "source", "text"]).alias("joined"))


@query("txt_25_page_url", "SELECT page_id, 'https://wiki.example.org/index?curid=' || page_id AS url FROM pages")
def txt_25(spark, sf):
    return pages(spark, sf, "page_id").select("page_id", t.page_url("https://wiki.example.org/index", "page_id").alias("url"))


@query("txt_26_tagged_tokens", f"""
WITH c AS ({WORDS}), v AS (SELECT token, tf, row_number() OVER (ORDER BY tf DESC, token) AS r FROM c),
     stop AS (SELECT token FROM v WHERE r <= 20), gaz AS (SELECT token, 'T' || (r % 7) AS tag FROM v WHERE r % 5 <> 0),
     tok AS (SELECT doc_id, unnest({k.words('text')}) AS token FROM documents)
SELECT token || '|' || coalesce(tag, 'X') AS tagged, count(*) AS n
FROM tok LEFT JOIN gaz USING (token) WHERE token NOT IN (SELECT token FROM stop) GROUP BY 1""")
def txt_26(spark, sf):
    """The whole vocabulary is the dictionary, but for every fifth word."""
    docs = _docs(spark, sf)
    ranked = settled(vocab.build_vocab(vocab.term_counts(docs, "doc_id", tk.analyze("text"))))
    gaz = ranked.where((F.col("id") + 1) % 5 != 0).select("token", F.concat(F.lit("T"), ((F.col("id") + 1) % 7).cast("string")).alias("tag"))
    stop = ranked.where("id < 20").select("token")
    tagged = textops.tag_tokens(tk.explode_tokens(docs, tk.analyze("text"), "doc_id"), gaz, stop)
    return tagged.groupBy("tagged").agg(F.count("*").alias("n"))


# ---- filters ----

@query("flt_01_article_pages", """
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Template:' WHEN doc_id % 4 = 1 THEN 'Portal:' WHEN doc_id % 4 = 2 THEN 'Talk:'
             ELSE '' END || source AS title, CASE WHEN doc_id % 5 = 0 THEN 'other' END AS redirect FROM documents)
SELECT doc_id, title FROM x WHERE redirect IS NULL AND (NOT contains(title, ':') OR split_part(title, ':', 1) = 'Portal')""")
def flt_01(spark, sf):
    kind = F.col("doc_id") % 4
    prefix = F.when(kind == 0, "Template:").when(kind == 1, "Portal:").when(kind == 2, "Talk:").otherwise("")
    df = documents(spark, sf, "doc_id", "source").select(
        "doc_id", F.concat(prefix, "source").alias("title"), F.when(F.col("doc_id") % 5 == 0, F.lit("other")).alias("redirect"))
    return filters.article_pages(df, ["Portal", "Template"]).select("doc_id", "title")


@query("flt_02_usable_articles", f"""
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '#REDIRECT ' ELSE '' END || text AS raw,
             CASE WHEN doc_id % 11 = 0 THEN 'Wikipedia:' ELSE '' END || source AS title,
             trim({k.clean('text')}) AS body FROM documents)
SELECT doc_id, title, CAST(length(body) AS BIGINT) AS n FROM x
WHERE NOT starts_with(raw, '#REDIRECT') AND NOT starts_with(title, 'Wikipedia:') AND length(body) >= 300""")
def flt_02(spark, sf):
    docs = documents(spark, sf, "doc_id", "text", "source")
    df = docs.select(
        "doc_id", F.concat(F.when(F.col("doc_id") % 7 == 0, "#REDIRECT ").otherwise(""), "text").alias("raw"),
        F.concat(F.when(F.col("doc_id") % 11 == 0, "Wikipedia:").otherwise(""), "source").alias("title"),
        F.trim(t.plain_alphabet("text")).alias("body"))
    kept = filters.usable_articles(df, "raw", "body", min_chars=300)
    return kept.select("doc_id", "title", F.length("body").cast("bigint").alias("n"))


@query("flt_03_page_predicate", """
SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND json_extract_string(props, '$.k') IS NOT NULL AND value > 5""")
def flt_03(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value", "props")
    kind = F.when(F.col("event_type").isin("view", "click"), "page").otherwise(F.col("event_type"))
    action = F.struct(F.struct(F.col("event_id").alias("_id"), kind.alias("_type")).alias("index"))
    source = F.struct(F.from_json("props", "k string")["k"].alias("title"), F.when(F.col("value") > 5, F.col("value")).alias("text"))
    return events.withColumn("a", action).withColumn("s", source).where(filters.is_page(F.col("a"), F.col("s"))).select("event_id")


TOPICS = "[lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END]"


def _topics(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array(
        "lang", "source", F.when(F.col("n_chars") > 2000, "long").otherwise("short")).alias("topics"))


@query("flt_04_any_topic", f"""
WITH x AS (SELECT doc_id, list_filter({TOPICS}, lambda t: t IN ('de', 'src3', 'long')) AS t FROM documents)
SELECT doc_id, array_to_string(t, '|') AS topics FROM x WHERE len(t) > 0""")
def flt_04(spark, sf):
    out = filters.with_any_topic(_topics(spark, sf), "topics", ["de", "src3", "long"])
    return out.withColumn("topics", F.array_join("topics", "|"))


@query("flt_05_allowed_topics", f"""
SELECT doc_id, array_to_string(list_filter({TOPICS}, lambda t: t IN ('en', 'src1', 'short')), '|') AS topics FROM documents""")
def flt_05(spark, sf):
    out = filters.keep_topics(_topics(spark, sf), "topics", ["en", "src1", "short"])
    return out.withColumn("topics", F.array_join("topics", "|"))


@query("flt_06_missing_body", """
SELECT doc_id, CASE WHEN trim(coalesce(body, '')) = '' THEN 'rejected' ELSE 'kept' END AS part
FROM (SELECT doc_id, CASE WHEN n_chars % 3 > 0 THEN text END AS body FROM documents)""")
def flt_06(spark, sf):
    docs = documents(spark, sf, "doc_id", "text", "n_chars").select("doc_id", F.when(F.col("n_chars") % 3 > 0, F.col("text")).alias("body"))
    kept, rejected = filters.require_body(docs, "body")
    return (kept.select("doc_id", F.lit("kept").alias("part"))
            .unionByName(rejected.select("doc_id", F.lit("rejected").alias("part"))))


@query("flt_07_alphabetic_lines", r"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE regexp_matches(line, '^[\p{L}\p{Nl}\p{No}_]') GROUP BY 1""")
def flt_07(spark, sf):
    lines = _docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(filters.starts_alpha(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("flt_08_drop_nulls", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def flt_08(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return filters.drop_nulls(joined, "quality").select("doc_id", "quality")


@query("flt_10_key_selection", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def flt_10(spark, sf):
    keys = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return filters.select_keys(table(spark, sf, "documents").select("doc_id", "lang"), keys, "doc_id")


@query("flt_10_position_slice", """
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r BETWEEN 101 AND 350""")
def flt_10_slice(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return order.slice_rows(docs, 100, 350, [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "lang")


@query("flt_12_consistency", """
SELECT rule, CAST(sum(bad) AS BIGINT) AS violations, count(*) AS rows FROM (
  SELECT 'declared length' AS rule, CAST(n_chars <> length(text) AS INTEGER) AS bad FROM documents
  UNION ALL SELECT 'empty text', CAST(trim(text) = '' AS INTEGER) FROM documents
  UNION ALL SELECT 'unknown language', CAST(lang NOT IN ('en', 'de') AS INTEGER) FROM documents) GROUP BY 1""")
def flt_12(spark, sf):
    return filters.consistency_report(documents(spark, sf), {
        "declared length": F.col("n_chars") != F.length("text"),
        "empty text": F.trim("text") == "",
        "unknown language": ~F.col("lang").isin("en", "de")})


@query("agg_18_duplicate_keys", "SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def agg_18(spark, sf):
    return filters.duplicate_keys(documents(spark, sf, "doc_id", "text"), "text")


@query("agg_19_declared_counts", """
SELECT conv_id, count(*) AS actual, max(turn) + 1 AS declared, count(*) = max(turn) + 1 AS consistent FROM conversations GROUP BY 1""")
def agg_19(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("declared"))
    return filters.declared_vs_actual(conv, "conv_id", "declared")


@query("set_01_stack", "SELECT lang AS label, doc_id FROM documents UNION ALL SELECT 'benchmark', item_id FROM benchmark")
def set_01(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("label"), "doc_id")
    return docs.unionByName(table(spark, sf, "benchmark").select(F.lit("benchmark").alias("label"), F.col("item_id").alias("doc_id")))


@query("set_02_distinct_rows", "SELECT DISTINCT lang, source FROM documents")
def set_02(spark, sf):
    return table(spark, sf, "documents").select("lang", "source").distinct()


@query("set_02_dedupe_by_key", "SELECT text, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1")
def set_02_key(spark, sf):
    return filters.dedupe(documents(spark, sf, "doc_id", "text", "lang"), ["text"], ["doc_id"])


@query("set_04_topic_overlap", f"""
SELECT doc_id, array_to_string(list_filter({TOPICS}, lambda t: t IN ('fr', 'long')), '|') AS common,
       len(list_filter({TOPICS}, lambda t: t IN ('fr', 'long'))) = 0 AS is_disjoint FROM documents""")
def set_04(spark, sf):
    common = tk.topic_overlap("topics", ["fr", "long"])
    return _topics(spark, sf).select("doc_id", F.array_join(common, "|").alias("common"), (F.size(common) == 0).alias("is_disjoint"))
