"""Dictionary joins, document features, weights and scores."""

from __future__ import annotations

from pyspark.ml.feature import MinMaxScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gramloom.functions.tokens import analyze
from gramloom.functions.text import plain_alphabet
from gramloom.operators import chargrams
from gramloom.operators import clusters as cl
from gramloom.operators import evaluation as ev
from gramloom.operators import features as ft
from gramloom.operators import joins as jn
from gramloom.operators import ngrams, vocab
from gramloom.plans import sqlkit as k
from gramloom.plans.base import documents, pages, query, table
from gramloom.session import settled

C = f"c AS ({k.term_counts(k.words('text'))})"
N = "(SELECT count(*) FROM documents)"
TOK = f"tok AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({k.words('text')}) AS token FROM documents) GROUP BY 1, 2)"


def top(n=None, name="v"):
    """CTE body of the n most frequent words, or all of them."""
    cut = "" if n is None else f" QUALIFY row_number() OVER (ORDER BY tf DESC, token) <= {n}"
    return f"{name} AS (SELECT token, tf AS cf, df, row_number() OVER (ORDER BY tf DESC, token) - 1 AS id FROM c{cut})"


def _docs(spark, sf):
    return documents(spark, sf, "doc_id", "text")


def _bags(spark, sf):
    """(doc_id, token, tf) of all documents, computed once for the vocabulary and the features of a query."""
    return settled(vocab.doc_term_counts(_docs(spark, sf), "doc_id", analyze("text")))


def _top(bags, n=None):
    return settled(vocab.build_vocab(vocab.most_common(vocab.corpus_counts(bags), n)))


def _n(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*")).scalar()


def _long(df, key, vec="vec", name="value", digits=6):
    out = df.select(key, F.posexplode(vec).alias("dim", name))
    return out.withColumn(name, F.round(name, digits))


# ---- clusters derived from the vocabulary: path = low bits of the word id ----

def _clusters(words):
    bits = F.lpad(F.bin(F.col("id") % 64), 6, "0")
    return words.select(bits.alias("cluster"), F.col("token").alias("word"), F.col("tf").alias("freq"), F.col("id").alias("line"))


CL = "cl AS (SELECT lpad(bin(id % 64), 6, '0') AS cluster, token, cf, id FROM v)"
VEC = "vec AS (SELECT v.token, v.id, CAST(e.embedding AS DOUBLE[]) AS vec FROM v JOIN embeddings e ON e.vec_id = v.id)"


def _vectors(spark, sf, words):
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return words.join(emb, "id").select("token", "id", "vec")


@query("jn_01_truth", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def jn_01(spark, sf):
    return jn.with_truth(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("jn_02_tokens_to_clusters", f"""
WITH {C}, {top()}, {CL}, {TOK}
SELECT doc_id, token, cluster, tf FROM tok JOIN cl USING (token)""")
def jn_02(spark, sf):
    bags = _bags(spark, sf)
    return jn.to_clusters(bags, _clusters(_top(bags))).select("doc_id", "token", "cluster", "tf")


@query("jn_03_tokens_to_vectors", f"""
WITH {C}, {top()}, {VEC}, {TOK}
SELECT doc_id, token, round(list_sum(vec), 6) AS total, round(list_sum(list_transform(vec, lambda x, i: x * i)), 6) AS weighted FROM tok JOIN vec USING (token)
WHERE token IN (SELECT token FROM c WHERE df <= {N} * 0.5)""")
def jn_03(spark, sf):
    bags = _bags(spark, sf)
    words = _top(bags)
    joined = jn.to_vectors(bags, _vectors(spark, sf, words), words.where(F.col("df") <= _n(spark, sf) * 0.5))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    weighted = F.transform("vec", lambda x, i: x * (i + 1))
    return joined.select("doc_id", "token", F.round(add("vec"), 6).alias("total"), F.round(add(weighted), 6).alias("weighted"))


@query("jn_04_vocabulary_matrix", f"""
WITH {C}, {top()}, m AS (SELECT id + 1 AS row, token, CAST(embedding AS DOUBLE[]) AS vec FROM v LEFT JOIN embeddings ON vec_id = id)
SELECT row, token, CAST(d AS INTEGER) AS dim, round(vec[d + 1], 6) AS value FROM m, unnest(generate_series(0, 63)) AS x(d) WHERE vec[d + 1] <> 0
UNION ALL SELECT row, token, NULL, 0 FROM m WHERE vec IS NULL""")
def jn_04(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    words = _top(_bags(spark, sf))
    vectors = words.join(emb, F.col("id") == F.col("vec_id")).select("token", "vec")
    m = settled(jn.vocab_matrix(words, vectors, 64))
    # of the matrix the entries that are not zero, and the rows of zeros by name
    zero = ~F.exists("vec", lambda x: x != 0)
    filled = m.where(~zero).select("row", "token", F.posexplode("vec").alias("dim", "value")).where("value <> 0")
    empty = m.where(zero).select("row", "token", F.lit(None).cast("int").alias("dim"), F.lit(0.0).alias("value"))
    return filled.withColumn("value", F.round("value", 6)).unionByName(empty)


CATS = """cats AS (
  SELECT prefix, min(page_id) AS ord, any_value(site) AS site, any_value(cat) AS cat FROM (
    SELECT page_id, regexp_extract(url, '^https?://[^/]+/', 0) AS prefix, regexp_extract(url, '^https?://([^/]+)/', 1) AS site, 'host' AS cat FROM pages
    UNION ALL SELECT page_id - 1000000, regexp_extract(url, '^https?://[^/]+/e', 0), regexp_extract(url, '^https?://([^/]+)/', 1), 'e-section' FROM pages WHERE page_id % 2 = 0
  ) WHERE prefix <> '' GROUP BY 1)"""


def _categories(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    site = F.regexp_extract("url", "^https?://([^/]+)/", 1)
    host = p.select("page_id", F.regexp_extract("url", "^https?://[^/]+/", 0).alias("prefix"), site.alias("site"), F.lit("host").alias("cat"))
    sect = p.where("page_id % 2 = 0").select(
        (F.col("page_id") - 1000000).alias("page_id"), F.regexp_extract("url", "^https?://[^/]+/e", 0).alias("prefix"), site.alias("site"), F.lit("e-section").alias("cat"))
    rows = host.unionByName(sect).where("prefix <> ''")
    return rows.groupBy("prefix").agg(F.min("page_id").alias("ord"), F.first("site").alias("site"), F.first("cat").alias("cat"))


@query("jn_05_url_category", f"""
WITH {CATS}, m AS (SELECT page_id, arg_min(site, ord) AS site, arg_min(cat, ord) AS cat
                   FROM pages JOIN cats ON starts_with(url, prefix) GROUP BY 1)
SELECT page_id, url, site, cat FROM pages LEFT JOIN m USING (page_id)""")
def jn_05(spark, sf):
    return jn.categorize_by_url(pages(spark, sf, "page_id", "url"), _categories(spark, sf))


@query("jn_06_index_with_texts", """
SELECT 'f' || d.doc_id || '.txt' AS filename, quality, lang, text FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
def jn_06(spark, sf):
    name = F.concat(F.lit("f"), "doc_id", F.lit(".txt")).alias("filename")
    index = table(spark, sf, "labels").select(name, "quality")
    return jn.attach_texts(index, table(spark, sf, "documents").select(name, "lang", "text"))


@query("jn_07_aligned_sequences", "SELECT d.doc_id, n_chars, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def jn_07(spark, sf):
    return jn.align(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("jn_09_skip_existing", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_09(spark, sf):
    return jn.skip_existing(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("jn_10_named_codes", """
SELECT c.c_custkey, n_nationkey AS code, n_name AS term FROM customer c JOIN nation ON n_nationkey IN (c_nationkey, c_custkey % 25)
""")
def jn_10(spark, sf):
    codes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("term"))
    cust = table(spark, sf, "customer").select(
        "c_custkey", F.array_distinct(F.array(F.col("c_nationkey").cast("int"), (F.col("c_custkey") % 25).cast("int"))).alias("codes"))
    return jn.name_codes(cust, "codes", codes, "c_custkey")


@query("src_04_code_map", """
WITH p AS (SELECT DISTINCT p_brand AS code, p_type AS term FROM part)
SELECT 'code' AS side, code AS name, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'term', term, count(*) FROM p GROUP BY 2""")
def src_04(spark, sf):
    by_code, by_term = jn.code_map(table(spark, sf, "part").select(F.col("p_brand").alias("code"), F.col("p_type").alias("term")))
    a = by_code.select(F.lit("code").alias("side"), F.col("code").alias("name"), F.col("n_terms").alias("n")).distinct()
    return a.unionByName(by_term.select(F.lit("term").alias("side"), F.col("term").alias("name"), F.col("n_codes").alias("n")).distinct())


STACK = f"""WITH {C}, {top(1000)}, {TOK}, {CL}, b AS (SELECT doc_id, id AS feature, CAST(tf AS DOUBLE) AS value FROM tok JOIN v USING (token)),
  col AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS feature FROM (SELECT DISTINCT cluster FROM cl)),
  d AS (SELECT doc_id, feature + (SELECT count(*) FROM v) AS feature, CAST(sum(tf) AS DOUBLE) AS value
        FROM tok JOIN cl USING (token) JOIN col USING (cluster) GROUP BY 1, 2)"""


def _blocks(spark, sf):
    bags = _bags(spark, sf)
    words = _top(bags, 1000)
    block1 = jn.join_dictionary(bags, words.select("token", F.col("id").alias("feature"))).select("doc_id", "feature", F.col("tf").alias("value"))
    clusters = _clusters(words)
    columns = settled(ft.cluster_columns(clusters))
    block2 = jn.join_dictionary(ft.cluster_features(bags, clusters), columns, "cluster").select("doc_id", "feature", "value")
    return jn.stack_features([(block1, words.agg(F.count("*")).scalar()), (block2, columns.agg(F.count("*")).scalar())])


@query("jn_11_feature_blocks", STACK + " SELECT doc_id, feature, value FROM b UNION ALL SELECT * FROM d")
def jn_11(spark, sf):
    return _blocks(spark, sf)


@query("ml_09_combined_normalized", STACK + """, u AS (SELECT * FROM b UNION ALL SELECT * FROM d)
SELECT doc_id, feature, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value FROM u""")
def ml_09(spark, sf):
    return ft.normalize_long(_blocks(spark, sf)).withColumn("value", F.round("value", 6))


@query("agg_09_cluster_features", f"""
WITH {C}, {top()}, {CL}, {TOK},
  col AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS feature FROM (SELECT DISTINCT cluster FROM cl))
SELECT doc_id, cluster, feature, CAST(sum(tf) AS BIGINT) AS value FROM tok JOIN cl USING (token) JOIN col USING (cluster) GROUP BY 1, 2, 3""")
def agg_09(spark, sf):
    bags = _bags(spark, sf)
    clusters = settled(_clusters(_top(bags)))
    return jn.join_dictionary(ft.cluster_features(bags, clusters), ft.cluster_columns(clusters), "cluster")


def _embedded(spark, sf, how):
    bags = _bags(spark, sf)
    return _long(ft.embed_documents(bags, _vectors(spark, sf, _top(bags)), how), "doc_id")


EMB = f"""WITH {C}, {top()}, {VEC}, {TOK},
  s AS (SELECT doc_id, d, sum(tf * vec[d + 1]) AS x, sum(tf) AS n FROM tok JOIN vec USING (token), unnest(generate_series(0, 63)) AS g(d) GROUP BY 1, 2)"""
for _how, _expr in {"sum": "x", "mean": "x / n",
                    "unit": "CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY doc_id)) > 1e-5 THEN x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) ELSE x END"}.items():
    query(f"agg_10_embedding_{_how}", f"{EMB} SELECT doc_id, CAST(d AS INTEGER) AS dim, round({_expr}, 6) AS value FROM s")(
        lambda spark, sf, how=_how: _embedded(spark, sf, how))


def _f_sql(features, variant):
    stats = f"""s AS (SELECT feature, sum(CASE WHEN is_pos THEN value ELSE 0 END) AS sp, sum(CASE WHEN is_pos THEN 0 ELSE value END) AS sn,
      sum(CASE WHEN is_pos THEN value * value ELSE 0 END) AS qp, sum(CASE WHEN is_pos THEN 0 ELSE value * value END) AS qn FROM f JOIN y USING (id) GROUP BY 1),
    n AS (SELECT CAST(sum(is_pos::INT) AS DOUBLE) AS np, CAST(sum((NOT is_pos)::INT) AS DOUBLE) AS nn FROM y)"""
    if variant == "sum":
        score = "(power(sn, 2) + power(sp, 2)) / nullif((qp - 2 * sp * sp + np * sp * sp) / np + (qn - 2 * sn * sn + nn * sn * sn) / nn, 0)"
    else:
        score = ("(power(sp / np - (sp + sn) / (np + nn), 2) + power(sn / nn - (sp + sn) / (np + nn), 2)) / "
                 "nullif((qp - sp * sp / np) / (np - 1) + (qn - sn * sn / nn) / (nn - 1), 0)")
    return f"WITH {features}, {stats} SELECT feature, round({score}, 6) AS score FROM s, n"


DENSE = """f AS (SELECT vec_id AS id, CAST(d AS INTEGER) AS feature, CAST(embedding[d + 1] AS DOUBLE) AS value FROM embeddings, unnest(generate_series(0, 63)) AS g(d)),
  y AS (SELECT vec_id AS id, label < 5 AS is_pos FROM embeddings)"""
SPARSE = f"""{C}, {top(1000)}, {TOK}, f AS (SELECT doc_id AS id, v.id AS feature, CAST(tok.tf AS DOUBLE) AS value FROM tok JOIN v USING (token)),
  y AS (SELECT doc_id AS id, quality = 1 AS is_pos FROM labels)"""


def _dense_f(spark, sf, variant):
    emb = table(spark, sf, "embeddings")
    f = emb.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("feature", "value"))
    y = emb.select(F.col("vec_id").alias("id"), (F.col("label") < 5).alias("is_pos"))
    return ft.feature_f_score(f, y, "id", variant).withColumn("score", F.round("score", 6))


def _sparse_f(spark, sf, variant):
    bags = _bags(spark, sf)
    f = jn.join_dictionary(bags, _top(bags, 1000).select("token", F.col("id").alias("feature")))
    f = f.select(F.col("doc_id").alias("id"), "feature", F.col("tf").alias("value"))
    y = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("is_pos"))
    return ft.feature_f_score(f, y, "id", variant).withColumn("score", F.round("score", 6))


for _v in ("sum", "mean"):
    query(f"agg_11_f_score_dense_{_v}", _f_sql(DENSE, _v))(lambda spark, sf, v=_v: _dense_f(spark, sf, v))
    query(f"agg_11_f_score_sparse_{_v}", _f_sql(SPARSE, _v))(lambda spark, sf, v=_v: _sparse_f(spark, sf, v))


@query("agg_16_vector_cluster_counts", f"""
WITH {C}, {top()}, {TOK}
SELECT doc_id, CAST(label AS BIGINT) AS feature, CAST(sum(tf) AS BIGINT) AS value FROM tok JOIN v USING (token) JOIN embeddings ON vec_id = id GROUP BY 1, 2""")
def agg_16(spark, sf):
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"))
    bags = _bags(spark, sf)
    return ft.vector_cluster_features(bags, _top(bags).join(emb, "id"))


# ---- weights ----

@query("ml_01_word_counts", f"""
WITH {C}, {top(1000)}, {TOK} SELECT doc_id, id AS feature, tok.tf AS value FROM tok JOIN v USING (token)""")
def ml_01(spark, sf):
    bags = _bags(spark, sf)
    hits = jn.join_dictionary(bags, _top(bags, 1000).select("token", "id"))
    return hits.select("doc_id", F.col("id").alias("feature"), F.col("tf").alias("value"))


def _tfidf_sql(weight, idf, pruning):
    return f"""WITH {C}, v AS (SELECT token, df FROM c WHERE {pruning}), {TOK},
  w AS (SELECT doc_id, token, {weight} * {idf} AS w FROM tok JOIN v USING (token))
SELECT doc_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS w FROM w WHERE w <> 0"""


PRUNED = f"df >= 5 AND df <= {N} * 0.5"


def _pruned(spark, sf, bags):
    return vocab.top_features(vocab.corpus_counts(bags), _n(spark, sf), None, 5, 0.5)


@query("ml_02_tfidf_smooth", _tfidf_sql("tf", f"(ln((1.0 + {N}) / (1 + df)) + 1)", PRUNED))
def ml_02(spark, sf):
    bags = _bags(spark, sf)
    return ft.tfidf_smooth(bags, _pruned(spark, sf, bags), _n(spark, sf)).withColumn("w", F.round("w", 6))


@query("ml_02_tfidf_sublinear", _tfidf_sql("(1 + ln(tf))", f"(ln((1.0 + {N}) / (1 + df)) + 1)", PRUNED))
def ml_02_sub(spark, sf):
    bags = _bags(spark, sf)
    return ft.tfidf_smooth(bags, _pruned(spark, sf, bags), _n(spark, sf), sublinear=True).withColumn("w", F.round("w", 6))


@query("ml_03_tfidf_log2", _tfidf_sql("tf", f"log2({N} * 1.0 / df)", "df >= 5"))
def ml_03(spark, sf):
    bags = _bags(spark, sf)
    return ft.tfidf_log2(bags, vocab.corpus_counts(bags).where("df >= 5"), _n(spark, sf)).withColumn("w", F.round("w", 6))


_NG = f"""tok AS (SELECT doc_id, {k.words('text')} AS a FROM documents),
  g AS (SELECT doc_id, array_to_string(a[i:i + n - 1], ' ') AS token FROM (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i FROM tok), unnest([1, 2, 3, 4, 5]) AS o(n) WHERE i + n - 1 <= len(a))"""


@query("ml_04_word_ngrams", f"""
WITH {_NG}, c AS (SELECT token, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM (SELECT doc_id, token, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1)
SELECT token, tf, df FROM c ORDER BY tf DESC, token LIMIT 500000""")
def ml_04(spark, sf):
    counts = ngrams.frequent_ngrams(_docs(spark, sf), "doc_id", analyze("text"), 1, 5, 500_000)
    return vocab.top_features(counts, _n(spark, sf), 500_000)


@query("ml_04_char_4grams", f"""
WITH c AS ({k.term_counts(k.grams('lower(text)', 4))})
SELECT token, tf, df FROM c WHERE df >= 5 AND df <= {N} * 0.5""")
def ml_04_chars(spark, sf):
    counts = chargrams.gram_counts(_docs(spark, sf), F.lower("text"), 4, 4)
    return vocab.top_features(counts, _n(spark, sf), None, 5, 0.5)


@query("ml_05_topic_fold_in", f"""
WITH {C}, {top()}, {VEC}, {TOK}
SELECT doc_id, CAST(d AS INTEGER) AS dim, round(sum(tf * vec[d + 1]), 6) AS value FROM tok JOIN vec USING (token), unnest(generate_series(0, 63)) AS g(d) GROUP BY 1, 2""")
def ml_05_fold(spark, sf):
    bags = _bags(spark, sf)
    return _long(ft.project_topics(bags.withColumnRenamed("tf", "w"), _vectors(spark, sf, _top(bags))), "doc_id")


@query("ml_08_analogies", """
WITH u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS e FROM embeddings),
  q AS (SELECT a.vec_id AS qid, a.label AS section, b.vec_id AS bid, c.vec_id AS cid, d.vec_id AS expected,
          list_transform(list_zip(a.e, b.e, c.e), lambda z: z[2] - z[1] + z[3]) AS t
        FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 JOIN u c ON c.vec_id = a.vec_id + 2 JOIN u d ON d.vec_id = a.vec_id + 3),
  s AS (SELECT qid, section, expected, u.vec_id, list_sum(list_transform(list_zip(t, u.e), lambda z: z[1] * z[2])) AS score
        FROM q, u WHERE u.vec_id NOT IN (qid, bid, cid)),
  b AS (SELECT qid, section, expected, arg_max(vec_id, score) AS best FROM s GROUP BY 1, 2, 3)
SELECT coalesce(CAST(section AS VARCHAR), 'total') AS section, count(*) AS n, CAST(sum((best = expected)::INT) AS BIGINT) AS correct
FROM b GROUP BY GROUPING SETS ((section), ())""")
def ml_08(spark, sf):
    emb = table(spark, sf, "embeddings")
    vecs = emb.select(F.col("vec_id").cast("string").alias("token"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    word = lambda d: (F.col("vec_id") + d).cast("string")
    # the last three ids have no full quadruple; words outside the vocabulary drop the question
    qs = emb.select(F.col("label").cast("string").alias("section"), word(0).alias("a"), word(1).alias("b"), word(2).alias("c"), word(3).alias("expected"))
    return ev.analogy_accuracy(vecs, qs)


@query("ml_10_row_normalizer", """
SELECT vec_id, CAST(d AS INTEGER) AS dim, round(embedding[d + 1]::DOUBLE / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 6) AS value
FROM embeddings, unnest(generate_series(0, 63)) AS g(d)""")
def ml_10(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return _long(ft.row_normalize(emb), "vec_id")


@query("ml_10_min_max", """
WITH f AS (SELECT vec_id, CAST(d AS INTEGER) AS dim, embedding[d + 1]::DOUBLE AS x FROM embeddings, unnest(generate_series(0, 63)) AS g(d))
SELECT vec_id, dim, round((x - min(x) OVER (PARTITION BY dim)) / (max(x) OVER (PARTITION BY dim) - min(x) OVER (PARTITION BY dim)), 6) AS value FROM f""")
def ml_10_minmax(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    scaled = MinMaxScaler(inputCol="v", outputCol="s").fit(emb).transform(emb)
    return _long(scaled.select("vec_id", vector_to_array("s").alias("vec")), "vec_id")


@query("ml_11_label_index", """
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS DOUBLE) AS label FROM documents""")
def ml_11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return StringIndexer(inputCol="lang", outputCol="label", stringOrderType="alphabetAsc").fit(docs).transform(docs)


@query("ml_11_binarized_topics", """
SELECT doc_id, CAST(lang = 'de' AS INTEGER) AS de, CAST(lang = 'en' AS INTEGER) AS en, CAST(source = 'src1' AS INTEGER) AS src1 FROM documents""")
def ml_11_multi(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.array("lang", "source").alias("topics"))
    return ev.binarize(docs, "topics", ["de", "en", "src1"]).drop("topics")


NB = f"""WITH {C}, {top(1000)}, {TOK}, x AS (SELECT doc_id, token, tok.tf FROM tok JOIN v USING (token)),
  cls AS (SELECT lang AS label, ln(count(*) * 1.0 / {N}) AS prior FROM documents GROUP BY 1),
  cnt AS (SELECT lang AS label, token, sum(tf) AS n FROM x JOIN documents USING (doc_id) GROUP BY 1, 2),
  tot AS (SELECT label, sum(n) AS total FROM cnt GROUP BY 1),
  lik AS (SELECT t.label, v.token, ln((coalesce(n, 0) + 1.0) / (total + 1000.0)) AS lp FROM tot t CROSS JOIN v LEFT JOIN cnt USING (label, token)),
  s AS (SELECT doc_id, label, sum(tf * lp) + any_value(prior) AS score FROM x JOIN lik USING (token) JOIN cls USING (label) GROUP BY 1, 2)
SELECT doc_id, arg_max(label, score) AS prediction, round(max(score), 3) AS score FROM s GROUP BY 1"""


@query("ml_12_naive_bayes", NB)
def ml_12(spark, sf):
    bags = _bags(spark, sf)
    x = jn.join_dictionary(bags, _top(bags, 1000).select("token", "id")).select("doc_id", "token", "tf")
    labels = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    classes, model = ft.nb_model(x, labels)
    return ft.nb_predict(x, classes, model).withColumn("score", F.round("score", 3))


PRED = "p AS (SELECT doc_id, lang AS label, CASE WHEN doc_id % 5 = 0 THEN 'en' WHEN doc_id % 7 = 0 THEN 'de' ELSE lang END AS prediction FROM documents)"


def _pred(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"), F.when(F.col("doc_id") % 5 == 0, "en").when(
        F.col("doc_id") % 7 == 0, "de").otherwise(F.col("lang")).alias("prediction"))


@query("ml_17_accuracy", f"WITH {PRED} SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM p")
def ml_17(spark, sf):
    return ev.accuracy(_pred(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


@query("ml_17_f1", f"""
WITH {PRED}, l AS (SELECT DISTINCT label FROM p),
  t AS (SELECT l.label, sum((p.label = l.label AND prediction = l.label)::INT) AS tp, sum((prediction = l.label)::INT) AS pp, sum((p.label = l.label)::INT) AS ap FROM p, l GROUP BY 1),
  f AS (SELECT *, 2.0 * tp / nullif(pp + ap, 0) AS f1 FROM t)
SELECT 'macro' AS average, round(avg(f1), 6) AS f1 FROM f UNION ALL SELECT 'weighted', round(sum(f1 * ap) / sum(ap), 6) FROM f
UNION ALL SELECT 'micro', round(2.0 * sum(tp) / (sum(pp) + sum(ap)), 6) FROM f UNION ALL SELECT 'binary:en', round(max(f1), 6) FROM f WHERE label = 'en'""")
def ml_17_f1(spark, sf):
    return ev.f1(_pred(spark, sf), positive="en").withColumn("f1", F.round("f1", 6))
