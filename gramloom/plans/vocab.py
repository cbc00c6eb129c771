"""Vocabulary and count queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramloom.functions.text import plain_alphabet
from gramloom.functions.tokens import analyze, char_gram_range, unique_tokens, word_ngrams
from gramloom.operators import features, order, sampling, vocab
from gramloom.plans import sqlkit as k
from gramloom.plans.base import documents, query, table
from gramloom.session import scratch_path

WORDS = k.term_counts(k.words("text"))
GRAMS = k.term_counts(k.gram_range(k.clean("text"), 3, 4))
N = "(SELECT count(*) FROM documents)"


def _words(spark, sf):
    return vocab.term_counts(documents(spark, sf, "doc_id", "text"), "doc_id", analyze("text"))


def _n(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*")).scalar()


@query("slice_top_ngrams", f"""
WITH c AS ({GRAMS})
SELECT token, tf, df, round(ln({N} * 1.0 / df), 6) AS idf FROM c
WHERE df >= 5 AND df <= {N} * 0.5 ORDER BY tf DESC, token LIMIT 1000""")
def slice_top_ngrams(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    stats = vocab.term_stats(docs, "doc_id", char_gram_range(plain_alphabet("text"), 3, 4))
    pruned = vocab.prune_vocab(stats, _n(spark, sf), 5, 0.5, None)
    return vocab.most_common(pruned, 1000).withColumn("idf", F.round("idf", 6))


@query("agg_01_term_stats", f"""
WITH c AS ({WORDS})
SELECT token, tf, df, round(ln({N} * 1.0 / df), 6) AS idf FROM c WHERE tf >= 2
UNION ALL
SELECT '###TOTAL###', CAST(sum(len({k.words('text')})) AS BIGINT), count(*), NULL FROM documents""")
def agg_01(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    stats = vocab.term_stats(docs, "doc_id", analyze("text"), min_count=2, totals=True)
    return stats.withColumn("idf", F.round("idf", 6))


@query("agg_01_ngram_stats", f"""
WITH c AS ({k.term_counts(k.gram_range(k.clean("text"), 3, 3))})
SELECT token, tf, df, round(ln({N} * 1.0 / df), 6) AS idf FROM c WHERE tf >= 5""")
def agg_01_grams(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    stats = vocab.term_stats(docs, "doc_id", char_gram_range(plain_alphabet("text"), 3, 3), min_count=5)
    return stats.withColumn("idf", F.round("idf", 6))


@query("agg_02_vocabulary", f"""
WITH c AS ({WORDS})
SELECT token, tf, df, row_number() OVER (ORDER BY tf DESC, token) - 1 AS id FROM c""")
def agg_02(spark, sf):
    return vocab.build_vocab(_words(spark, sf))


@query("agg_03_pruned_vocabulary", f"""
WITH c AS ({WORDS}), p AS (SELECT * FROM c WHERE df >= 5 AND df <= {N} * 0.5 ORDER BY df DESC, token LIMIT 2000)
SELECT token, tf, df, row_number() OVER (ORDER BY tf DESC, token) - 1 AS id FROM p""")
def agg_03(spark, sf):
    return vocab.build_vocab(vocab.prune_vocab(_words(spark, sf), _n(spark, sf), 5, 0.5, 2000))


@query("agg_04_top_features", f"""
WITH c AS ({WORDS})
SELECT token, tf, df FROM c WHERE df >= 5 AND df <= {N} * 0.5 ORDER BY tf DESC, token LIMIT 1000""")
def agg_04(spark, sf):
    return vocab.top_features(_words(spark, sf), _n(spark, sf), 1000, 5, 0.5)


@query("agg_05_topic_histogram", """
SELECT topic, count(*) AS n_articles, (SELECT count(*) FROM documents) AS n_total
FROM (SELECT unnest([lang, source]) AS topic FROM documents) GROUP BY 1""")
def agg_05(spark, sf):
    docs = table(spark, sf, "documents").select(F.array("lang", "source").alias("topics"))
    return vocab.topic_counts(docs, "topics").select("topic", "n_articles", "n_total")


@query("agg_06_topic_summary", """
WITH t AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN [lang, source] ELSE [lang] END AS topics FROM documents)
SELECT (SELECT count(*) FROM t) AS n_items, round((SELECT avg(len(topics)) FROM t), 6) AS mean_topics,
       topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM t) GROUP BY 3""")
def agg_06(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.when(F.col("n_chars") % 2 == 0, F.array("lang", "source")).otherwise(F.array("lang")).alias("topics"))
    return vocab.topic_summary(docs, "topics").withColumn("mean_topics", F.round("mean_topics", 6))


@query("agg_07_article_count", "SELECT count(*) AS n_articles FROM documents")
def agg_07(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n_articles"))


@query("agg_08_class_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def agg_08(spark, sf):
    return sampling.class_counts(table(spark, sf, "documents"), "lang")


@query("agg_17_token_totals",
       f"SELECT count(*) AS n_docs, CAST(sum(len({k.words('text')})) AS BIGINT) AS n_tokens FROM documents")
def agg_17(spark, sf):
    return vocab.token_totals(documents(spark, sf, "doc_id", "text"), analyze("text"))


@query("agg_17_token_rate", f"SELECT count(*) AS n_docs, CAST(sum(len({k.words('text')})) AS BIGINT) AS n_tokens, true AS timed FROM documents")
def agg_17_rate(spark, sf):
    """Totals observed while the tokenised documents are written, and that a rate came with them."""
    docs = documents(spark, sf, "doc_id", "text").select("doc_id", analyze("text").alias("t"))
    path = scratch_path(spark, "tokens")
    rate = vocab.token_rate(docs, F.col("t"), lambda rows: rows.write.parquet(path))
    return rate.select("n_docs", "n_tokens", (F.col("tokens_per_second") > 0).alias("timed"))


@query("agg_20_longest_sequence", f"SELECT max(len({k.words('text')})) AS max_len FROM documents")
def agg_20(spark, sf):
    return vocab.max_length(documents(spark, sf, "doc_id", "text"), analyze("text"))


@query("win_02_vocabulary_cutoffs", f"""
WITH c AS ({WORDS}), r AS (SELECT tf, row_number() OVER (ORDER BY tf DESC, token) AS size FROM c)
SELECT size, tf FROM r WHERE size IN (1, 10, 100, 1000, 5000, 10000, 50000)""")
def win_02(spark, sf):
    return vocab.cutoff_table(_words(spark, sf), [1, 10, 100, 1000, 5000, 10000, 50000])


@query("flt_09_score_band", f"""
WITH c AS ({WORDS}), s AS (SELECT token, ln({N} * 1.0 / df) AS idf FROM c)
SELECT token, round(idf, 6) AS idf FROM s
WHERE idf BETWEEN (SELECT quantile_cont(idf, 0.3) FROM s) AND (SELECT quantile_cont(idf, 0.8) FROM s)""")
def flt_09(spark, sf):
    stats = vocab.term_stats(documents(spark, sf, "doc_id", "text"), "doc_id", analyze("text"))
    return vocab.score_band(stats.select("token", "idf"), "idf", 0.3, 0.8).withColumn("idf", F.round("idf", 6))


@query("flt_11_minimum_count", f"WITH c AS ({WORDS}) SELECT token, tf FROM c WHERE tf >= 10")
def flt_11(spark, sf):
    return vocab.min_count(_words(spark, sf), 10).select("token", "tf")


@query("lim_02_most_common_tokens", f"WITH c AS ({WORDS}) SELECT token, tf FROM c ORDER BY tf DESC, token LIMIT 100")
def lim_02(spark, sf):
    return vocab.most_common(_words(spark, sf), 100).select("token", "tf")


@query("lim_02_initial_clusters", f"WITH c AS ({WORDS}) SELECT token, tf FROM c ORDER BY tf DESC, token DESC LIMIT 100")
def lim_02_initial(spark, sf):
    return vocab.initial_clusters(_words(spark, sf), 100).select("token", "tf")


@query("set_03_unique_tokens", f"SELECT doc_id, len(list_distinct({k.words('text')})) AS n_unique FROM documents")
def set_03(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return docs.select("doc_id", F.size(unique_tokens(analyze("text"))).cast("bigint").alias("n_unique"))
