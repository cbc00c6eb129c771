"""Windows, limits, sampling, folds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from gramloom.functions.tokens import analyze
from gramloom.operators import clusters as cl
from gramloom.operators import learner, order, sampling, vocab
from gramloom.plans import sqlkit as k
from gramloom.plans.base import documents, query, table
from gramloom.plans.features import C, CL, _bags, _clusters, _top, top
from gramloom.session import scratch_path, settled
from gramloom.sources.lines import read_clusters

N = "(SELECT count(*) FROM documents)"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


def h(seed, key="doc_id"):
    return f"md5('{seed}:' || {key})"


@query("win_01_adjacent_pairs", f"""
WITH t AS (SELECT {k.words('text')} AS a FROM documents),
  p AS (SELECT a[i] AS first, a[i + 1] AS second FROM (SELECT a, unnest(generate_series(1, len(a) - 1)) AS i FROM t))
SELECT first, second, count(*) AS n FROM p GROUP BY 1, 2""")
def win_01(spark, sf):
    return cl.adjacent_pairs(documents(spark, sf, "doc_id", "text"), "doc_id", analyze("text"))


@query("win_03_top_cluster_terms", f"""
WITH {C}, {top()}, {CL}
SELECT cluster, token AS word, cf AS freq, CAST(row_number() OVER (PARTITION BY cluster ORDER BY cf DESC, id) AS INTEGER) AS rn FROM cl
QUALIFY rn <= 10""")
def win_03(spark, sf):
    return cl.top_terms(_clusters(_top(_bags(spark, sf))), 10).select("cluster", "word", "freq", "rn")


@query("win_04_word_budget", f"""
WITH t AS (SELECT doc_id, len({k.words('text')}) AS words FROM documents),
  r AS (SELECT *, CAST(sum(words) OVER (ORDER BY doc_id) AS BIGINT) AS running FROM t)
SELECT doc_id, words, running FROM r WHERE running - words <= 100000""")
def win_04(spark, sf):
    words = documents(spark, sf, "doc_id", "text").select("doc_id", F.size(analyze("text")).cast("bigint").alias("words"))
    return order.word_budget(words, "words", 100_000, [F.col("doc_id")])


@query("win_05_first_per_class", """
WITH r AS (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS rn FROM documents)
SELECT doc_id, lang, rn FROM r WHERE rn <= 100 ORDER BY doc_id LIMIT 350""")
def win_05(spark, sf):
    return sampling.first_n_per_class(_docs(spark, sf).select("doc_id", "lang"), "lang", 100, "doc_id", total=350)


@query("win_06_contiguous_folds", f"""
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) * 10 // {N} AS INTEGER) AS fold FROM documents""")
def win_06(spark, sf):
    return order.contiguous_folds(_docs(spark, sf).select("doc_id"), 10, [F.col("doc_id")])


@query("win_07_last_wins", "SELECT source, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1")
def win_07(spark, sf):
    return order.last_wins(_docs(spark, sf), "source", "n_chars", "doc_id")


@query("win_08_carry_down", """
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 37 = 5 THEN source || doc_id END AS head FROM documents)
SELECT doc_id, head, last_value(head IGNORE NULLS) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS section FROM x""")
def win_08(spark, sf):
    heads = _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 37 == 5, F.concat("source", "doc_id")).alias("head"))
    return order.carry_down(heads, {"head": "section"}, [F.col("doc_id")])


@query("win_09_epoch_batches", f"""
WITH e AS (SELECT doc_id, epoch FROM documents, unnest([0, 1, 2]) AS x(epoch)),
  r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5('7:' || epoch || ':' || doc_id), doc_id) - 1 AS i FROM e)
SELECT doc_id, epoch, CAST(i // 64 AS INTEGER) AS batch FROM r""")
def win_09(spark, sf):
    return order.epoch_batches(_docs(spark, sf).select("doc_id"), "doc_id", 64, 3, seed=7)


@query("lim_01_row_limit", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def lim_01(spark, sf):
    return order.first_rows(_docs(spark, sf).select("doc_id", "lang"), 100, [F.col("doc_id")])


@query("lim_03_top_classes", """
SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 4)""")
def lim_03(spark, sf):
    return sampling.top_classes(_docs(spark, sf).select("doc_id", "source"), "source", 4)


@query("lim_04_sorted_topics", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source")
def lim_04(spark, sf):
    return sampling.class_counts(_docs(spark, sf), "source").orderBy(F.desc("n"), "source")


@query("smp_01_stratified_sample", f"""
WITH q AS (SELECT lang, CAST(round_even(count(*) * 300.0 / {N}, 0) AS BIGINT) AS quota FROM documents GROUP BY 1),
  r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {h(3)}, doc_id) AS rn FROM documents)
SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE rn <= quota""")
def smp_01(spark, sf):
    return sampling.stratified_sample(_docs(spark, sf), "lang", 300, "doc_id", seed=3).select("doc_id", "lang")


@query("smp_02_capped_per_class", f"""
SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {h(4)}, doc_id) <= 120""")
def smp_02(spark, sf):
    return sampling.cap_per_class(_docs(spark, sf), "lang", 120, "doc_id", seed=4).select("doc_id", "lang")


@query("smp_03_uniform_sample", f"SELECT doc_id, lang FROM documents ORDER BY {h(5)}, doc_id LIMIT 200")
def smp_03(spark, sf):
    return sampling.sample_rows(_docs(spark, sf), 200, "doc_id", seed=5).select("doc_id", "lang")


def bits(text):
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


@query("smp_03_with_replacement", f"""
WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY {h(6)}, doc_id) AS rk FROM documents),
  d AS (SELECT i AS draw, {bits("'6#' || i")} % {N} + 1 AS rk FROM generate_series(0, 499) AS g(i))
SELECT draw, doc_id, lang FROM d JOIN r USING (rk)""")
def smp_03_rep(spark, sf):
    return sampling.sample_rows(_docs(spark, sf), 500, "doc_id", seed=6, replace=True).select("draw", "doc_id", "lang")


@query("smp_04_stratified_split_total", f"""
WITH q AS (SELECT lang, CAST(round_even(count(*) * 250.0 / {N}, 0) AS BIGINT) AS quota FROM documents GROUP BY 1),
  r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {h(8)}, doc_id) AS rn FROM documents)
SELECT doc_id, lang, rn <= quota AS is_test FROM r JOIN q USING (lang)""")
def smp_04(spark, sf):
    return sampling.stratified_split(_docs(spark, sf).select("doc_id", "lang"), "lang", 250, "doc_id", seed=8)


@query("smp_04_stratified_split_share", f"""
WITH q AS (SELECT source, CAST(round_even(count(*) * (1.0 / 14), 0) AS BIGINT) AS quota FROM documents GROUP BY 1),
  r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {h(9)}, doc_id) AS rn FROM documents)
SELECT doc_id, source, rn <= quota AS is_test FROM r JOIN q USING (source)""")
def smp_04_share(spark, sf):
    return sampling.stratified_split(_docs(spark, sf).select("doc_id", "source"), "source", 1 / 14, "doc_id", seed=9)


@query("smp_05_shuffled_folds", f"""SELECT doc_id, CAST({bits("'11:' || doc_id")} % 10 AS INTEGER) AS fold FROM documents""")
def smp_05(spark, sf):
    return sampling.hash_folds(_docs(spark, sf).select("doc_id"), 10, "doc_id", seed=11)


@query("smp_06_ordered_holdout", f"""
SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= floor({N} * 0.8) AS is_train FROM documents""")
def smp_06(spark, sf):
    return sampling.holdout(_docs(spark, sf).select("doc_id"), 0.8, [F.col("doc_id")])


@query("smp_06_random_holdout", f"SELECT doc_id, {bits(h(1)[4:-1])} < {int(0.8 * (1 << 60))} AS is_train FROM documents")
def smp_06_random(spark, sf):
    return sampling.random_holdout(_docs(spark, sf).select("doc_id"), 0.8, "doc_id", seed=1)


@query("smp_07_shuffled_dirs", """
WITH x AS (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.json' AS path, source AS dir FROM documents)
SELECT path FROM x ORDER BY md5('2:' || dir), dir, path LIMIT 180""")
def smp_07(spark, sf):
    paths = _docs(spark, sf).select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".json")).alias("path"))
    return sampling.sample_dirs(paths, "path", 180, seed=2)


# ---- cluster statistics: every word is in one of K clusters, dealt out by rank ----

K = 128
PAIRS_SQL = f"""t AS (SELECT {k.words('text')} AS a FROM documents),
  pw AS (SELECT a[i] AS first, a[i + 1] AS second, count(*) AS n FROM (SELECT a, unnest(generate_series(1, len(a) - 1)) AS i FROM t) GROUP BY 1, 2)"""
UNI_BI = """uni AS (SELECT cluster AS c, sum(tf) / (SELECT sum(tf) FROM c) AS p FROM c JOIN a USING (token) GROUP BY 1),
  bi AS (SELECT x.cluster AS c1, y.cluster AS c2, sum(n) / (SELECT sum(n) FROM pw) AS p FROM pw JOIN a x ON x.token = first JOIN a y ON y.token = second GROUP BY 1, 2)"""
CSTATE = f"""{C}, a AS (SELECT token, CAST((row_number() OVER (ORDER BY tf DESC, token) - 1) % {K} + 1 AS INTEGER) AS cluster FROM c),
  {PAIRS_SQL}, {UNI_BI}"""


def _word_tables(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return settled(vocab.term_counts(docs, "doc_id", analyze("text"))), cl.adjacent_pairs(docs, "doc_id", analyze("text"))


def _dealt(words):
    return vocab.build_vocab(words).select("token", (F.col("id") % K + 1).cast("int").alias("cluster"))


def _cluster_state(spark, sf):
    words, pairs = _word_tables(spark, sf)
    return cl.cluster_distributions(words, pairs, _dealt(words))


@query("agg_12_cluster_unigrams", f"WITH {CSTATE} SELECT c, round(p, 9) AS p FROM uni")
def agg_12_uni(spark, sf):
    return _cluster_state(spark, sf)[0].withColumn("p", F.round("p", 9))


@query("agg_12_cluster_bigrams", f"WITH {CSTATE} SELECT c1, c2, round(p, 9) AS p FROM bi")
def agg_12_bi(spark, sf):
    return _cluster_state(spark, sf)[1].withColumn("p", F.round("p", 9))


W_SQL = """w2 AS (SELECT least(c1, c2) AS c1, greatest(c1, c2) AS c2, sum(bi.p * ln(bi.p / (x.p * y.p))) AS w
  FROM bi JOIN uni x ON x.c = c1 JOIN uni y ON y.c = c2 GROUP BY 1, 2)"""


@query("agg_13_mutual_information", f"WITH {CSTATE}, {W_SQL} SELECT c1, c2, round(w, 8) AS w FROM w2")
def agg_13(spark, sf):
    uni, bi = _cluster_state(spark, sf)
    return cl.mutual_information(uni, bi).withColumn("w", F.round("w", 8))


LOSS = f"""{W_SQL}, full_w AS (SELECT c1, c2, w FROM w2 UNION ALL SELECT c2, c1, w FROM w2 WHERE c1 <> c2),
  x AS (SELECT i.c AS i, j.c AS j, d.c AS d, i.p + j.p AS pc, d.p AS pd,
     coalesce(b1.p, 0) + coalesce(b2.p, 0) AS o, coalesce(b3.p, 0) + coalesce(b4.p, 0) AS n, coalesce(w1.w, 0) + coalesce(w2_.w, 0) AS ww
   FROM uni i JOIN uni j ON i.c < j.c CROSS JOIN uni d
   LEFT JOIN bi b1 ON b1.c1 = i.c AND b1.c2 = d.c LEFT JOIN bi b2 ON b2.c1 = j.c AND b2.c2 = d.c
   LEFT JOIN bi b3 ON b3.c1 = d.c AND b3.c2 = i.c LEFT JOIN bi b4 ON b4.c1 = d.c AND b4.c2 = j.c
   LEFT JOIN full_w w1 ON w1.c1 = i.c AND w1.c2 = d.c LEFT JOIN full_w w2_ ON w2_.c1 = j.c AND w2_.c2 = d.c),
  losses AS (SELECT i AS c1, j AS c2, sum(CASE WHEN o > 0 THEN o * ln(o / (pc * pd)) ELSE 0 END + CASE WHEN n > 0 THEN n * ln(n / (pc * pd)) ELSE 0 END - ww) AS loss
   FROM x GROUP BY 1, 2)"""


@query("agg_14_merge_losses", f"WITH {CSTATE}, {LOSS} SELECT c1, c2, round(loss, 8) AS loss FROM losses")
def agg_14(spark, sf):
    uni, bi = _cluster_state(spark, sf)
    return cl.merge_losses(uni, bi).withColumn("loss", F.round("loss", 8))


@query("agg_14_best_merge", f"WITH {CSTATE}, {LOSS} SELECT c1, c2, round(loss, 8) AS loss FROM losses ORDER BY losses.loss DESC, c1, c2 LIMIT 1")
def agg_14_best(spark, sf):
    uni, bi = _cluster_state(spark, sf)
    return cl.best_merge(cl.merge_losses(uni, bi)).withColumn("loss", F.round("loss", 8))


@query("jn_12_cluster_pairs", f"""
WITH {CSTATE}, o AS (SELECT c, p, row_number() OVER (ORDER BY c) - 1 AS idx FROM uni)
SELECT CAST(x.idx AS INTEGER) AS i, CAST(y.idx AS INTEGER) AS j, x.c AS c1, y.c AS c2, round(x.p + y.p, 9) AS p FROM o x JOIN o y ON x.idx < y.idx""")
def jn_12(spark, sf):
    from gramloom.operators.joins import cluster_pairs
    words = settled(vocab.term_counts(documents(spark, sf, "doc_id", "text"), "doc_id", analyze("text")))
    uni, _ = cl.cluster_distributions(words, None, _dealt(words))
    idx = settled(uni.withColumn("idx", (F.row_number().over(Window.orderBy("c")) - 1).cast("int")))  # K rows
    one, two = (idx.select(F.col("idx").alias(n), F.col("c").alias(c), F.col("p").alias(p)) for n, c, p in (("i", "c1", "p1"), ("j", "c2", "p2")))
    return cluster_pairs(idx).join(one, "i").join(two, "j").select("i", "j", "c1", "c2", F.round(F.col("p1") + F.col("p2"), 9).alias("p"))


@query("agg_15_cluster_sizes", f"""
WITH {C}, {top()}, {CL} SELECT cluster, count(*) AS n_words, (SELECT count(DISTINCT cluster) FROM cl) AS n_clusters FROM cl GROUP BY 1""")
def agg_15(spark, sf):
    return cl.cluster_sizes(_clusters(_top(_bags(spark, sf))))


@query("src_20_cluster_lines", f"""
WITH {C}, {top()}, {CL}
SELECT substr(cluster, 1, 4) AS cluster, token AS word, cf AS freq, 1 AS n_lines FROM cl WHERE id % 10 <> 3""")
def src_20(spark, sf):
    rows = _clusters(_top(_bags(spark, sf)))
    broken = F.when(F.col("line") % 10 == 3, F.lit("")).otherwise(F.lit("\t"))
    path = scratch_path(spark, "clusters")
    rows.select(F.concat("cluster", broken, "word", F.lit("\t"), F.col("freq").cast("string"))).write.text(path)
    return read_clusters(spark, path, prefix_size=4)[0].select("cluster", "word", "freq", "n_lines")


# the learner's first step: of the K + 1 most frequent words, the pair goes together whose merge costs least
STEP = 24
FIRST = f"""{C}, r AS (SELECT token, row_number() OVER (ORDER BY tf DESC, token DESC) AS rank FROM c), a AS (SELECT token, CAST(rank AS INTEGER) AS cluster FROM r WHERE rank <= {STEP + 1}),
  {PAIRS_SQL}, {UNI_BI}"""


@query("ml_20_first_merge", f"""
WITH {FIRST}, {LOSS}, best AS (SELECT c1, c2 FROM losses ORDER BY loss DESC, c1, c2 LIMIT 1)
SELECT token, CAST(CASE WHEN cluster = c2 THEN c1 ELSE cluster END AS INTEGER) AS cluster FROM a, best""")
def ml_20_first(spark, sf):
    return learner.cluster_words(*_word_tables(spark, sf), c=STEP, rounds=1)


@query("ml_20_cluster_learner")
def ml_20(spark, sf):
    return learner.cluster_words(*_word_tables(spark, sf), c=16)
