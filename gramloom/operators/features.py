"""Document features: weights, clusters, vectors, feature scores, closed-form naive Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gramloom.operators.joins import join_dictionary, to_clusters, to_vectors
from gramloom.operators.topics import WIDE, project_wide
from gramloom.session import checkpointed, settled


def vector_sum(df: DataFrame, key: str, vec: str, weight: Column, width: int) -> DataFrame:
    """Weighted sum of array vectors of `width` numbers per key: (key, vec, weight).

    A sum per number is kept in place in a hash table of the keys, so that rows with vectors are neither sorted nor shuffled before they are added up.
    """
    rows = df.select(key, F.col(vec).cast("array<double>").alias("_v"), weight.cast("double").alias("_w"))
    total = F.array(*[F.sum(F.col("_w") * F.col("_v")[i]) for i in range(width)]).cast("array<double>")
    return rows.groupBy(key).agg(total.alias("vec"), F.sum("_w").alias("weight"))


def width_of(vectors: DataFrame, vec: str = "vec") -> int:
    """Numbers of a vector; 0 without vectors."""
    return max(vectors.agg(F.max(F.size(vec))).first()[0] or 0, 0)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))


def row_normalize(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows of unit length; zero rows stay."""
    n = norm(F.col(vec))
    return df.withColumn(vec, F.when(n == 0, F.col(vec)).otherwise(F.transform(vec, lambda x: x / n)))


def embed_documents(tf: DataFrame, vectors: DataFrame, how: str = "mean", vocab: DataFrame | None = None,
                    key: str = "doc_id") -> DataFrame:
    """Document vector from (key, token, tf): `sum`, `mean` of known tokens, or `unit`-length sum.

    A sum whose length is at most 1e-5 is left unscaled. Documents without any known token have no row.
    """
    vectors = settled(vectors)
    summed = vector_sum(to_vectors(tf, vectors, vocab), key, "vec", F.col("tf"), width_of(vectors))
    if how == "mean":
        return summed.select(key, F.transform("vec", lambda x: x / F.col("weight")).alias("vec"))
    if how == "unit":
        n = norm(F.col("vec"))
        return summed.select(key, F.when(n > 1e-5, F.transform("vec", lambda x: x / n)).otherwise(F.col("vec")).alias("vec"))
    if how != "sum":
        raise ValueError(how)
    return summed.select(key, "vec")


def cluster_columns(clusters: DataFrame) -> DataFrame:
    """Column id of each cluster in sorted order; one row per cluster."""
    return clusters.select("cluster").distinct().withColumn(
        "feature", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("bigint"))


def cluster_features(tf: DataFrame, clusters: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens per document and cluster: (key, cluster, value)."""
    return to_clusters(tf, clusters).groupBy(key, "cluster").agg(F.sum("tf").cast("bigint").alias("value"))


def vector_cluster_features(tf: DataFrame, assign: DataFrame, key: str = "doc_id") -> DataFrame:
    """Histogram of vector clusters per document, cluster 0 included: (key, feature, value)."""
    hits = join_dictionary(tf, assign.select("token", F.col("cluster_id").cast("bigint").alias("feature")))
    return hits.groupBy(key, "feature").agg(F.sum("tf").cast("bigint").alias("value"))


def _weighted(tf: DataFrame, vocab: DataFrame, weight: Column, idf: Column, key: str) -> DataFrame:
    joined = join_dictionary(tf.select(key, "token", "tf"), vocab.select("token", "df"))
    rows = joined.select(key, "token", (weight * idf).alias("w")).where("w <> 0")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return rows.select(key, "token", (F.col("w") / length).alias("w"))


def tfidf_smooth(tf: DataFrame, vocab: DataFrame, n_docs: Column, sublinear: bool = False, key: str = "doc_id") -> DataFrame:
    """tf or 1 + ln tf, times ln((1 + N) / (1 + df)) + 1, rows of unit length."""
    weight = F.log("tf") + 1 if sublinear else F.col("tf")
    return _weighted(tf, vocab, weight, F.log((n_docs + 1) / (F.col("df") + 1)) + 1, key)


def tfidf_log2(tf: DataFrame, vocab: DataFrame, n_docs: Column, key: str = "doc_id") -> DataFrame:
    """tf times log2(N / df), rows of unit length; terms of every document vanish."""
    return _weighted(tf, vocab, F.col("tf"), F.log2(n_docs / F.col("df")), key)


def project_topics(weights: DataFrame, topics: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fold documents (key, token, w) into a topic space (token, vec)."""
    topics = settled(topics)
    width = width_of(topics)
    if width > WIDE:
        return project_wide(weights, topics, key)
    return vector_sum(to_vectors(weights, topics), key, "vec", F.col("w"), width).select(key, "vec")


def feature_f_score(features: DataFrame, labels: DataFrame, key: str, variant: str = "sum") -> DataFrame:
    """Separation of a binary label by each feature of (key, feature, value), absent values being zero.

    `mean` is the published score: squared distances of class means from the overall mean over the
    within-class variances (with n - 1). `sum` uses class sums in place of means throughout, and 1/n.
    """
    sizes = labels.groupBy().agg(F.count_if("is_pos").alias("np"), F.count_if(~F.col("is_pos")).alias("nn"))
    n_pos, n_neg = sizes.select("np").scalar(), sizes.select("nn").scalar()
    v = F.col("value").cast("double")
    pos = F.col("is_pos")

    def per_class(x: Column, cond: Column) -> Column:
        return F.sum(F.when(cond, x).otherwise(0.0))

    s = features.join(labels.select(key, "is_pos"), key).groupBy("feature").agg(
        per_class(v, pos).alias("sp"), per_class(v, ~pos).alias("sn"),
        per_class(v * v, pos).alias("qp"), per_class(v * v, ~pos).alias("qn"))
    s = s.withColumn("np", n_pos.cast("double")).withColumn("nn", n_neg.cast("double"))
    if variant == "sum":
        top = F.pow(F.col("sp") - (F.col("sp") + F.col("sn")), F.lit(2)) + F.pow(F.col("sn") - (F.col("sp") + F.col("sn")), F.lit(2))
        # sum over a class of (x - S)^2 with S the class sum
        dev_p = F.col("qp") - 2 * F.col("sp") * F.col("sp") + F.col("np") * F.col("sp") * F.col("sp")
        dev_n = F.col("qn") - 2 * F.col("sn") * F.col("sn") + F.col("nn") * F.col("sn") * F.col("sn")
        score = F.try_divide(top, dev_p / F.col("np") + dev_n / F.col("nn"))
    elif variant == "mean":
        mp, mn = F.col("sp") / F.col("np"), F.col("sn") / F.col("nn")
        m = (F.col("sp") + F.col("sn")) / (F.col("np") + F.col("nn"))
        top = F.pow(mp - m, F.lit(2)) + F.pow(mn - m, F.lit(2))
        score = F.try_divide(top, (F.col("qp") - F.col("np") * mp * mp) / (F.col("np") - 1)
                             + (F.col("qn") - F.col("nn") * mn * mn) / (F.col("nn") - 1))
    else:
        raise ValueError(variant)
    return s.select("feature", score.alias("score"))


def nb_model(tf: DataFrame, labels: DataFrame, key: str = "doc_id", smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes from counts: (class table with log prior, token table of log likelihoods).

    The token table holds one array per token, indexed like the sorted classes of the class table.
    """
    classes = labels.groupBy("label").agg(F.count("*").alias("n"))
    classes = classes.withColumn("idx", F.row_number().over(Window.orderBy("label")) - 1)
    n_docs = labels.agg(F.count("*")).scalar()
    counts = checkpointed(tf.join(labels, key).groupBy("label", "token").agg(F.sum("tf").alias("n")))
    n_terms = counts.agg(F.count_distinct("token")).scalar()
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    classes = checkpointed(classes.join(totals, "label").select(
        "label", "idx", F.log(F.col("n") / n_docs).alias("prior"), "total", n_terms.alias("n_terms")))
    per_class = counts.join(F.broadcast(classes), "label")
    sparse = per_class.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("idx", "n"))).alias("by_class"))
    order = classes.agg(F.sort_array(F.collect_list(F.struct("idx", "total", "n_terms")))).scalar()
    model = sparse.withColumn("_c", order).select("token", F.transform("_c", lambda c: F.log(
        (F.coalesce(F.try_element_at("by_class", c["idx"]), F.lit(0)) + smoothing) / (c["total"] + smoothing * c["n_terms"]))).alias("vec"))
    return classes.select("label", "idx", "prior"), checkpointed(model)


def nb_predict(tf: DataFrame, classes: DataFrame, model: DataFrame, key: str = "doc_id") -> DataFrame:
    """Most likely class of each document: (key, prediction, score)."""
    summed = vector_sum(to_vectors(tf, model), key, "vec", F.col("tf"), width_of(model))
    order = classes.agg(F.sort_array(F.collect_list(F.struct("idx", "label", "prior")))).scalar()
    scored = summed.withColumn("_c", order).select(key, F.zip_with(
        "vec", "_c", lambda v, c: F.struct((v + c["prior"]).alias("score"), (-c["idx"]).alias("first"), c["label"].alias("label"))).alias("_s"))
    best = F.array_max("_s")
    return scored.select(key, best["label"].alias("prediction"), best["score"].alias("score"))


def normalize_long(features: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long feature rows scaled to unit length per key."""
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(key)))
    return features.withColumn("value", F.col("value") / length)
