"""Training-data pipeline over `documents`: stages of the operators in gramloom.llm, each written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm.decontamination import contamination
from gramloom.llm.exactdedup import exact_dedup
from gramloom.llm.langid import UNKNOWN, fit_language_filters, identify, score_floors, size_class
from gramloom.llm.neardup import jaccard_join
from gramloom.llm.sentencepieces import encode_pieces, model_file
from gramloom.llm.tables import kept, table


# a text with this share of the n-grams of its language is recognised in any case; below it, the language's own rows decide
MIN_LANGUAGE_SHARE = 0.2


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language, or that have fewer of its n-grams than its own rows of their length, go.

    The floor is the lowest percentile of the scores of labelled rows of the predicted language, never above
    MIN_LANGUAGE_SHARE: where n-grams repeat little (no spaces, short texts) it is lower. Filters and floors are learned
    from all labelled rows; a language without rows of a length is judged by all its rows. Every text is identified once;
    scores are written without the texts.
    """
    rows, _ = numbered(docs)
    sized = rows.withColumn("_size", F.when(F.col("text").isNotNull(), size_class()))
    scored = kept(identify(sized, fit_language_filters(docs), carry=["_row", "lang", "_size"]), "languages")
    floors = kept(score_floors(scored, size="_size"), "language-floors")
    by_size = floors.where("size is not null").select(F.col("lang_pred").alias("_l"), F.col("size").alias("_s"), F.col("floor").alias("_by_size"))
    by_lang = floors.where("size is null").select(F.col("lang_pred").alias("_lang"), F.col("floor").alias("_by_lang"))
    found = scored.join(F.broadcast(by_size), (F.col("_l") == F.col("lang_pred")) & (F.col("_s") == F.col("_size")), "left")
    found = found.join(F.broadcast(by_lang), F.col("_lang") == F.col("lang_pred"), "left")
    floor = F.least(F.lit(MIN_LANGUAGE_SHARE), F.coalesce("_by_size", "_by_lang", F.lit(MIN_LANGUAGE_SHARE)))
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0) & (F.col("score") >= floor)
    return without(rows, found.where(~F.coalesce(known, F.lit(False))), "unknown-language", "_row").select(*docs.columns)


def without(docs: DataFrame, ids: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """Rows whose `key` is not among `ids`; these are written first, so that Spark knows their size when it plans the join."""
    return docs.join(kept(ids.select(key).distinct(), name), key, "left_anti")


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """`docs` with `_row`, which names a single row, and whether that is doc_id; where doc_id is null or repeated, row numbers are written once."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("_row", F.col("doc_id")), True
    return kept(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered"), False


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest doc_id stays."""
    found = kept(exact_dedup(docs, carry=["doc_id"]), "exact-copies")
    # where an id does not name a single row, rows stay or go one by one
    if found.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return without(docs, found.where("not kept"), "exact-dropped").select(*docs.columns)
    return exact_dedup(docs).where("kept").select(*docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the document with the smallest doc_id stays, one without only if all are."""
    rows, by_id = numbered(docs)
    found = jaccard_join(rows, "_row")
    if by_id:
        dropped = found.where("_row <> class_id")
    else:
        found = kept(found.where("n_links > 0").join(rows.select("_row", "doc_id"), "_row"), "near-rows")
        least = found.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("stays"))
        dropped = found.join(least, "class_id").where("_row <> stays")
    return without(rows, dropped, "near-dropped", "_row").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of ten words with a benchmark item go."""
    rows, _ = numbered(docs)
    found = contamination(rows, table(spark, sf_dir, "benchmark"), "_row", unnamed=True)
    return without(rows, found.where("contaminated"), "contaminated", "_row").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the byte span of each in the text."""
    pieces = encode_pieces(docs, model_file(), carry=docs.columns)
    return pieces.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("language_id", drop_unknown_language),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result of each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
