"""Benchmark decontamination by winnowing.

Of every `span` consecutive words, the smallest of the hashes of its K-word grams is the fingerprint. Equal
spans have equal fingerprints, so a join of the fingerprints of documents and items finds every shared span;
each hit is then extended to the whole span by a second, independent hash, and hits that touch are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.tables import bit_filter, in_filter, kept, pieces, sha_hex, table
from gramloom.llm.words import ngrams, whole, word_hashes

K = 5
SPAN = 10
FILTER_BITS = 1 << 24
_FP, _SPAN, _SHORT = 1, 2, 3  # seeds


def _windows(words: np.ndarray, offsets: np.ndarray, span: int, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, starts, fingerprints, span hashes) for windows of `span` words and of each shorter item length."""
    at = whole(offsets, span)
    if len(at):
        grams = ngrams(words, K, _FP)
        least = np.lib.stride_tricks.sliding_window_view(grams, span - K + 1).min(axis=1)
        yield span, at, least[at], ngrams(words, span, _SPAN)[at]
    for n in short:
        at = whole(offsets, n)
        if len(at):
            yield n, at, ngrams(words, n, _SHORT)[at], ngrams(words, n, _SPAN)[at]


def _item_rows(span: int):
    def rows(batches):
        for part in pieces(batches, 1):
            words, offsets = word_hashes(part.column(1))
            counts = np.diff(offsets)
            short = sorted({int(n) for n in counts if 0 < n < span})
            for n, at, fp, whole_hash in _windows(words, offsets, span, short):
                item = np.searchsorted(offsets, at, side="right") - 1
                own = np.flatnonzero((counts[item] == n) | (n == span))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(item[own])), pa.array(np.full(len(own), n, dtype=np.int32)),
                    pa.array(fp[own].view(np.int64)), pa.array(whole_hash[own].view(np.int64))], names=["item", "n", "fp", "span_hash"])

    return rows


def _doc_rows(span: int, short: list[int], bitmap: np.ndarray):
    def rows(batches):
        for part in pieces(batches, 1):
            words, offsets = word_hashes(part.column(1))
            found = [(n, at[hit], fp[hit], whole_hash[hit]) for n, at, fp, whole_hash in _windows(words, offsets, span, short)
                     for hit in [np.flatnonzero(in_filter(bitmap, fp))]]
            at = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)])
            doc = np.searchsorted(offsets, at, side="right") - 1
            order = np.argsort(doc, kind="stable")
            ends = np.searchsorted(doc[order], np.arange(part.num_rows + 1))
            n = np.concatenate([np.zeros(0, np.int32), *(np.full(len(x[1]), x[0], np.int32) for x in found)])
            fp, whole_hash = (np.concatenate([np.zeros(0, np.uint64), *(x[i] for x in found)]).view(np.int64) for i in (2, 3))
            hits = pa.StructArray.from_arrays([pa.array(x[order]) for x in ((at - offsets[doc]).astype(np.int32), n, fp, whole_hash)],
                                              names=["start", "n", "fp", "span_hash"])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits)],
                                             names=["id", "n_words", "hits"])

    return rows


def shared_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
                 span: int = SPAN, filter_bits: int = FILTER_BITS, unnamed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every span of `span` words that documents share with items; an item of fewer words is one span.

    Returns three tables: documents (row, doc_id, n_words), passages (row, start, end: words, end exclusive, of
    maximal runs covered by shared spans) and matches (row, item_id). `row` numbers the rows of `docs`, so that
    repeated ids stay apart. Null and empty texts have no words; an empty table of items gives no passages. Items with
    a null id are left out unless `unnamed` is set; then they count as one item with a null item_id.

    Documents are read once. A bitmap of fixed size keeps windows whose fingerprint no item has from being
    shuffled; the joins decide. A passage common to many documents meets one row for each distinct item window.
    """
    if span < K:
        raise ValueError(f"span must be at least {K} words")
    items = items.select(F.col(item_id).alias("item"), F.col(text).alias("t"))
    items = items if unnamed else items.where("item is not null")
    item_type = items.schema["item"].dataType.simpleString()
    grams = kept(items.mapInArrow(_item_rows(span), f"item {item_type}, n int, fp bigint, span_hash bigint").distinct(), "decon-items")
    short = sorted(r[0] for r in grams.where(F.col("n") < span).select("n").distinct().collect())
    bitmap = bit_filter(grams, "fp", filter_bits)
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    id_type = source.schema["id"].dataType.simpleString()
    found = source.mapInArrow(_doc_rows(span, short, bitmap), f"id {id_type}, n_words bigint, hits array<struct<start:int,n:int,fp:bigint,span_hash:bigint>>")
    found = kept(found.withColumn("row", F.monotonically_increasing_id()), "decon-docs")

    known = grams.select("n", "fp", "span_hash").distinct()
    hits = kept(found.select("row", F.explode("hits").alias("h")).select("row", "h.*").join(known, ["n", "fp", "span_hash"], "left_semi"), "decon-hits")
    before = Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, 0)
    runs = hits.select("row", "start", "n", (F.col("start") + F.col("n")).alias("end"))
    runs = runs.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(upto))
    passages = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
    matches = (
        hits.select("row", "n", "fp", "span_hash").distinct().join(grams, ["n", "fp", "span_hash"])
        .select("row", F.col("item").alias(item_id)).distinct()
    )
    return found.select("row", F.col("id").alias(doc_id), "n_words"), passages, matches


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
                  span: int = SPAN, unnamed: bool = False) -> DataFrame:
    """One row per document: words, words inside shared spans, items found and their ids, contaminated or not.

    Items with a null id are left out unless `unnamed` is set; then they stand in `items` as one null at the end.
    """
    rows, passages, matches = shared_spans(docs, items, doc_id, item_id, text, span, unnamed=unnamed)
    covered = passages.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    nameless = F.array_repeat(F.lit(None).cast("string"), F.count_if(F.col(item_id).isNull()).cast("int"))
    per_doc = matches.groupBy("row").agg(F.concat(F.array_sort(F.collect_list(F.col(item_id).cast("string"))), nameless).alias("items"))
    joined = rows.join(covered, "row", "left").join(per_doc, "row", "left")
    return joined.select(
        doc_id, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def op9_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        sha_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, g FROM dw WHERE (n, g) IN (SELECT (n, g) FROM bw)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY 1),
m AS (SELECT doc_id, list(DISTINCT item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, n, g FROM h) JOIN bw USING (n, g) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
