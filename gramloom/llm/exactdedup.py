"""Exact dedup by progressive refinement: byte length, then a hash of the beginning, then a hash of the whole text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.tables import bit_filter, in_filter, kept, table

PREFIX_BYTES = 64
FILTER_BITS = 1 << 24


def _beginnings(prefix: int):
    """(length, hash of length and beginning) of every text."""

    def rows(batches):
        for batch in batches:
            whole = pc.fill_null(batch.column(0), "").cast(pa.binary())
            size = pc.binary_length(whole).cast(pa.int64())
            first = pc.binary_slice(whole, 0, prefix).to_pylist()
            mark = [xxhash.xxh64_intdigest(p.lower(), seed=n) for n, p in zip(size.to_pylist(), first)]
            yield pa.RecordBatch.from_arrays([size, pa.array(np.array(mark, dtype=np.uint64).view(np.int64))], names=["size", "mark"])

    return rows


def _digests(names: list[str], at: int, carried: list[str], prefix: int, sizes: np.ndarray, marks: np.ndarray, shown: str | None = None):
    """Carried columns, length, mark, and the full digest where length and mark may have company; `shown` names a column with the digest of every text."""

    def rows(batches):
        for batch in batches:
            whole = pc.fill_null(batch.column(at), "").cast(pa.binary())
            size = pc.binary_length(whole).cast(pa.int64())
            mark, full = np.zeros(batch.num_rows, dtype=np.uint64), [None] * batch.num_rows
            for i in np.flatnonzero(in_filter(sizes, size.to_numpy())):
                mark[i] = xxhash.xxh64_intdigest(whole[i].as_buffer().slice(0, min(prefix, size[i].as_py())).to_pybytes().lower(), seed=size[i].as_py())
            alike = in_filter(sizes, size.to_numpy()) & in_filter(marks, mark)
            every = [None] * batch.num_rows
            for i in range(batch.num_rows) if shown else np.flatnonzero(alike):
                digest = hashlib.sha256(whole[int(i)].as_py().lower())
                full[i], every[i] = digest.digest() if alike[i] else None, digest.hexdigest()
            columns = [batch.column(names.index(c)) for c in carried]
            last = [pa.array(every, pa.string())] if shown else []
            yield pa.RecordBatch.from_arrays([*columns, size, pa.array(mark.view(np.int64)), pa.array(full, pa.binary()), *last],
                                             names=[*carried, "_size", "_mark", "_full", *([shown] if shown else [])])

    return rows


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None,
                prefix: int = PREFIX_BYTES, filter_bits: int = FILTER_BITS, digest: str | None = None) -> DataFrame:
    """Columns `carry` (all by default) of every row, with keep_id, group_size and kept.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest doc_id stays (a null doc_id is the smallest; keep_id is null if all are). Of repeated rows with that
    same id exactly one is marked kept. Other columns keep their names; those of the result and names with a leading
    underscore are the operator's.

    First pass: lengths are counted, then (length, hash of the first `prefix` bytes) among lengths that occur twice.
    Second pass: only rows whose length and mark both recur are hashed in full; two bitmaps of fixed size tell
    which (one that fills up costs hashing, no row). Texts are never shuffled, unless `carry` holds them and the
    table of groups is too large to broadcast. A hot group is counted in every task before its counts travel.
    `digest` asks for a column with the SHA-256 of every normalised text; it is taken in the last pass.
    """
    carry = list(docs.columns if carry is None else carry)
    taken = {"keep_id", "group_size", "kept", *([digest] if digest else [])}
    if taken & set(carry):
        docs, carry = docs.drop(*taken), [c for c in carry if c not in taken]
    marks = docs.select(F.col(text).alias("t")).mapInArrow(_beginnings(prefix), "size bigint, mark bigint")
    marks = kept(marks.groupBy("size", "mark").agg(F.count("*").alias("n")), "dedup-marks")
    lengths = marks.groupBy("size").agg(F.sum("n").alias("n")).where("n > 1")
    alike = marks.where("n > 1").join(lengths, "size", "left_semi")
    sizes, begun = bit_filter(lengths, "size", filter_bits), bit_filter(alike, "mark", filter_bits)

    source = docs.select(*carry, F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    fields = [f for f in source.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _size bigint, _mark bigint, _full binary" + (f", `{digest}` string" if digest else "")
    run = _digests(source.columns, len(source.columns) - 1, [f.name for f in fields], prefix, sizes, begun, digest)
    rows = source.mapInArrow(run, schema)

    light = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    light_type = light.schema["_id"].dataType.simpleString()
    hashed = light.mapInArrow(_digests(["_id", "_text"], 1, ["_id"], prefix, sizes, begun), f"_id {light_type}, _size bigint, _mark bigint, _full binary")
    same = hashed.where("_full is not null").groupBy("_size", "_mark", "_full", "_id").agg(F.count("*").alias("_c"))
    best = F.max_by("_c", F.struct(F.col("_id").isNotNull(), "_id")).alias("_ties")
    same = kept(same.groupBy("_size", "_mark", "_full").agg(F.sum("_c").alias("_n"), F.max("_id").alias("_keep"), best).where("_n > 1"), "dedup-groups")

    joined = rows.join(same, ["_size", "_mark", "_full"], "left").withColumns({
        "keep_id": F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")), "group_size": F.coalesce("_n", F.lit(1)).cast("bigint")})
    joined = joined.withColumn("kept", F.col("keep_id").eqNullSafe(F.col("_id")))
    out = [*carry, "keep_id", "group_size", "kept", *([digest] if digest else [])]
    if same.where("_ties > 1").isEmpty():
        return joined.select(*out)
    # repeated rows of the kept id: the one with the smallest row number stays
    tied = joined.withColumn("_tied", F.col("kept") & (F.coalesce("_ties", F.lit(1)) > 1)).withColumn("_row", F.monotonically_increasing_id())
    tied = kept(tied.select(*out, "_tied", "_row", "_size", "_mark", "_full"), "dedup-ties")
    first = tied.where("_tied").groupBy("_size", "_mark", "_full").agg(F.min("_row").alias("_first"))
    told = tied.join(first, ["_size", "_mark", "_full"], "left")
    return told.withColumn("kept", F.when(F.col("_tied"), F.col("_row") == F.col("_first")).otherwise(F.col("kept"))).select(*out)


def op8_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, carry=["doc_id"], digest="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
