"""License scans: whole texts and their single lines, brought to one canonical form, joined by digest to known licences."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm.licences import NOTICES, SPELLINGS, TEXTS, TITLES
from gramloom.llm.tables import bit_filter, in_filter, kept, pieces, table

FILTER_BITS = 1 << 20
_GAPS = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))
# words that follow `copyright` in the body of a licence, where another word would be the holder
_BODY = (rb"(?:notice|holder|owner|law|act|interest|licen[cs]e|statement|claim|infringement|protection|permission|restriction|term|right)s?|ownership|treaty|treaties|"
         rb"status|information|material|disclaimer|and|or|in|is|are|was|may|shall|to|on|for|as|of|with|under|that|which|if|not|from")
# a line that opens, after comment marks, with a copyright statement: the word with (c), a sign, a year or a holder behind it
_STATEMENT = re.compile(rb"(^|\n)[ \t*#/;-]*(copyrights?[ \t]*(\(c\)|\xc2\xa9)|copyrights?(:[ \t]*|[ \t]+)(?!(" + _BODY + rb")(?![a-z0-9]))[^\s,.;:)\"']|"
                        rb"\(c\)|\xc2\xa9|all rights reserved)[^\n]*")
_SPELLINGS = {a.encode(): b.encode() for a, b in SPELLINGS.items()}


def canonical(text: bytes) -> bytes:
    """Lower case (A-Z), no copyright statements, one space for punctuation and white space, one spelling for each word."""
    low = _STATEMENT.sub(b"\n", text.lower())
    return b" ".join([_SPELLINGS.get(w, w) for w in low.translate(_GAPS).split()])


def _digest(text: bytes) -> bytes:
    return hashlib.sha256(canonical(text)).digest()


def _known_rows(batches):
    for batch in batches:
        found = [_digest(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.hex() for d in found], pa.string()),
                                          pa.array([int.from_bytes(d[:8], "little", signed=True) for d in found], pa.int64())], names=["license_id", "digest", "mark"])


def _doc_rows(bitmap: np.ndarray):
    nothing = hashlib.sha256(b"").digest()

    def run(batches):
        for batch in pieces(batches, 1):
            whole, offsets, lines = [], [0], []
            for text in pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist():
                whole.append(_digest(text).hex())
                parts = text.split(b"\n")
                if len(parts) > 1:
                    found = [_digest(p) for p in parts]
                    marks = np.frombuffer(b"".join(d[:8] for d in found), dtype="<u8")
                    lines += [found[i].hex() for i in np.flatnonzero(in_filter(bitmap, marks)) if found[i] != nothing]
                offsets.append(len(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lines, pa.string()))],
                                             names=["id", "digest", "lines"])

    return run


def known_licences(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the licence texts, bare and under each of their titles, and of the notices that come with the library."""
    titled = ((name, f"{title}\n\n{TEXTS[name]}") for name, titles in TITLES.items() for title in titles)
    rows = [*TEXTS.items(), *titled, *((name, notice) for name, notices in NOTICES.items() for notice in notices)]
    return spark.createDataFrame(rows, "license_id string, text string")


def scan_licenses(docs: DataFrame, licences: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, license_ids, notice_ids) for every row of `docs`.

    digest is the SHA-256 of the canonical form of the whole text, license_ids the licences with that very form,
    notice_ids those whose form equals that of a single line of a text of several lines; both are sorted arrays
    without repeats. Null and empty texts have the digest of nothing and match nothing, as do licences without words.
    Of a text only digests travel; lines are tested in place against a bitmap of fixed size, then joined.
    """
    known = licences.select("license_id", F.col("text").alias("t")).where("license_id is not null and t is not null")
    known = known.mapInArrow(_known_rows, "license_id string, digest string, mark bigint").where(F.col("digest") != hashlib.sha256(b"").hexdigest())
    known = kept(known.distinct(), "license-digests")
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    id_type = source.schema["id"].dataType.simpleString()
    rows = source.mapInArrow(_doc_rows(bit_filter(known, "mark", FILTER_BITS)), f"id {id_type}, digest string, lines array<string>")
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()), "license-rows")
    by_digest = known.groupBy("digest").agg(F.array_sort(F.collect_set("license_id")).alias("ids"))
    lines = rows.select("row", F.explode(F.array_distinct("lines")).alias("digest")).join(by_digest, "digest")
    notices = lines.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("notice_ids"))
    none = F.array().cast("array<string>")
    return (
        rows.join(by_digest, "digest", "left").join(notices, "row", "left")
        .select(F.col("id").alias(doc_id), "digest", F.coalesce("ids", none).alias("license_ids"), F.coalesce("notice_ids", none).alias("notice_ids"))
    )


def op10_license_scan(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents"), known_licences(spark))
    return found.select("doc_id", F.col("digest").alias("text_sha256"), F.array_join("license_ids", ",").alias("license_ids"), F.array_join("notice_ids", ",").alias("notice_ids"))


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    titled = [(name, f"{title}\n\n{TEXTS[name]}") for name, titles in TITLES.items() for title in titles]
    known = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in [*TEXTS.items(), *titled, *((n, x) for n, xs in NOTICES.items() for x in xs)])
    words = "map {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in SPELLINGS.items()) + "}"

    # line by line; the next word is looked at by itself, as this engine's patterns cannot look ahead
    opening = r"^[ \t*#/;-]*"
    named = rf"{opening}copyrights?(:[ \t]*|[ \t]+)"
    surely = rf"{opening}(copyrights?[ \t]*(\(c\)|©)|\(c\)|©|all rights reserved)"
    statement = (rf"regexp_matches(x, {quoted(surely)}) OR (regexp_matches(x, {quoted(named + r"""[^ \t\n\r\f\x0B,.;:)"']""")})"
                 rf" AND NOT regexp_matches(x, {quoted(f'{named}({_BODY.decode()})($|[^a-z0-9])')}))")

    def digest(t: str) -> str:
        low = f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        plain = f"array_to_string(list_transform(string_split({low}, chr(10)), lambda x: CASE WHEN {statement} THEN '' ELSE x END), chr(10))"
        spaced = rf"trim(regexp_replace({plain}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
        return f"sha256(array_to_string(list_transform(string_split({spaced}, ' '), lambda w: coalesce(m[w], w)), ' '))"

    return f"""
WITH s AS (SELECT {words} AS m),
k AS (SELECT DISTINCT license_id, {digest("t")} AS digest FROM (VALUES {known}) v(license_id, t), s),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {digest("t")} AS text_sha256 FROM d, s),
l AS (SELECT DISTINCT doc_id, {digest("line")} AS digest FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d WHERE contains(t, chr(10))), s),
n AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notice_ids FROM l JOIN k USING (digest) GROUP BY 1),
f AS (SELECT digest, array_to_string(list_sort(list(license_id)), ',') AS license_ids FROM k GROUP BY 1)
SELECT w.doc_id, text_sha256, coalesce(license_ids, '') AS license_ids, coalesce(notice_ids, '') AS notice_ids
FROM w LEFT JOIN f ON f.digest = text_sha256 LEFT JOIN n ON n.doc_id = w.doc_id
"""


SQL = _sql()
