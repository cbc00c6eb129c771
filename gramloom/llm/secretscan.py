"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

All of it is DataFrame expressions. A pattern's matches and the lengths between them give positions; models are
counts of character pairs in labelled samples, and a string is a secret when the models' log-likelihood ratio says so.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.tables import kept, sha_hex, table

# fixed values: base kinds in their order, pattern, group that is measured, least length of it
BASE_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
# maximal runs of digits below 24 are of no interest; the same matches are left with fewer steps
_FASTER = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}
MARKOV = "markov"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,}"
ALPHABET = 64 + 2  # characters of candidates and the end mark
MIN_RATIO = 15.0
MIN_MEAN = 0.5
MIN_DISTINCT = 8
SAMPLE_DOCS = 20_000
_END = 0


def _pairs(s: Column) -> Column:
    """Codes of neighbouring characters, both ends marked: 128 x code before + code."""
    codes = F.concat(F.array(F.lit(_END)), F.transform(F.split(s, ""), lambda c: F.ascii(c)), F.array(F.lit(_END)))
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * 128 + b)


def fit_ratio(samples: DataFrame, sample: str = "sample", is_random: str = "is_random", prior: float = 50.0, ordinary_prior: float = 0.5,
              floor: float = 0.05) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of every pair of ASCII characters.

    `samples` are strings with a label. Pair counts, at most 128 x 128 for each label, are all that comes to the
    driver. The prior of a random string is even over the alphabet with the weight of `prior` characters after
    each character; ordinary strings have a thin one, after the frequencies of their characters, and the share `floor` of them is
    taken to be any character, so that a few signs unknown to the samples decide nothing. Null or empty samples and labels count for nothing; without
    samples of a label its prior remains.
    """
    rows = samples.where(F.col(is_random).isNotNull() & (F.length(sample) > 0) & ~F.col(sample).rlike(r"[^\x01-\x7F]"))
    counts = rows.select(F.col(is_random).alias("r"), F.explode(_pairs(F.col(sample))).alias("pair")).groupBy("r", "pair").count()
    seen: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r, pair, n in counts.collect():
        seen[bool(r)][pair] = n
    before, after = ({r: [0] * 128 for r in seen} for _ in range(2))
    for r, pairs in seen.items():
        for pair, n in pairs.items():
            before[r][pair // 128] += n
            after[r][pair % 128] += n

    def log_p(r: bool, pair: int) -> float:
        """A pair never seen leans on the frequency of its second character, for random strings on the even prior."""
        weight = prior if r else ordinary_prior
        single = 1 / ALPHABET if r else (after[r][pair % 128] + weight / ALPHABET) / (sum(after[r]) + weight)
        p = (seen[r].get(pair, 0) + weight * single) / (before[r][pair // 128] + weight)
        return math.log(p if r else (1 - floor) * p + floor / ALPHABET)

    return [round(log_p(True, pair) - log_p(False, pair), 4) for pair in range(128 * 128)]


def ratio_of(s: Column, table_of_pairs: list[float]) -> Column:
    """Log-likelihood ratio of a string of ASCII characters."""
    ratios = F.split(F.lit(",".join(map(str, table_of_pairs))), ",").cast("array<double>")
    return F.aggregate(_pairs(s), F.lit(0.0), lambda total, pair: total + F.get(ratios, pair))


def _found(text: Column, pattern: str, group: int) -> Column:
    """Matches of a pattern in order: (gap before the match and the match in code points, measured group)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.when(F.size(whole) > 0, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.array().cast("array<int>"))
    return F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("size"))), value,
                      lambda a, v: F.struct(a["gap"].alias("gap"), a["size"].alias("size"), v.alias("value")))


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: row, doc_id) and (spans: row, kind number, kind, start, end, value) of base kinds and of Markov candidates.

    Positions are code points, end exclusive. Base matches that are too short are gone; they still use up their text.
    """
    kinds = [*((k, _FASTER.get(k, p), g, n) for k, p, g, n in BASE_KINDS), (MARKOV, CANDIDATE, 0, 0)]
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    found = source.select("id", *[_found(F.col("t"), pattern, group).alias(kind) for kind, pattern, group, _ in kinds])
    found = kept(found.withColumn("row", F.monotonically_increasing_id()), "secret-matches")
    each = [
        found.select("row", F.lit(i).alias("kind_no"), F.lit(kind).alias("kind"), F.lit(least).alias("least"), F.posexplode(kind).alias("at", "m"))
        for i, (kind, _, _, least) in enumerate(kinds)
    ]
    spans = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    upto = Window.partitionBy("row", "kind_no").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto))
    spans = spans.where(F.length("m.value") >= F.col("least"))
    return found.select("row", "id"), spans.select("row", "kind_no", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end", F.col("m.value").alias("value"))


def labelled_samples(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(sample, is_random): values that base patterns found, and identifiers of about `sample_docs` documents that have none.

    The documents are those with the lowest hashes of their ids; at most `sample_docs` values are expected as well.
    """
    n_docs, n_found = docs.count(), spans.where(F.col("kind") != MARKOV).count()

    def low(c: str, of: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, sample_docs / max(of, 1)))

    value = F.regexp_replace("value", "[^A-Za-z0-9+/_=-]", "")
    random = spans.where(F.col("kind") != MARKOV).where(low("row", n_found)).select(value.alias("sample"), F.lit(True).alias("is_random"))
    base = "|".join(f"({p})" for _, p, _, _ in BASE_KINDS[:2]) + "|[0-9a-f]{24,}"
    plain = F.regexp_replace(F.col(text), F.lit(base), F.lit(" "))
    ordinary = docs.where(low(doc_id, n_docs)).select(F.explode(F.regexp_extract_all(plain, F.lit(IDENTIFIER), F.lit(0))).alias("sample"), F.lit(False).alias("is_random"))
    return random.where(F.length("sample") >= 16).unionByName(ordinary)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: DataFrame | None = None, min_ratio: float = MIN_RATIO,
                 min_mean: float = MIN_MEAN, min_distinct: int = MIN_DISTINCT) -> DataFrame:
    """(doc_id, spans: array of (start, kind_no, kind, end)) for every row, spans by start, then kind.

    A candidate of 16 and more characters, at least `min_distinct` of them different, is a secret of kind `markov`
    when the log-likelihood ratio is at least `min_ratio`, and `min_mean` for each pair of characters (names stay
    below 0, random strings over 0.7), and it touches no base span. Models are fitted to
    `samples` (sample, is_random), by default those of `labelled_samples`. Null and empty texts have no spans;
    repeated rows are scanned each by itself. Texts stay where they are: only matches travel.
    """
    rows, spans = find_spans(docs, doc_id, text)
    spans = kept(spans, "secret-spans")
    ratios = fit_ratio(labelled_samples(docs, spans, doc_id, text) if samples is None else samples)
    is_base = F.col("kind") != MARKOV
    varied = F.size(F.array_distinct(F.split("value", ""))) >= min_distinct
    least = F.greatest(F.lit(min_ratio), (F.length("value") + 1) * min_mean)
    likely = spans.where(is_base | varied).where(is_base | (ratio_of(F.col("value"), ratios) >= least)).drop("value")
    place = Window.partitionBy("row").orderBy("start", "kind_no", "end")
    before = F.max(F.when(is_base, F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(is_base, F.col("start"))).over(place.rowsBetween(1, Window.unboundedFollowing))
    touching = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    told = likely.withColumn("touching", touching).where(is_base | ~F.col("touching"))
    per_row = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "kind", "end"))).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return rows.join(per_row, "row", "left").select(F.col("id").alias(doc_id), F.coalesce("spans", none).alias("spans"))


def op5_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != MARKOV)
    return found.select("doc_id", *[number(k) for k, _, _, _ in BASE_KINDS], sha_hex(told(base)).alias("base_sha256"), told(F.col("spans")).alias("spans"), number(MARKOV))
