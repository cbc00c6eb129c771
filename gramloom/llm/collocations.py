"""Phrase collocations from sorted count streams.

Counts of frequent phrases are kept as two streams: in prefix order (by first word, second word, ...) and in suffix
order (by last word, last but one, ...). In the first a phrase follows all its prefixes, in the second all its
suffixes, so one walk over each, side by side in all partitions, gives left and right counts and the best extension of
every phrase without any look-up. A merge join puts the two walks together.

Phrases are counted in four readings of the texts. Hashes decide what is worth counting: a phrase is frequent only if
the shorter phrases inside it are. Filters of fixed size hold the hashes of frequent phrases; they let too much
through, never too little, and the counts themselves are taken on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.tables import bit_filter, in_filter, kept, pieces, table
from gramloom.llm.words import mix
from gramloom.session import checkpointed

UNDETERMINED = "und"
SLICE_BYTES = 2 << 20
FILTER_BITS = 1 << 27
HELD_HASHES = 1_000_000
BATCH_ROWS = 1 << 16
SALTS = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*map(ord, ".,;:!?"), 10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True


class Words:
    """The words of a slice: code of each, distinct words, languages, and how many words of the piece follow a word (itself included)."""

    def __init__(self, part: pa.RecordBatch):
        ended = pc.binary_join_element_wise(pc.fill_null(part.column(0), ""), "", "\n")
        begins = np.frombuffer(ended.buffers()[1], dtype=np.int32, count=len(ended) + 1).astype(np.int64)
        data = _LOWER[np.frombuffer(ended.buffers()[2], dtype=np.uint8, count=int(begins[-1]))]
        inside = ~_GAP[data]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        first, end = edges[0::2], edges[1::2]
        offsets = np.concatenate(([0], np.cumsum(end - first))).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))).dictionary_encode()
        self.names: pa.Array = coded.dictionary
        self.codes = coded.indices.to_numpy().astype(np.int64)
        langs = pc.fill_null(part.column(1), UNDETERMINED).dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        row = np.searchsorted(begins, first, side="right") - 1
        self.lang = langs.indices.to_numpy().astype(np.int64)[row]
        # words of one piece share the number of breaks before them; the mark after each text is one
        breaks = np.cumsum(_BREAK[data])[first] if len(first) else np.zeros(0, dtype=np.int64)
        last = np.searchsorted(breaks, breaks, side="right")
        self.left = last - np.arange(len(first))

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word together with its language."""
        names = np.array([xxhash.xxh3_64_intdigest(n) for n in self.names.to_pylist()], dtype=np.uint64)
        langs = np.array([xxhash.xxh3_64_intdigest(n, seed=1) for n in self.langs], dtype=np.uint64)
        return mix(names[self.codes] ^ langs[self.lang]) if len(self.codes) else np.zeros(0, dtype=np.uint64)


def _phrase(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each place on."""
    out = np.full(len(at), np.uint64(size))
    for j in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[at + j])
    return out


def _places(words: Words, hashes: np.ndarray, sizes: dict[int, np.ndarray], size: int) -> np.ndarray:
    """Places where `size` words of one piece begin whose parts of each size in `sizes` are all in its filter."""
    at = np.flatnonzero(words.left >= size)
    for part, bitmap in sizes.items():
        if part > size:
            continue
        some = np.flatnonzero(words.left >= part)
        ok = np.zeros(len(hashes) + size, dtype=bool)
        ok[some[in_filter(bitmap, _phrase(hashes, some, part).view(np.int64))]] = True
        for j in range(size - part + 1):
            at = at[ok[at + j]]
    return at


def _hash_counts(filters: dict[int, np.ndarray], sizes: range):
    """Hashes of phrases whose parts pass the filters, with counts; a task adds up what it holds at a time."""

    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        # a batch is held outside the heap of the executor as a whole
        for lo in range(0, len(keys), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo:lo + BATCH_ROWS].view(np.int64)), pa.array(n[lo:lo + BATCH_ROWS].astype(np.int64))], names=["hash", "n"])

    def run(batches):
        held, size_held = [], 0
        for part in pieces(batches, 0, SLICE_BYTES):
            words = Words(part)
            hashes = words.hashes()
            for size in sizes:
                held.append(_phrase(hashes, _places(words, hashes, filters, size), size))
                size_held += len(held[-1])
                if size_held > HELD_HASHES:
                    yield from told(held)
                    size_held = 0
        if size_held:
            yield from told(held)

    return run


def _ranks(key: np.ndarray, more: np.ndarray, n_more: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of pairs of whole numbers, and the place of each rank's first pair."""
    _, first, rank = np.unique(key * n_more + more, return_index=True, return_inverse=True)
    return rank.astype(np.int64), first


def _phrase_counts(filters: dict[int, np.ndarray], sizes: range):
    """Phrases as word lists with their language and counts in the slice; told apart by their words, not by hashes."""

    def run(batches):
        for part in pieces(batches, 0, SLICE_BYTES):
            words = Words(part)
            hashes = words.hashes() if filters else np.zeros(len(words.codes), dtype=np.uint64)
            for size in sizes:
                at = _places(words, hashes, filters, size)
                if not len(at):
                    continue
                rank = words.lang[at]
                for j in range(size):
                    rank, first = _ranks(rank, words.codes[at + j], len(words.names))
                n = np.bincount(rank)
                for lo in range(0, len(n), BATCH_ROWS):
                    chosen = at[first[lo:lo + BATCH_ROWS]]
                    codes = (chosen[:, None] + np.arange(size)).ravel()
                    flat = words.names.take(pa.array(words.codes[codes]))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(codes) + 1, size, dtype=np.int32)), flat)
                    langs = pa.array(words.langs).cast(pa.string()).take(pa.array(words.lang[chosen]))
                    yield pa.RecordBatch.from_arrays([langs, lists, pa.array(n[lo:lo + BATCH_ROWS].astype(np.int64))], names=["lang", "words", "n"])

    return run


def phrase_counts(docs: DataFrame, least: int, longest: int = 5, text: str = "text", lang: str = "lang", filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(totals: lang, total of words) and (counts: lang, words, f) of all phrases of 1 to `longest` words with f >= `least`.

    `filter_bits`, a power of two, should be some ten times the number of frequent phrases; smaller filters give the same counts with more shuffling.
    """
    source = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    schema = "lang string, words array<string>, n bigint"

    def phrases(filters: dict[int, np.ndarray], sizes: range) -> DataFrame:
        return source.mapInArrow(_phrase_counts(filters, sizes), schema).groupBy("lang", "words").agg(F.sum("n").alias("f"))

    def frequent(filters: dict[int, np.ndarray], sizes: range) -> np.ndarray:
        found = source.mapInArrow(_hash_counts(filters, sizes), "hash bigint, n bigint")
        return bit_filter(found.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "hash", filter_bits)

    words = kept(phrases({}, range(1, 2)), "words")
    totals = kept(words.groupBy("lang").agg(F.sum("f").alias("total")), "word-totals")
    ones = words.where(F.col("f") >= least)
    if longest < 2:
        return totals, ones
    filters = {1: bit_filter(_word_hashes(ones), "hash", filter_bits)}
    filters[2] = frequent(filters, range(2, 3))
    if longest > 2:
        longer = frequent(filters, range(3, longest + 1))
        filters |= {size: longer for size in range(3, longest + 1)}
    more = phrases(filters, range(2, longest + 1)).where(F.col("f") >= least)
    return totals, kept(ones.unionByName(more), "phrase-counts")


def _word_hashes(ones: DataFrame) -> DataFrame:
    """Hash of each single-word phrase as `_phrase` gives it."""

    def run(batches):
        for batch in batches:
            langs, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in names], dtype=np.uint64) ^ np.array([xxhash.xxh3_64_intdigest(x, seed=1) for x in langs], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_phrase(mix(h), np.arange(len(h)), 1).view(np.int64))], names=["hash"])

    return ones.select("lang", F.col("words")[0].alias("word")).mapInArrow(run, "hash bigint")


def _walk(rows: Iterator[tuple[str, list[str], int]], carried: dict[tuple, tuple[int, int]]):
    """(row, counts of its proper beginnings from the shortest on, best extension) for rows in prefix order.

    The chain of beginnings of the row at hand is all that is held. `carried` tells for beginnings that reach beyond
    the partition their count and best extension elsewhere.
    """
    chain: list[list] = []  # of [lang, words, f, beginnings, best extension]

    def close(upto: int):
        while len(chain) > upto:
            node = chain.pop()
            yield node[0], node[1], node[2], node[3], max(node[4], carried.get((node[0], *node[1]), (0, 0))[1])

    for lang, words, f in rows:
        same = 0
        while same < len(chain) and chain[same][0] == lang and len(chain[same][1]) < len(words) and chain[same][1] == words[:len(chain[same][1])]:
            same += 1
        yield from close(same)
        if chain and len(chain[-1][1]) == len(words) - 1:
            chain[-1][4] = max(chain[-1][4], f)
        before = chain[-1][3] + [chain[-1][2]] if chain else []
        # beginnings in earlier partitions
        known = len(before)
        if known < len(words) - 1:
            before = [carried[(lang, *words[:k])][0] for k in range(1, len(words) - known)] + before
        chain.append([lang, words, f, before, 0])
    yield from close(0)


def _rows(batches) -> Iterator[tuple[str, list[str], int]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())


def _openings(batches):
    """Proper beginnings of a partition's first row, with the best extension of each that the partition holds."""
    first, best = None, {}
    for lang, words, f in _rows(batches):
        if first is None:
            first = lang, words
            best = {k: 0 for k in range(1, len(words))}
        if lang != first[0]:
            continue
        k = len(words) - 1
        if k in best and words[:k] == first[1][:k]:
            best[k] = max(best[k], f)
    if best:
        yield pa.RecordBatch.from_arrays([pa.array([first[0]] * len(best), pa.string()), pa.array([first[1][:k] for k in best], pa.list_(pa.string())), pa.array(list(best.values()), pa.int64())],
                                         names=["lang", "words", "best"])


def stream(counts: DataFrame) -> DataFrame:
    """(lang, words, f, begins: counts of its proper beginnings, extension: highest count of a phrase of one word more that begins with it).

    `counts` (lang, words, f) hold the beginnings of all their phrases. They are range-sorted and written once, so that partitions stay
    what they are. Beginnings that lie in an earlier partition than their phrases, at most one row fewer than a phrase has words for each
    partition, are looked up first.
    """
    placed = checkpointed(counts.select("lang", "words", "f").orderBy("lang", "words"))
    open_ = kept(placed.mapInArrow(_openings, "lang string, words array<string>, best bigint").groupBy("lang", "words").agg(F.max("best").alias("best")), "openings")
    carried = {(r.lang, *r.words): (r.f, r.best) for r in placed.join(F.broadcast(open_), ["lang", "words"]).collect()}

    def run(batches):
        held = []

        def told():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64()))],
                                              names=["lang", "words", "f", "begins", "extension"])

        for row in _walk(_rows(batches), carried):
            held.append(row)
            if len(held) >= 10_000:
                yield told()
                held = []
        if held:
            yield told()

    return placed.mapInArrow(run, "lang string, words array<string>, f bigint, begins array<bigint>, extension bigint")


def _score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) in whole numbers of up to 38 digits."""
    def wide(c: Column) -> Column:
        return c.cast("decimal(18,0)")

    return F.call_function("div", wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)"), wide(l) * wide(r))


def phrase_scores(docs: DataFrame, least: int = 100, longest: int = 5, text: str = "text", lang: str = "lang", filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, words, a, l, r, n, score) of all candidates: phrases of 2 to `longest` words that occur `least` times or more in a language.

    Texts are lower-cased in A-Z and cut into pieces at `.,;:!?` and line ends, pieces into words at blanks and tabs. The cut with
    the lowest score counts, of equal ones the one after fewest words. Phrases that always stand inside one longer candidate are left out.
    Null texts have no words, a null language counts as `und`, repeated rows count as often as they stand there. Counts below 10^18.
    """
    totals, counts = phrase_counts(docs, least, longest, text, lang, filter_bits)
    ahead = stream(counts).where(F.size("words") > 1)
    turned = stream(counts.select("lang", F.reverse("words").alias("words"), "f")).where(F.size("words") > 1)
    turned = turned.select("lang", F.reverse("words").alias("words"), F.reverse("begins").alias("ends"), F.col("extension").alias("before"))
    both = ahead.hint("merge").join(turned, ["lang", "words"])
    told = both.where(F.greatest("extension", "before") < F.col("f")).join(F.broadcast(totals), "lang")
    cuts = F.transform("begins", lambda l, i: F.struct(_score(F.col("f"), F.col("total"), l, F.get("ends", i)).alias("score"), i.alias("cut"), l.alias("l"), F.get("ends", i).alias("r")))  # noqa: E741
    return told.select("lang", "words", "f", "total", F.array_min(cuts).alias("c")).select(
        "lang", "words", F.col("f").alias("a"), "c.l", "c.r", F.col("total").alias("n"), "c.score")


def top_phrases(scored: DataFrame, most: int) -> DataFrame:
    """The first `most` phrases of each language by score and count, then words; a language is ranked in parts first."""
    phrased = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = phrased.withColumn("_part_rank", F.row_number().over(part)).where(F.col("_part_rank") <= most).drop("_part_rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    """The first 2000 phrases of every language."""
    return top_phrases(phrase_scores(table(spark, sf_dir, "documents").select("text", "lang")), 2000)


SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)
), grams AS (
  SELECT lang, list_slice(w, i, i + m - 1) AS p, m FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4), (5)) AS s(m))
), f AS (
  SELECT lang, p, any_value(m) AS m, count(*) AS f FROM grams GROUP BY lang, p
), total AS (
  SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
), cand AS (
  SELECT * FROM f WHERE m > 1 AND f >= 100
), inside AS (
  SELECT lang, list_slice(p, 1, m - 1) AS p, f FROM cand UNION ALL SELECT lang, list_slice(p, 2, m) AS p, f FROM cand
), most AS (
  SELECT lang, p, max(f) AS f FROM inside GROUP BY lang, p
), left_over AS (
  SELECT c.* FROM cand c LEFT JOIN most USING (lang, p) WHERE most.f IS NULL OR most.f < c.f
), cuts AS (
  SELECT lang, p, m, f, unnest(range(1, m)) AS k FROM left_over
), scored AS (
  SELECT c.lang, c.p, c.f AS a, x.f AS l, y.f AS r, n, k,
         CAST((CAST(1000 AS HUGEINT) * c.f * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, k)
              JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, k + 1, c.m)
              JOIN total ON total.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
  FROM (SELECT *, array_to_string(p, ' ') AS phrase FROM best))
WHERE rank <= 2000"""
