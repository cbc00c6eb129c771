"""Language identification with bit-sliced Bloom filters.

One table of bit masks holds the frequent character n-grams of all languages: bit l of a slot belongs to
language l. An n-gram sets its language's bit in a few slots; the AND of those slots gives, in one look-up, every
language that has the n-gram. Per language, the n-grams of a text that hit are counted, the hits expected by
chance from the fill of that language's bits are taken off, and the largest share decides.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm.tables import kept, pieces, table
from gramloom.llm.words import mix, ngrams

ORDERS = (3, 4)
MIN_SHARE = 2e-5
SLOTS = 1 << 21
FLOOR_ACCURACY = 100_000
TEXT_BYTES = 1 << 18
PROBES = 3
UNKNOWN = "und"
_HELD = 1 << 18  # distinct n-grams that a counting task holds at once


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _grams(column: pa.Array, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hash, text of each, whether each text has a letter): lower case, other characters as one space."""
    low = " \n ".join(t.lower().replace("\n", " ") for t in pc.fill_null(column, "").to_pylist())
    points = np.frombuffer(f" {low} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mark = points == 10  # between texts, each of which has a space of its own at both ends
    text, points = np.cumsum(mark)[~mark], points[~mark]
    points = np.where(_letters()[points], points, 0).astype(np.uint64)
    # one space between words and texts: n-grams begin or end with it, but never reach into the next text
    keep = np.flatnonzero((points != 0) | np.concatenate(([True], points[:-1] != 0)) | np.concatenate(([True], text[1:] != text[:-1])))
    points, text = points[keep], text[keep]
    has_letter = np.zeros(len(column), dtype=bool)
    has_letter[text[points != 0]] = True
    hashes, owners = [], []
    for n in orders:
        if len(points) >= n:
            own = np.flatnonzero((text[n - 1:] == text[:len(text) - n + 1]) & ((points[:len(text) - n + 1] != 0) | (points[1:len(text) - n + 2] != 0)))
            hashes.append(ngrams(points, n, 3)[own])
            owners.append(text[own])
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate([empty, *hashes]), np.concatenate([empty.astype(np.int64), *owners]), has_letter


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their summed counts."""
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _counts(languages: list[str], orders: tuple[int, ...]):
    """Counts of (language, n-gram), summed inside the task before they travel."""
    number = pa.array(languages)

    def run(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {i: [] for i in range(len(languages))}
        size = dict.fromkeys(held, 0)

        def flush(i):
            keys, n = _merged(held[i])
            held[i], size[i] = [], 0
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for part in pieces(batches, 1, TEXT_BYTES):
            of_text = pc.index_in(part.column(0), number).to_numpy(zero_copy_only=False)
            keys, owner, _ = _grams(part.column(1), orders)
            of_gram = of_text[owner]
            for i in np.unique(of_text):
                held[i].append(np.unique(keys[of_gram == i], return_counts=True))
                size[i] += len(held[i][-1][0])
                if size[i] > 2 * _HELD:
                    held[i] = [_merged(held[i])]
                    size[i] = len(held[i][0][0])
                    if size[i] > _HELD:
                        yield flush(i)
        for i in held:
            if held[i]:
                yield flush(i)

    return run


def _slots(grams: np.ndarray, probes: int, slots: int) -> np.ndarray:
    """The slots of each n-gram, one row for each probe."""
    step = mix(grams ^ np.uint64(0x5BD1E995)) | np.uint64(1)
    return np.stack([(grams + np.uint64(k) * step) & np.uint64(slots - 1) for k in range(probes)])


class LanguageFilters:
    """Masks in planes of 64 languages, and the chance hits of every language."""

    def __init__(self, languages: list[str], planes: np.ndarray, probes: int, orders: tuple[int, ...]):
        self.languages, self.probes, self.orders = languages, probes, orders
        fill = [np.count_nonzero(planes[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / planes.shape[1] for i in range(len(languages))]
        self.chance = np.array(fill) ** probes
        # few languages take few bits: a smaller table stays in the cache
        self.planes = planes.astype(np.uint8) if len(languages) <= 8 else planes

    def languages_of(self, grams: np.ndarray) -> list[np.ndarray]:
        """For every n-gram the mask of the languages that contain it (and few others), in planes of 64."""
        at = _slots(grams, self.probes, self.planes.shape[1])
        return [np.bitwise_and.reduce(plane[at], axis=0) for plane in self.planes]

    def shares(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(share of each text's n-grams that each language has, corrected for chance; whether it has a letter)."""
        grams, owner, has_letter = _grams(column, self.orders)
        total = np.bincount(owner, minlength=len(column))
        masks = self.languages_of(grams)
        if len(self.languages) <= 8:  # texts x masks, then the texts that each bit of the masks stands for
            by_mask = np.bincount(owner * 256 + masks[0], minlength=256 * len(column)).reshape(len(column), 256)
            bits = np.arange(256)[:, None] >> np.arange(len(self.languages)) & 1
            hits = (by_mask @ bits).T
        else:
            hits = np.stack([np.bincount(owner[masks[i // 64] >> np.uint64(i % 64) & np.uint64(1) == 1], minlength=len(column)) for i in range(len(self.languages))])
        chance = self.chance[:, None]
        out = np.where(chance < 1, (hits / np.maximum(total, 1) - chance) / np.maximum(1 - chance, 1e-12), 0)
        return np.clip(out, 0, 1), has_letter


def fit_language_filters(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", orders: tuple[int, ...] = ORDERS,
                         min_share: float = MIN_SHARE, slots: int = SLOTS, probes: int = PROBES, sample_docs: int | None = None) -> LanguageFilters:
    """Filters of every language's n-grams that make up at least `min_share` of its n-grams.

    All rows are counted; with `sample_docs` about so many of each language, those with the lowest hashes of `key`.
    Rows without language or text count for nothing. A language keeps at most 1 / min_share n-grams, whatever the
    size of the corpus, so what comes to the driver is bounded by languages / min_share and the filter by
    slots x 8 bytes for each 64 languages. `slots` is a power of two.
    """
    rows = labelled.select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(key).alias("h")).where("l is not null and t is not null")
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    languages = sorted(sizes)
    if sample_docs is not None and languages:
        below = F.create_map(*[F.lit(x) for i in languages for x in (i, int((1 << 30) * min(1.0, sample_docs / sizes[i])))])
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < below[F.col("l")])
    rows = rows.select("l", "t")
    planes = np.zeros((max(1, -(-len(languages) // 64)), slots), dtype=np.uint64)
    counts = rows.mapInArrow(_counts(languages, orders), "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = kept(counts, "language-ngrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * min_share)
    best = frequent.select("lang", "gram").toArrow()  # at most 1 / min_share rows for each language
    of, grams = best.column("lang").to_numpy(), best.column("gram").to_numpy().view(np.uint64)
    for i in range(len(languages)):
        np.bitwise_or.at(planes[i // 64], _slots(grams[of == i], probes, slots).reshape(-1), np.uint64(1 << (i % 64)))
    return LanguageFilters(languages, planes, probes, orders)


def _predictions(shared, names: list[str], text: int):
    def run(batches):
        model = shared.value
        for part in pieces(batches, text, TEXT_BYTES):
            share, has_letter = model.shares(part.column(text))
            if model.languages:
                best = share.argmax(axis=0)
                pred = np.where(has_letter, np.array(model.languages, dtype=object)[best], UNKNOWN)
                score = np.where(has_letter, share.max(axis=0), 0.0)
            else:
                pred, score = np.full(part.num_rows, UNKNOWN, dtype=object), np.zeros(part.num_rows)
            columns = [part.column(names.index(n)) for n in names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score)], names=[*(n for n in names if n != "_text"), "lang_pred", "score"])

    return run


def identify(docs: DataFrame, filters: LanguageFilters, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns `carry` (all by default) with lang_pred and score, the corrected share of n-grams of that language.

    Only the text is looked at. `und` with score 0 if the text is null or has no letter, or if no language was
    learned. Of equal shares the language first in the alphabet wins.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    source = docs.select(*carry, F.col(text).alias("_text"))
    fields = [f for f in source.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + (", " if fields else "") + "lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    return source.mapInArrow(_predictions(shared, source.columns, len(source.columns) - 1), schema)


def score_floors(scored: DataFrame, lang: str = "lang", text: str = "text", share: float = 0.01, size: str | None = None) -> DataFrame:
    """(lang_pred, size, floor): the score that all but `share` of a language's own rows of a length reach.

    `scored` are all rows of `identify`. `size` is `size_class` of the text, null for the floor of a language over all
    lengths. Every labelled row counts, but those identified as another language. Of fewer than 1 / share rows the
    lowest score is the floor. The rank of a floor is exact within 1 / FLOOR_ACCURACY of the rows. Where `scored` has no
    texts, `size` names the column of their size classes, null for null texts.
    """
    of = F.col(size) if size else F.when(F.col(text).isNotNull(), size_class(text))
    found = scored.where(F.col(lang) == F.col("lang_pred")).select("lang_pred", of.alias("size"), "score").where("size is not null")
    floors = found.rollup("lang_pred", "size").agg(F.percentile_approx("score", share, FLOOR_ACCURACY).alias("floor"))
    return floors.where("lang_pred is not null")


def size_class(text: str = "text") -> Column:
    """Length of a text in characters, as the power of two below it."""
    return F.floor(F.log2(F.greatest(F.length(text), F.lit(1)))).cast("int")


def is_held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    filters = fit_language_filters(docs.where(~is_held_out()))
    rows = docs.select("doc_id", "text", is_held_out().alias("held_out"))
    return identify(rows, filters, carry=["doc_id", "held_out"])
