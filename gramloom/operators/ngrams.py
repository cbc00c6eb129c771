"""Counts of the most frequent word n-grams, without counting all the others by name.

Almost all n-grams of a corpus are rare, and each of them would be written and shuffled as a string. So their hashes are
counted first, in an array of fixed size per task; arrays are added up. A count there is never below the count of an
n-gram that falls on it. Only n-grams whose place reaches a floor are then counted as strings, and the floor is lowered until
enough of these counts reach it: those left out are below it for certain, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.functions.tokens import word_ngrams
from gramloom.operators.vocab import term_counts
from gramloom.session import checkpointed, settled

PLACE_BITS = 25
BLOCK_BITS = 16
ROOM = 3  # places at the first floor, as a multiple of the n-grams asked for
STEPS = 16  # steps of the histogram for each doubling
_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _grams(hashes: pa.ListArray, lo: int, hi: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order its length, the positions where its n-grams begin among all words of a batch, and their places."""
    offsets = hashes.offsets.to_numpy()
    words = hashes.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].view(np.uint64)
    ends = np.repeat(offsets[1:] - offsets[0], np.diff(offsets))
    at = np.arange(len(words))
    found = np.zeros(len(words), dtype=np.uint64)
    for n in range(1, hi + 1):
        inside = at + n <= ends[at]
        at = at[inside]
        found = (found[inside] ^ words[at + n - 1]) * _MIX
        found ^= found >> np.uint64(29)
        if n >= lo:
            yield n, at, ((found * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def _step(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1).astype(np.float64)) * STEPS).astype(np.int64)


def place_counts(df: DataFrame, words: str, lo: int, hi: int, bits: int = PLACE_BITS) -> DataFrame:
    """(block, counts, steps): occurrences of n-grams at each of 2^bits places, by blocks of places, and a histogram of them by size."""
    block = min(bits, BLOCK_BITS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for _, _, places in _grams(batch.column(0), lo, hi, bits):
                np.add.at(counts, places, np.uint32(1))
        parts = counts.reshape(-1, 1 << block)
        for i in np.flatnonzero(parts.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "counts": pa.array([parts[i].tobytes()], pa.binary())})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << block, dtype=np.int64)
        for part in frame["counts"]:
            total += np.frombuffer(part, dtype=np.uint32)
        steps = np.bincount(_step(total[total > 0]), minlength=64 * STEPS)
        return pd.DataFrame({"block": frame["block"].iloc[:1].to_numpy(), "counts": [total.tobytes()], "steps": [steps.tobytes()]})

    hashes = df.select(F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>")).alias("h"))
    return settled(hashes.mapInArrow(local, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary, steps binary"))


def _first_floor(places: DataFrame, n: int) -> int:
    """A count that some ROOM * n places reach; 1 if there are fewer."""
    steps = sum((np.frombuffer(r["steps"], dtype=np.int64) for r in places.select("steps").collect()), np.zeros(64 * STEPS, dtype=np.int64))
    above = np.flatnonzero(np.cumsum(steps[::-1])[::-1] >= ROOM * n)
    return max(1, int(2 ** (above[-1] / STEPS))) if len(above) else 1


def _kept(places: DataFrame, floor: int, lo: int, hi: int, bits: int) -> Callable[[Column], Column]:
    """From the hashes of a document's words to 8 * position + order of each n-gram whose place has a count of at least `floor`."""
    def reached(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"block": frame["block"], "bits": [np.packbits(np.frombuffer(c, dtype=np.int64) >= floor).tobytes() for c in frame["counts"]]})

    size = 1 << min(bits, BLOCK_BITS)
    bitmap = np.zeros(1 << bits, dtype=bool)
    for r in places.select("block", "counts").mapInPandas(reached, "block int, bits binary").collect():
        bitmap[r["block"] * size:(r["block"] + 1) * size] = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8))[:size]
    shared = places.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    @F.arrow_udf("array<int>")
    def keep(hashes: pa.Array) -> pa.Array:
        flags, offsets = shared.value, hashes.offsets.to_numpy()
        found = []
        for n, at, places_ in _grams(hashes, lo, hi, bits):
            there = (flags[places_ >> 3] >> (7 - (places_ & 7)).astype(np.uint8)) & 1
            found.append(at[there == 1] * 8 + n)
        codes = np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        begins = offsets - offsets[0]
        cuts = np.searchsorted(codes, begins * 8)
        codes = codes - np.repeat(begins[:-1] * 8, np.diff(cuts))
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(codes, pa.int32()))

    return keep


def frequent_ngrams(df: DataFrame, key: str, words: Column, lo: int, hi: int, n: int, bits: int = PLACE_BITS) -> DataFrame:
    """(token, tf, df) of all word n-grams of lo..hi words that occur at least as often as the n-th most frequent one, and some more.

    Words hold no space; of a corpus with fewer than n different n-grams all are returned. Orders go up to 7.
    """
    base = df.select(key, words.alias("_base"))
    places = place_counts(base, "_base", lo, hi, bits)
    floor = _first_floor(places, n)
    while floor > 1:
        keep = _kept(places, floor, lo, hi, bits)
        hashed = base.select(key, "_base", F.coalesce(F.transform("_base", lambda w: F.xxhash64(w)), F.array().cast("array<bigint>")).alias("_h"))
        placed = hashed.select(key, "_base", keep("_h").alias("_k"))
        grams = F.transform("_k", lambda k: F.array_join(F.slice("_base", F.shiftright(k, 3) + 1, F.pmod(k, F.lit(8))), " "))
        counts = checkpointed(term_counts(placed, key, grams).where(F.col("tf") >= floor))
        if counts.count() >= n:
            return counts
        floor //= 2
    return term_counts(base, key, word_ngrams("_base", lo, hi))
