"""Counts of character n-grams, made from the letters of many texts at a time.

Inside a task the letters of a slice of texts become small numbers and an n-gram a number in their base; one sort of the pairs
(n-gram, text) gives occurrences and texts of every n-gram. Only the distinct n-grams of a slice become strings and are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
LETTERS = 0x110000
MOST = 1 << 62


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[str]]:
    """Texts in slices of about `limit` bytes, without nulls; a longer text is a slice of its own."""
    for batch in batches:
        texts = batch.column(0).drop_null()
        bins = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1), len(texts)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi > lo:
                yield texts.slice(lo, hi - lo).to_pylist()


def _strings(grams: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    width = 1 + (grams >= 0x80) + (grams >= 0x800) + (grams >= 0x10000)
    offsets = np.concatenate(([0], np.cumsum(width.sum(axis=1)))).astype(np.int32)
    data = np.ascontiguousarray(grams, dtype="<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(grams), pa.py_buffer(offsets), pa.py_buffer(data))


def _counted(texts: list[str], lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order its distinct n-grams as rows of code points, their occurrences, and the number of texts with them."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").copy()
    letters[letters == ord(" ")] = ord("_")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    seen = np.zeros(LETTERS, dtype=bool)
    seen[letters] = True
    alphabet = np.flatnonzero(seen)
    code = np.zeros(LETTERS, dtype=np.int64)
    code[alphabet] = np.arange(len(alphabet))
    codes, doc = code[letters], np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))
    at, key, bound, plain = np.arange(len(letters)), np.zeros(len(letters), dtype=np.int64), 1, True
    for n in range(1, hi + 1):
        inside = left[at] >= n
        at, key = at[inside], key[inside]
        if not len(at):
            return
        if bound * len(alphabet) * len(texts) > MOST:  # too many letters for one number: the n-grams so far get numbers of their own
            names, key = np.unique(key, return_inverse=True)
            bound, plain = len(names), False
        key = key * len(alphabet) + codes[at + n - 1]
        bound *= len(alphabet)
        if n < lo:
            continue
        pairs = key * len(texts) + doc[at]
        order = None if plain else np.argsort(pairs, kind="stable")
        pairs = np.sort(pairs) if plain else pairs[order]
        in_text = np.flatnonzero(np.diff(pairs, prepend=-1))  # first of its text
        grams = pairs[in_text] // len(texts)
        first = np.flatnonzero(np.diff(grams, prepend=-1))
        begins = in_text[first]
        tf, df = np.diff(begins, append=len(pairs)), np.diff(first, append=len(grams))
        if plain:
            rest, found = grams[first], np.empty((len(first), n), dtype=np.uint32)
            for i in range(n - 1, -1, -1):
                rest, last = np.divmod(rest, len(alphabet))
                found[:, i] = alphabet[last]
        else:
            found = letters[at[order[begins]][:, None] + np.arange(n)]
        yield found, tf, df


def gram_counts(df: DataFrame, text: Column, lo: int, hi: int, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(token, tf, df) of all character n-grams of lo..hi letters over all rows of `df`; the space shows as '_'.

    The same as `vocab.term_counts` of `char_gram_range` where a row is a document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _slices(batches, slice_bytes):
            for grams, tf, n_docs in _counted(texts, lo, hi):
                yield pa.RecordBatch.from_arrays([_strings(grams), pa.array(tf, pa.int64()), pa.array(n_docs, pa.int64())], names=["token", "tf", "df"])

    counts = df.select(text.alias("_t")).mapInArrow(run, "token string, tf bigint, df bigint")
    return counts.groupBy("token").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
