"""Alignment of two tokenizers' tokens: groups between shared cuts, overlap links, and corpus counts of linked ids.

Tokens are sorted end offsets. An interval is cut at an offset near its middle at which tokens of both end, found by
bisection, and both halves are treated alike; an interval without one is a group. All intervals of one depth are cut in
the same step. Both tokenizers also end a token before a single space between two other characters: texts are cut there
first, and equal stretches of a slice of texts are aligned once.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.tables import kept, pieces, table

SPACE = "▁"
SLICE_BYTES = 4 << 20
JOINED_CHARS = 1 << 15
PAIR_BASE = 1 << 32
BROADCAST_PAIRS = 1 << 20
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself where it is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


def align(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray) -> np.ndarray:
    """Index of the first A token of every group, ascending.

    `first_a` are the first A tokens of the intervals to begin with, whose borders are ends of both. In every step each
    open interval is cut at the shared end nearest to its middle token; those that have none inside are groups.
    """
    at = np.searchsorted(ends_b, ends_a)
    shared = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a) if len(ends_b) else np.zeros(0, dtype=np.int64)
    lo, hi = first_a.astype(np.int64), np.append(first_a[1:], len(ends_a)).astype(np.int64)
    lo, hi = lo[hi > lo], hi[hi > lo]
    groups = []
    while len(lo):
        middle = (lo + hi - 1) // 2
        k = np.searchsorted(shared, middle)
        above = np.where(k < len(shared), shared[np.minimum(k, len(shared) - 1)], hi) if len(shared) else hi
        below = np.where(k > 0, shared[np.maximum(k, 1) - 1], -1) if len(shared) else np.full(len(lo), -1)
        up, down = above < hi - 1, below >= lo  # the last token of an interval ends at its border
        cut = np.where(up & (~down | (above - middle <= middle - below)), above, below)
        found = up | down
        groups.append(lo[~found])
        lo, cut, hi = lo[found], cut[found] + 1, hi[found]
        lo, hi = np.concatenate((lo, cut)), np.concatenate((cut, hi))
    return np.sort(np.concatenate(groups)) if groups else np.zeros(0, dtype=np.int64)


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of A and B tokens whose byte ranges overlap: one for each stretch between neighbouring ends of either."""
    ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
    ends = ends[np.diff(ends, prepend=-1) > 0]
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Aligned:
    """What texts come to: whether tokens give the bytes back, groups as bytes, numbers of tokens, groups and links, and linked id pairs."""

    def __init__(self, n: int):
        self.good = np.zeros(n, dtype=bool)
        self.shown: list[bytes] = [b""] * n
        self.counts = np.zeros((n, 4), dtype=np.int64)
        self.keys: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * n


class Pair:
    """Two tokenizers from files: byte-level BPE (A) and a sentencepiece model with byte fallback (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in n) if n and all(c in letters for c in n) else (n or "").encode() for n in names]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.width_a, self.width_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B for texts that begin with a space; B adds it itself."""
        a = self.a.encode_batch_fast(texts, add_special_tokens=False)
        return [(x.ids, y) for x, y in zip(a, self.b.encode([t[1:] for t in texts], num_threads=1))]

    def _joined(self, texts: list[str], apart: np.ndarray) -> list[list[int]]:
        """Places of texts that are tokenised as one: those that may be joined, up to a length."""
        alone = np.flatnonzero(apart)
        out = [[i] for i in alone.tolist()]
        free = np.flatnonzero(~apart)
        if len(free):
            block = np.cumsum([len(texts[i]) for i in free.tolist()]) // JOINED_CHARS
            out += [p.tolist() for p in np.split(free, np.flatnonzero(np.diff(block)) + 1)]
        return out

    def align_all(self, texts: list[str], apart: np.ndarray | None = None) -> Aligned:
        """Texts that begin with a space, each for itself; those not `apart` may stand next to each other for the tokenizers."""
        out = Aligned(len(texts))
        todo = self._joined(texts, np.ones(len(texts), dtype=bool) if apart is None else apart)
        while todo:
            whole = ["".join(texts[i] for i in places) for places in todo]
            again, good = [], []
            for places, text, (ids_a, ids_b) in zip(todo, whole, self.tokens(whole)):
                raw = text.encode()
                if b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw and b"".join(map(self.bytes_b.__getitem__, ids_b)) == raw:
                    good.append((places, ids_a, ids_b))
                elif len(places) > 1:
                    again += [[i] for i in places]
            self._align(texts, good, out)
            todo = again
        return out

    def _align(self, texts: list[str], good: list[tuple[list[int], list[int], list[int]]], out: Aligned) -> None:
        if not good:
            return
        places = [i for p, _, _ in good for i in p]
        ids_a, ids_b = (np.concatenate([np.asarray(g[k], dtype=np.int64) for g in good]) for k in (1, 2))
        ends_a, ends_b = np.cumsum(self.width_a[ids_a]), np.cumsum(self.width_b[ids_b])
        borders = np.cumsum([len(t) if t.isascii() else len(t.encode()) for t in map(texts.__getitem__, places)])
        starts = np.concatenate(([0], borders[:-1]))
        first_a, first_b = np.searchsorted(ends_a, starts, side="right"), np.searchsorted(ends_b, starts, side="right")
        assert (ends_a[np.append(first_a[1:], len(ends_a)) - 1] == borders).all() and (ends_b[np.append(first_b[1:], len(ends_b)) - 1] == borders).all()
        groups = align(ends_a, ends_b, first_a)
        groups_b = np.searchsorted(ends_b, np.concatenate(([0], ends_a[groups[1:] - 1])), side="right")
        link_a, link_b = links(ends_a, ends_b)
        codes = ids_a[link_a] * PAIR_BASE + ids_b[link_b]
        first_link = np.searchsorted(link_a, first_a)
        first_group = np.searchsorted(groups, first_a)
        names = self.names
        a, b = [names[i] for i in ids_a.tolist()], [names[i] for i in ids_b.tolist()]
        ga, gb = [*groups.tolist(), len(a)], [*groups_b.tolist(), len(b)]
        shown = [f"{a[x]}|{b[y]}" if x1 - x == 1 and y1 - y == 1 else f"{','.join(a[x:x1])}|{','.join(b[y:y1])}"
                 for x, x1, y, y1 in zip(ga[:-1], ga[1:], gb[:-1], gb[1:])]
        sizes = [np.diff(np.append(f, n)) for f, n in ((first_a, len(a)), (first_b, len(b)), (first_group, len(groups)), (first_link, len(codes)))]
        out.counts[places] = np.stack(sizes, axis=1)
        out.good[places] = True
        cuts, at = [*first_group.tolist(), len(shown)], [*first_link.tolist(), len(codes)]
        for n, i in enumerate(places):
            out.shown[i] = ";".join(shown[cuts[n]:cuts[n + 1]]).encode()
            out.keys[i] = codes[at[n]:at[n + 1]]


@functools.lru_cache(maxsize=1)
def load_pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _cut_after(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte `at` is white space for neither tokenizer."""
    last, lead = data[at], data[np.maximum(at - 1, 0)]
    return ~_WHITE[last] & ((last < 0x80) | ((lead >= 0xC3) & (lead <= 0xDF)))


def _cut_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins at byte `at` is white space for neither; U+0085, U+00A0 and some of three bytes may be."""
    return ~_WHITE[data[at]] & (data[at] < 0xE1) & (data[at] != 0xC2)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array that begins at its buffers' start."""
    begins = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1).astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8, count=int(begins[-1])), begins


def stretches(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(stretches of all texts with a space before each, index of each text's first stretch and the number of stretches).

    A stretch begins at the space before the text, and at a single space between two characters that are no white
    space; there both tokenizers end a token whatever surrounds it.
    """
    joined = pc.binary_join_element_wise(" ", pc.fill_null(column, ""), "")
    data, begins = _bytes(joined)
    spaces = np.flatnonzero(data[1:-1] == 32) + 1 if len(data) > 2 else np.zeros(0, dtype=np.int64)
    cuts = spaces[_cut_after(data, spaces - 1) & _cut_before(data, spaces + 1)]
    starts = np.union1d(cuts, begins[:-1])
    inside = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, begins[-1]).astype(np.int32)), joined.buffers()[2])
    return inside, np.searchsorted(starts, begins)


def _apart(names: pa.Array) -> np.ndarray:
    """Stretches that may not stand next to others: those that do not begin or end as cuts do."""
    data, begins = _bytes(names)
    lo, hi = begins[:-1], begins[1:]
    short = hi - lo < 2
    after = np.minimum(lo + 1, max(len(data) - 1, 0))
    return short | ~_cut_before(data, after) | ~_cut_after(data, hi - 1) if len(names) else short


def _aligned(path_a: str, path_b: str):
    def run(batches):
        pair = load_pair(path_a, path_b)
        for part in pieces(batches, 0, SLICE_BYTES):
            texts = part.column(0)
            found, first = stretches(texts)
            coded = found.dictionary_encode()
            told = pair.align_all(coded.dictionary.to_pylist(), _apart(coded.dictionary))
            place = coded.indices.to_numpy()
            empty = pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0).to_numpy(zero_copy_only=False)
            n = len(texts)
            owner = np.repeat(np.arange(n), np.diff(first))
            spoiled = np.zeros(n, dtype=bool)
            spoiled[owner[~told.good[place]]] = True  # a stretch does not give its bytes back: the whole text decides
            whole = np.flatnonzero(spoiled & ~empty)
            by_text = pair.align_all([" " + texts[int(i)].as_py() for i in whole])
            taken = ~(spoiled | empty)
            sums = np.concatenate((np.zeros((1, 4), dtype=np.int64), np.cumsum(told.counts[place], axis=0)))
            counts = (sums[first[1:]] - sums[first[:-1]]) * taken[:, None]
            counts[whole] = by_text.counts
            digests = [""] * n
            for i in np.flatnonzero(taken).tolist():
                digests[i] = hashlib.sha256(b";".join([told.shown[p] for p in place[first[i]:first[i + 1]].tolist()])).hexdigest()
            for j, i in enumerate(whole.tolist()):
                digests[i] = hashlib.sha256(by_text.shown[j]).hexdigest() if by_text.good[j] else ""
            used = taken[owner]
            # links of a stretch, times the number of its occurrences in the text
            both, often = np.unique(owner[used] * max(len(told.good), 1) + place[used], return_counts=True)
            pairs, times, sizes = _sparse_sum(told.keys, both // max(len(told.good), 1), both % max(len(told.good), 1), often, by_text.keys, whole, n)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], *[pa.array(counts[:, j]) for j in range(4)], pa.array(digests, pa.string()),
                 pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                names=[*part.schema.names[1:], "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def _sparse_sum(keys: Sequence[np.ndarray], owner: np.ndarray, which: np.ndarray, often: np.ndarray, more: Sequence[np.ndarray], more_owner: np.ndarray,
                n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, times, number of keys of each of `n` owners): the keys of `which` count `often` for `owner`, those in `more` once."""
    sizes = np.array([len(k) for k in keys], dtype=np.int64)
    flat = np.concatenate([*keys, *more]) if len(keys) + len(more) else np.zeros(0, dtype=np.int64)
    names, code = np.unique(flat, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    length = sizes[which]
    at = np.repeat(starts[which] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    tail = np.arange(int(sizes.sum()), len(flat))
    at = np.concatenate((at, tail))
    owners = np.concatenate((np.repeat(owner, length), np.repeat(more_owner, [len(k) for k in more]).astype(np.int64)))
    weight = np.concatenate((np.repeat(often, length), np.ones(len(tail), dtype=np.int64)))
    size = max(len(names), 1)
    joint = owners * size + code[at]
    order = np.argsort(joint, kind="stable")
    joint, weight = joint[order], weight[order]
    firsts = np.flatnonzero(np.diff(joint, prepend=-1))
    times = np.add.reduceat(weight, firsts) if len(firsts) else weight
    return names[joint[firsts] % size], times, np.bincount(joint[firsts] // size, minlength=n)


def _names(docs: DataFrame, carry: list[str] | None, text: str) -> list[str]:
    made = {"n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "n_best", "count_sum", "_row"}
    return [c for c in ([c for c in docs.columns if c != text] if carry is None else carry) if c not in made]


def align_tokens(docs: DataFrame, path_a: str, path_b: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns `carry` (all but the text by default) with n_a, n_b, n_groups, n_links, groups_sha256, pairs and times.

    `pairs` are the distinct linked id pairs of the text, as A's id times 2^32 plus B's, ascending; `times` says how
    often each is linked. Null and empty texts, and texts whose tokens do not give their bytes back, have no tokens:
    zeros, an empty digest and empty lists. Repeated rows are aligned each by itself; columns of the names that are
    added are replaced. Both paths are files that every executor has.
    """
    names = _names(docs, carry, text)
    free = "_text" + "_" * (1 + max(map(len, names), default=0))
    source = docs.select(F.col(f"`{text}`").alias(free), *[F.col(f"`{c}`") for c in names])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[1:])
    return source.mapInArrow(_aligned(path_a, path_b), fields + "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, is_best): in how many rows each id pair is linked, and whether no pair of its A id has more.

    Rows number at most the vocabulary of A times that of B; each task sends one row per pair it has seen.
    """
    counts = kept(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pair-docs")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
    marked = counts.join(most, F.shiftright("pair", 32) == F.col("a"))
    return kept(marked.select("pair", "docs", (F.col("docs") == F.col("most")).alias("is_best")), "pair-counts")


def link_support(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Adds n_best (links whose pair has the highest count of its A id) and count_sum (sum of counts over links).

    The table of pairs is broadcast, in slices of at most about `broadcast_pairs` rows by a hash of the pair: links are
    read once per slice and never shuffled by pair, so a pair that every text has is no hot key. What is shuffled are
    two sums per row and task.
    """
    rows = kept(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows)
    n_slices = max(1, -(-counts.count() // broadcast_pairs))
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("_row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("n"))
    sums = None
    for i in range(n_slices):
        part = counts if n_slices == 1 else counts.where(F.pmod(F.xxhash64("pair"), F.lit(n_slices)) == i)
        told = each.join(F.broadcast(part), "pair").groupBy("_row").agg(F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("n")).alias("count_sum"))
        sums = told if sums is None else sums.unionByName(told)
    if n_slices > 1:
        sums = sums.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("bigint")
    return rows.drop("pairs", "times").join(sums, "_row", "left").withColumns({"n_best": F.coalesce("n_best", none), "count_sum": F.coalesce("count_sum", none)}).drop("_row")


def model_files(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(a), public_tokenizers.path(b)


def op13_token_alignment(spark, sf_dir):
    """Groups, links and their corpus counts for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = link_support(align_tokens(docs, *model_files()))
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
