"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.tables import bit_filter, components, groups, in_filter, kept, pieces, table
from gramloom.llm.words import mix, ngrams, whole, word_hashes

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
ROWS = 6
FILTER_BITS = 1 << 24
BLOCK_DOCS = 200
BLOCK_GRAMS = 500_000
_TILE = 4096


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of `rows` hashes each that let a pair at the threshold through with probability `recall`.

    A pair of similarity s agrees in a band with probability s^rows. At 0.8 and 6 rows, 23 bands find 99.9 % of
    the pairs on the threshold and practically all above 0.85, while pairs below 0.3 rarely meet.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def gram_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text; a text of fewer words is one gram, one without words has none."""
    words, offsets = word_hashes(column)
    grams = ngrams(words, n, 7)
    out = []
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        if hi - lo >= n:
            out.append(np.unique(grams[lo:hi - n + 1]))
        else:
            out.append(ngrams(words[lo:hi], int(hi - lo), 7) if hi > lo else np.zeros(0, dtype=np.uint64))
    return out


def _names(grams: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, which name it."""
    return tuple(np.add.reduceat(mix(grams + np.uint64(k)), begins) for k in (1, 2))


def _signatures(n: int, rows: int, bands: int):
    rng = np.random.default_rng(11)
    factors = rng.integers(1, 1 << 62, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64)

    def run(batches):
        for part in pieces(batches, 1):
            sets = gram_sets(part.column(1), n)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            if len(full):
                every = np.concatenate(sets)
                begins = (np.cumsum(sizes) - sizes)[full]
                one, two = _names(every, begins)
                keys = np.zeros((bands, len(full)), dtype=np.uint64)
                for k in range(rows * bands):
                    low = np.minimum.reduceat((every ^ shifts[k]) * factors[k], begins)
                    keys[k // rows] = mix(keys[k // rows] + low + np.uint64(k // rows + 1))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(full)), pa.array(sizes[full]), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.T.reshape(-1).view(np.int64)), bands).cast(pa.list_(pa.int64()))],
                    names=["id", "n_grams", "h1", "h2", "bands"])
            if len(full) < len(sizes):  # rows without a word have no name
                rest = part.column(0).take(pa.array(np.flatnonzero(sizes == 0)))
                yield pa.RecordBatch.from_arrays([rest, *[pa.nulls(len(rest), pa.int64())] * 3, pa.nulls(len(rest), pa.list_(pa.int64()))], names=["id", "n_grams", "h1", "h2", "bands"])

    return run


def _shared_keys(bitmap: np.ndarray):
    """The band keys that other sets may have as well."""

    def run(batches):
        for batch in batches:
            keys = batch.column(1).flatten()
            node = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
            hit = np.flatnonzero(in_filter(bitmap, keys.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), keys.take(pa.array(hit))], names=["node", "key"])

    return run


def _sets_of(n: int, bitmap: np.ndarray):
    """Sets of the texts whose id may be wanted, with their names."""

    def run(batches):
        for batch in batches:
            wanted = np.flatnonzero(in_filter(bitmap, batch.column(0).to_numpy()))
            for part in pieces([batch.take(pa.array(wanted))], 1):
                sets = [s for s in gram_sets(part.column(1), n) if len(s)]
                if sets:
                    sizes = np.array([len(s) for s in sets])
                    one, two = _names(np.concatenate(sets), np.cumsum(sizes) - sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["h1", "h2", "grams"])

    return run


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set with every other, through 0/1 matrices over the shared grams."""
    every = np.concatenate([*sets, *others])
    owner = np.repeat(np.arange(len(sets) + len(others)), [len(s) for s in (*sets, *others)])
    values, where, counts = np.unique(every, return_inverse=True, return_counts=True)
    common = counts[where] > 1  # a gram of one text is in no intersection
    rank = np.cumsum(counts > 1) - 1
    column, owner = rank[where[common]], owner[common]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(others)), dtype=np.float32)
    width = int((counts > 1).sum())
    for lo in range(0, width, _TILE):
        a, b = np.searchsorted(column, [lo, lo + _TILE])
        tile = np.zeros((len(sets) + len(others), min(_TILE, width - lo)), dtype=np.float32)
        tile[owner[a:b], column[a:b] - lo] = 1
        out += tile[:len(sets)] @ tile[len(sets):].T
    return out.round().astype(np.int64)


def _verify(threshold: float):
    """Links inside one block or between two: per text the number of linked texts and rows, and a tree of edges."""

    def links(group: pa.Table) -> pa.RecordBatch:
        node, weight, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
        sets = [np.frombuffer(g.as_py(), dtype=np.uint64) for g in group.column("grams")]
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        shared = overlaps([sets[k] for k in left], [sets[k] for k in right])
        sizes = np.array([len(s) for s in sets])
        union = sizes[left][:, None] + sizes[right][None, :] - shared
        linked = shared >= threshold * union - 1e-9
        if i == j:
            np.fill_diagonal(linked, False)
        texts, rows, root = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.arange(len(node))
        texts[left] += linked.sum(axis=1)
        rows[left] += linked @ weight[right]
        if i != j:
            texts[right] += linked.sum(axis=0)
            rows[right] += weight[left] @ linked

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(*np.nonzero(linked)):
            a, b = top(left[a]), top(right[b])
            if a != b:
                a, b = (a, b) if node[a] < node[b] else (b, a)
                root[b] = a
        tree = np.array([node[top(x)] for x in range(len(node))])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (node, texts, rows, tree)], names=["node", "texts", "rows", "root"])

    def run(batches):
        for group in groups(batches, 3):
            yield links(group)

    return run


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD,
                 recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links, n_text_links) for every row of `docs`.

    Two documents are linked when the Jaccard similarity of their sets of word n-grams is at least `threshold`.
    class_id is the smallest doc_id of the connected component of links, copy_id the smallest doc_id with the
    same set, n_links the number of other rows linked to this one, n_text_links that of other sets. A text of
    fewer than n words is one gram; null, empty and wordless texts, and rows with a null doc_id, are linked to
    nothing and are their own class. Repeated rows are copies of each other; rows of one id with different texts are
    rows by themselves.

    Equal sets are collapsed first, so copies never meet in pairs. Band keys are shuffled as (key, id) and give
    stars, of which connected components are taken; only the texts in components of two and more are read again.
    Inside a component, blocks of bounded size meet in matrix products and give counts and tree edges, no pairs:
    the work for N different texts that are near copies of each other is N^2 / 2 similarities, as the counts ask,
    spread over N^2 / (2 x 200^2) groups.
    """
    bands = bands_for(threshold, recall, rows)
    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("t"))
    signed = source.where("id is not null").mapInArrow(_signatures(n, rows, bands), "id bigint, n_grams bigint, h1 bigint, h2 bigint, bands array<bigint>")
    signed = kept(signed, "jaccard-sets")
    nodes = signed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("low_id"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    nodes = kept(nodes.withColumn("row", F.monotonically_increasing_id()), "jaccard-nodes")
    # a set is a node, named by its smallest id, or by its row in this table where ids have several sets
    by_id = nodes.groupBy("low_id").count().where("count > 1").isEmpty()
    nodes = nodes.withColumn("node", F.col("low_id" if by_id else "row")).drop("row")

    # stars: every member of a bucket to its smallest; buckets of one never leave the count
    buckets = nodes.select("node", F.explode("bands").alias("key")).groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("c"))
    buckets = kept(buckets.where("c > 1").select("key", "low"), "jaccard-buckets")
    shared = nodes.select("node", "bands").mapInArrow(_shared_keys(bit_filter(buckets, "key", FILTER_BITS)), "node bigint, key bigint")
    stars = shared.join(buckets, "key").select(F.col("node").alias("a"), F.col("low").alias("b"))
    near = kept(components(stars, "jaccard-candidates"), "jaccard-components")

    members = nodes.select("node", "copies", "n_grams", "h1", "h2", "low_id").join(near, "node")
    shape = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("n_blocks"))
    members = kept(members.join(shape, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("bigint")), "jaccard-members")
    bitmap = bit_filter(members, "low_id", FILTER_BITS)
    sets = source.where("id is not null").mapInArrow(_sets_of(n, bitmap), "h1 bigint, h2 bigint, grams binary")
    loaded = members.join(sets, ["h1", "h2"]).dropDuplicates(["node"])
    # a block meets every block of its component: pairs (i, j) with i <= j
    met = loaded.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks").cast("bigint") - 1)))
    met = met.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "block", "grams")
    met = met.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    checked = kept(met.mapInArrow(_verify(threshold), "node bigint, texts bigint, rows bigint, root bigint"), "jaccard-links")
    counts = checked.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))
    classes = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")), "jaccard-classes")
    if by_id:
        classes = classes.withColumnRenamed("comp", "class")
    else:  # of a class, the smallest id of its members
        lowest = classes.join(nodes.select("node", "low_id"), "node").groupBy("comp").agg(F.min("low_id").alias("class"))
        classes = classes.join(lowest, "comp").select("node", "class")
    linked = kept(
        nodes.select("h1", "h2", "node", "low_id", "copies").join(counts, "node", "left").join(classes, "node", "left")
        .where("copies > 1 or texts > 0")
        .select("h1", "h2", F.coalesce("class", "low_id").alias("class_id"), F.col("low_id").alias("copy_id"), (F.coalesce("rows", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("texts", F.lit(0)).alias("n_text_links")), "jaccard-linked")
    found = signed.select("id", "h1", "h2").join(linked, ["h1", "h2"], "left")
    none = F.lit(0).cast("bigint")
    told = found.select(F.col("id").alias(doc_id), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_id", "id").alias("copy_id"),
                        F.coalesce("n_links", none).cast("bigint").alias("n_links"), F.coalesce("n_text_links", none).cast("bigint").alias("n_text_links"))
    return told.unionByName(source.where("id is null").select(F.col("id").alias(doc_id), F.col("id").alias("class_id"), F.col("id").alias("copy_id"), none.alias("n_links"), none.alias("n_text_links")))


def op1_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) AS g
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
s AS (SELECT doc_id, list_sort(list(g)) AS gs FROM g GROUP BY 1),
c AS (SELECT doc_id, len(gs) AS n, min(doc_id) OVER p AS copy_id, count(*) OVER p AS copies FROM s WINDOW p AS (PARTITION BY gs)),
r AS (SELECT doc_id, n, copies FROM c WHERE doc_id = copy_id),
rg AS (SELECT doc_id, g FROM g WHERE doc_id IN (SELECT doc_id FROM r)),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM rg a JOIN rg b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x.a, x.b, rb.copies FROM x JOIN r ra ON ra.doc_id = x.a JOIN r rb ON rb.doc_id = x.b WHERE 5 * k >= 4 * (ra.n + rb.n - k)),
walk AS (SELECT doc_id AS a, doc_id AS b FROM r UNION SELECT walk.a, e.b FROM walk JOIN e ON e.a = walk.b),
k AS (SELECT a, min(b) AS class_id FROM walk GROUP BY 1),
l AS (SELECT a, count(*) AS n_texts, sum(copies) AS n_rows FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(c.copy_id, d.doc_id) AS copy_id,
  coalesce(n_rows + copies - 1, copies - 1, 0)::BIGINT AS n_links, coalesce(n_texts, 0)::BIGINT AS n_text_links
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k ON k.a = c.copy_id LEFT JOIN l ON l.a = c.copy_id
"""
