"""Dictionary, truth, prefix and closure joins."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.session import BROADCAST_BYTES, checkpointed, is_small, measured, settled

# a dictionary is broadcast in at most so many slices; edges of a closure are broadcast in every round
SLICES = 8
STEP_BYTES = BROADCAST_BYTES // 8


def join_dictionary(tokens: DataFrame, dictionary: DataFrame, on: str = "token", limit: int = BROADCAST_BYTES,
                    share: int = 1000, salts: int = 64, slices: int = SLICES) -> DataFrame:
    """Inner join of long tokens with a dictionary of few rows per key.

    A dictionary of at most `limit` measured bytes is broadcast, one of up to `slices` times as many in that many slices: tokens are read
    once for each and stay where they lie, so that sums per document are still made in place. Of a larger one the rows of the keys that occur most are
    broadcast, about as many as `limit` allows and all keys that hold more than 1/share of all tokens (there are fewer than
    `share` of them); only tokens of rarer keys are shuffled. Where the rows of those keys are too many for that, all tokens are
    shuffled, and the keys above 1/share are spread over `salts` copies of their dictionary rows.
    """
    dictionary = settled(dictionary)
    size, n_rows = measured(dictionary)
    if size <= limit:
        return tokens.join(F.broadcast(dictionary), on)
    tokens = settled(tokens)
    if size <= limit * slices:
        n = -(-size // limit)
        part = F.pmod(F.xxhash64(on), F.lit(n))
        return reduce(DataFrame.unionByName, [tokens.join(F.broadcast(dictionary.where(part == i)), on) for i in range(n)])
    counts = checkpointed(tokens.groupBy(on).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).scalar()
    hot = F.col("_n") * share > total
    known = checkpointed(counts.join(dictionary.select(on), on, "left_semi"))
    n_keys = known.count()
    edge = known.agg(F.percentile_approx("_n", max(0.0, 1 - limit * n_rows / size / max(n_keys, 1)))).scalar()
    frequent = checkpointed(known.where(hot | (F.col("_n") > edge)).select(on))
    if measured(frequent)[0] <= BROADCAST_BYTES:
        common = settled(dictionary.join(F.broadcast(frequent), on, "left_semi"))
        if is_small(common, 2 * max(limit, BROADCAST_BYTES)):
            rare = [df.join(F.broadcast(frequent), on, "left_anti") for df in (tokens, dictionary)]
            return tokens.join(F.broadcast(common), on).unionByName(rare[0].join(rare[1], on))
    hot = F.broadcast(counts.where(hot).select(on, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*tokens.columns), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = tokens.join(hot, on, "left").withColumn("_s", salt).drop("_hot")
    right = dictionary.join(hot, on, "left").withColumn("_s", F.explode(copies)).drop("_hot")
    return left.join(right, [on, "_s"]).drop("_s")


def with_truth(df: DataFrame, truth: DataFrame, key: str, how: str = "left") -> DataFrame:
    return df.join(truth, key, how)


def to_clusters(tokens: DataFrame, clusters: DataFrame) -> DataFrame:
    """Tokens with their cluster; unknown words vanish."""
    return join_dictionary(tokens, clusters.select(F.col("word").alias("token"), "cluster"))


def to_vectors(tokens: DataFrame, vectors: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Tokens with their vector `vec`; with a vocabulary only its words count."""
    known = vectors.join(vocab.select("token"), "token", "left_semi") if vocab is not None else vectors
    return join_dictionary(tokens, known.select("token", "vec"), slices=2 * SLICES)


def vocab_matrix(vocab: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """One row per vocabulary entry, ids shifted by one, zeros where no vector is known."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    joined = vocab.select("token", "id").join(vectors.select("token", "vec"), "token", "left")
    return joined.select((F.col("id") + 1).alias("row"), "token", F.coalesce(F.col("vec").cast("array<double>"), zeros).alias("vec"))


def categorize_by_url(df: DataFrame, categories: DataFrame, key: str = "page_id") -> DataFrame:
    """Category of the first prefix, in list order, that a URL begins with; null for none.

    Every URL is cut at each prefix length that occurs, which turns the prefix test into an equi join.
    """
    lengths = categories.agg(F.collect_set(F.length("prefix"))).scalar()
    cut = df.select(key, "url").withColumn("_l", lengths)
    cut = cut.select(key, F.explode(F.transform(
        F.filter("_l", lambda n: n <= F.length("url")), lambda n: F.substring(F.col("url"), F.lit(1), n))).alias("prefix"))
    first = categories.groupBy("prefix").agg(F.min(F.struct("ord", "site", "cat")).alias("_c"))
    best = join_dictionary(cut, first, "prefix").groupBy(key).agg(F.min("_c").alias("_c"))
    return df.join(best, key, "left").select(*df.columns, F.col("_c.site").alias("site"), F.col("_c.cat").alias("cat"))


# English names of the news categories.
ENGLISH_CATEGORIES = {
    "传媒": "media", "体育": "sports", "健康": "health", "公益": "general", "军事": "military", "国内": "domestic", "国际": "international", "女人": "woman",
    "女性": "woman", "娱乐": "entertainment", "媒体": "media", "房产": "real estate", "招聘": "jobs", "教育": "education", "文化": "culture", "旅游": "travel",
    "时尚": "fashion", "校园": "campus", "汽车": "auto", "社会": "society", "科技": "technology", "财经": "finance", "IT": "technology",
}


def english_category(cat: Column) -> Column:
    """English name of a category; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ENGLISH_CATEGORIES.items() for x in pair]), cat)


def attach_texts(index: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of an index with the text of the file they name."""
    return index.join(texts, "filename")


def align(x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    """Parallel sequences joined by key, never by position."""
    return x.join(y, key)


def skip_existing(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def code_map(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (code, term) pairs by code and by term, each with the number of partners."""
    p = pairs.select("code", "term").distinct()
    by_code = p.join(p.groupBy("code").agg(F.count("*").alias("n_terms")), "code")
    by_term = p.join(p.groupBy("term").agg(F.count("*").alias("n_codes")), "term")
    return by_code, by_term


def name_codes(df: DataFrame, codes_col: str, codes: DataFrame, key: str) -> DataFrame:
    """One row per code of a document, with its term."""
    long = df.select(key, F.explode(codes_col).alias("code"))
    return join_dictionary(long, codes.select("code", "term"), "code")


def stack_features(blocks: list[tuple[DataFrame, int | Column]], key: str = "doc_id") -> DataFrame:
    """Feature blocks (key, feature, value) side by side: ids are shifted by the widths of the blocks before.

    A block comes with its width, the size of its vocabulary or the number of its clusters, so that a feature has
    the same id in any set of rows.
    """
    shifted, offset = [], F.lit(0).cast("bigint")
    for block, width in blocks:
        shifted.append(block.withColumn("_o", offset).select(key, (F.col("feature") + F.col("_o")).alias("feature"),
                                                             F.col("value").cast("double").alias("value")))
        offset = offset + (width if isinstance(width, Column) else F.lit(width))
    return reduce(DataFrame.unionByName, shifted)


def template_closure(uses: DataFrame, redirects: DataFrame, max_depth: int = 30, seeds: DataFrame | None = None) -> DataFrame:
    """All templates that are reached from a template: (src, dst, depth) with the least depth.

    `uses` holds (src, dst) edges between templates, `redirects` (name, target). Redirects are followed first, then
    edges are joined until no new pair appears. With `seeds` (template) only those templates are expanded. A warning
    tells when templates nest deeper than `max_depth`.
    """
    direct = redirects.select(F.col("name").alias("dst"), "target")
    edges = settled(uses.join(direct, "dst", "left").select("src", F.coalesce("target", "dst").alias("dst")).distinct())
    start = edges if seeds is None else edges.join(seeds.select(F.col("template").alias("src")).distinct(), "src", "left_semi")
    seen = start.withColumn("depth", F.lit(1))
    frontier = settled(start.select("src", "dst"))
    step = settled(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")))
    # every round broadcasts the edges anew, so all rounds together stay within a few times the limit
    small = is_small(step, STEP_BYTES)

    def one_step(pairs: DataFrame) -> DataFrame:
        # base templates that most others reach are hot on this side; beyond a broadcast the join spreads them
        joined = pairs.join(F.broadcast(step), "dst") if small else join_dictionary(pairs, step, "dst", limit=0)
        return joined.select("src", F.col("next").alias("dst")).distinct().join(seen, ["src", "dst"], "left_anti")

    for depth in range(2, max_depth + 1):
        frontier = settled(one_step(frontier))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    if not one_step(frontier).isEmpty():
        warnings.warn(f"templates nest deeper than {max_depth}; the closure is cut there", stacklevel=2)
    return seen


def resolved_templates(page_uses: DataFrame, redirects: DataFrame) -> DataFrame:
    """(page_id, template) with redirects followed."""
    direct = redirects.select(F.col("name").alias("template"), "target")
    return page_uses.join(direct, "template", "left").select("page_id", F.coalesce("target", "template").alias("template"))


def page_templates(page_uses: DataFrame, closure: DataFrame, redirects: DataFrame) -> DataFrame:
    """Distinct templates that each page expands to, directly or through other templates.

    A template that a third of all pages use is hot on the page side; the join spreads it.
    """
    resolved = resolved_templates(page_uses, redirects)
    reached = closure.select(F.col("src").alias("template"), "dst")
    inner = join_dictionary(resolved.distinct(), reached, "template").select("page_id", F.col("dst").alias("template"))
    return resolved.unionByName(inner).distinct()


def cluster_pairs(clusters: DataFrame) -> DataFrame:
    """Every unordered pair i < j of the dense cluster indices 0..K-1: (i, j)."""
    size = clusters.agg(F.count("*")).scalar()
    tail = clusters.withColumn("_k", size).where(F.col("idx") < F.col("_k") - 1)
    return tail.select(F.col("idx").alias("i"), F.explode(F.sequence(F.col("idx") + 1, F.col("_k") - 1)).alias("j"))
