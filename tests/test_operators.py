"""Operators against brute force, with hot keys, deep nesting and large dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramloom.functions import wiki as wf
from gramloom.operators import clusters as cl
from gramloom.operators import evaluation as ev
from gramloom.operators import experiments as ex
from gramloom.operators import features as ft
from gramloom.operators import filters, joins, models, order, sampling, textops, vocab, wiki

RNG = random.Random(5)


def test_global_rank_and_running_sum_with_ties(spark):
    data = [(i, RNG.choice([1, 1, 1, 2, 3]), i % 7) for i in range(5000)]
    df = spark.createDataFrame(data, "id int, v int, w int").repartition(13)
    got = {r["id"]: r["rank"] for r in order.global_rank(df, [F.desc("v"), F.asc("id")]).collect()}
    want = {row[0]: n + 1 for n, row in enumerate(sorted(data, key=lambda x: (-x[1], x[0])))}
    assert got == want
    run = {r["id"]: r["s"] for r in order.running_sum(df, "w", [F.col("id")], "s").collect()}
    total = 0
    for i, _, w in data:
        total += w
        assert run[i] == total


def test_contiguous_folds_cover_all(spark):
    folds = order.contiguous_folds(spark.range(103), 10, [F.col("id")]).orderBy("id").collect()
    got = [r["fold"] for r in folds]
    assert got == sorted(got) and Counter(got).keys() == set(range(10)) and max(Counter(got).values()) - min(Counter(got).values()) <= 1


def test_slices_and_batches(spark):
    assert sorted(r["id"] for r in order.slice_rows(spark.range(100).repartition(5), 10, 13, [F.col("id")]).collect()) == [10, 11, 12]
    batches = order.epoch_batches(spark.range(10), "id", 4, 2, seed=1).collect()
    sizes = Counter((r["epoch"], r["batch"]) for r in batches)
    assert sizes == {(e, b): n for e in (0, 1) for b, n in ((0, 4), (1, 4), (2, 2))}
    plain = order.epoch_batches(spark.range(6), "id", 2, 1, seed=0, shuffle=False).orderBy("id").collect()
    assert [r["batch"] for r in plain] == [0, 0, 1, 1, 2, 2]


def test_top_n_of_a_hot_group(spark):
    data = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(data, "g string, v int").repartition(9)
    top = order.top_n_per_group(df, ["g"], [F.desc("v")], 3, "v")
    assert sorted((r["g"], r["v"]) for r in top.collect()) == [("cold", 2), ("cold", 3), ("cold", 4), ("hot", 2997), ("hot", 2998), ("hot", 2999)]


@pytest.mark.parametrize("quota", [1, 7, 500, 2000, 5000])
def test_cap_per_class_is_exact(spark, quota):
    df = spark.range(3000).withColumn("c", F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 10).cast("string")))
    got = sampling.cap_per_class(df, "c", quota, "id", seed=2)
    sizes = {r["c"]: r["n"] for r in sampling.class_counts(got, "c").collect()}
    want = {r["c"]: min(quota, r["n"]) for r in sampling.class_counts(df, "c").collect()}
    assert sizes == want and got.distinct().count() == sum(want.values())


def test_stratified_split_and_sample(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") < 700, "a").otherwise("b"))
    split = sampling.stratified_split(df, "c", 100, "id")
    assert {(r["c"], r["n"]) for r in sampling.class_counts(split.where("is_test"), "c").collect()} == {("a", 70), ("b", 30)}
    assert split.count() == 1000
    assert sampling.sample_rows(df, 50, "id").distinct().count() == 50
    drawn = sampling.sample_rows(df, 3000, "id", replace=True)
    assert drawn.count() == 3000 and drawn.select("id").distinct().count() > 900
    assert 740 < sampling.random_holdout(df, 0.8, "id", 3).where("is_train").count() < 860


def test_dictionary_join_beyond_broadcast(spark):
    words = ["hot"] * 4000 + [f"w{i % 400}" for i in range(4000)]
    tokens = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id int, token string")
    dictionary = spark.createDataFrame([("hot", 1)] + [(f"w{i}", i) for i in range(0, 600, 2)], "token string, v int")
    got = joins.join_dictionary(tokens, dictionary, limit=10, share=50)
    want = joins.join_dictionary(tokens, dictionary)
    key = lambda df: sorted((r["doc_id"], r["token"], r["v"]) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 4000 + 2000


def test_term_counts_brute_force(spark):
    docs = [(i, [RNG.choice("abcdefgh") for _ in range(RNG.randint(0, 30))]) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id int, t array<string>")
    tf, dfreq = Counter(), Counter()
    for _, toks in docs:
        tf.update(toks)
        dfreq.update(set(toks))
    got = {r["token"]: (r["tf"], r["df"]) for r in vocab.term_counts(df, "doc_id", F.col("t")).collect()}
    assert got == {w: (tf[w], dfreq[w]) for w in tf}
    stats = vocab.term_stats(df, "doc_id", F.col("t"), min_count=1, totals=True).where("token = '###TOTAL###'").first()
    assert (stats["tf"], stats["df"]) == (sum(tf.values()), 200)


def test_gram_totals(spark, sf):
    from gramloom.functions.tokens import char_gram_range
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.select(F.sum(F.size(char_gram_range("text", 3, 5)))).first()[0]
    want = docs.select(F.sum(sum(F.greatest(F.length("text") - k + 1, F.lit(0)) for k in (3, 4, 5)))).first()[0]
    assert n == want


def test_merge_losses_brute_force(spark):
    docs = [(i, [RNG.choice("abcdexyz") for _ in range(60)]) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id int, t array<string>")
    words, pairs = vocab.term_counts(df, "doc_id", F.col("t")), cl.adjacent_pairs(df, "doc_id", F.col("t"))
    assign = spark.createDataFrame([(w, i + 1) for i, w in enumerate("abcde")], "token string, cluster int")
    uni, bi = cl.cluster_distributions(words, pairs, assign)
    ids = {w: i + 1 for i, w in enumerate("abcde")}
    c1, c2 = Counter(), Counter()
    for _, toks in docs:
        c1.update(ids.get(t) for t in toks)
        c2.update((ids.get(a), ids.get(b)) for a, b in zip(toks, toks[1:]))
    n1, n2 = sum(c1.values()), sum(c2.values())
    p, q = (lambda c: c1[c] / n1), (lambda a, b: c2[(a, b)] / n2)
    f = lambda x, y: x * math.log(x / y) if x > 0 else 0.0
    w = lambda a, b: f(q(a, b), p(a) * p(b)) + (f(q(b, a), p(a) * p(b)) if a != b else 0.0)
    want = {}
    for a in range(1, 6):
        for b in range(a + 1, 6):
            pc = p(a) + p(b)
            want[(a, b)] = sum(f(q(a, d) + q(b, d), pc * p(d)) + f(q(d, a) + q(d, b), pc * p(d)) - w(a, d) - w(b, d) for d in range(1, 6))
    got = {(r["c1"], r["c2"]): r["loss"] for r in cl.merge_losses(uni, bi).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    best = cl.best_merge(cl.merge_losses(uni, bi)).first()
    assert (best["c1"], best["c2"]) == max(want, key=want.get)
    for block in (2, 3):
        assert {(r["c1"], r["c2"]): round(r["loss"], 9) for r in cl.merge_losses(uni, bi, block).collect()} == {k: round(v, 9) for k, v in got.items()}


def test_f_scores(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((40, 3)) * (rng.random((40, 3)) > 0.4), rng.random(40) > 0.5
    feats = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(3) if x[i, j]], "id int, feature int, value double")
    labels = spark.createDataFrame([(i, bool(y[i])) for i in range(40)], "id int, is_pos boolean")
    pos, neg = x[y], x[~y]
    sums = ((pos.sum(0) - x.sum(0)) ** 2 + (neg.sum(0) - x.sum(0)) ** 2) / (
        ((pos - pos.sum(0)) ** 2).sum(0) / len(pos) + ((neg - neg.sum(0)) ** 2).sum(0) / len(neg))
    means = ((pos.mean(0) - x.mean(0)) ** 2 + (neg.mean(0) - x.mean(0)) ** 2) / (pos.var(0, ddof=1) + neg.var(0, ddof=1))
    for variant, want in (("sum", sums), ("mean", means)):
        got = {r["feature"]: r["score"] for r in ft.feature_f_score(feats, labels, "id", variant).collect()}
        assert np.allclose([got[j] for j in range(3)], want)


def test_embeddings_and_gate(spark):
    tf = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "zz", 9), (2, "c", 1)], "doc_id int, token string, tf int")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [0.0, 1e-7])], "token string, vec array<double>")
    get = lambda how, v=None: {r["doc_id"]: r["vec"] for r in ft.embed_documents(tf, vec, how, v).collect()}
    assert get("sum") == {1: [2.0, 2.0], 2: [0.0, 1e-7]}
    assert np.allclose(get("mean")[1], [2 / 3, 2 / 3])
    assert np.allclose(get("unit")[1], [2 ** -0.5] * 2) and get("unit")[2] == [0.0, 1e-7]
    assert get("sum", spark.createDataFrame([("a",)], "token string")) == {1: [2.0, 0.0]}


def test_analogies_in_many_blocks(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(60, 8))
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    vecs = spark.createDataFrame([(f"w{i}", i, [float(v) for v in e[i]]) for i in range(60)], "token string, id int, vec array<double>")
    qs = [(str(i % 2), f"w{i}", f"w{i + 1}", f"w{i + 2}", f"w{i + 3}") for i in range(0, 55)] + [("0", "nope", "w1", "w2", "w3")]
    questions = spark.createDataFrame(qs, "section string, a string, b string, c string, expected string")
    want = defaultdict(int)
    for i in range(55):
        sims = u @ (u[i + 1] - u[i] + u[i + 2])
        sims[[i, i + 1, i + 2]] = -np.inf
        want[str(i % 2)] += int(sims.argmax() == i + 3)
    got = {r["section"]: (r["n"], r["correct"]) for r in ev.analogy_accuracy(vecs, questions, cutoff=60, block=7).collect()}
    assert got == {"0": (28, want["0"]), "1": (27, want["1"]), "total": (55, want["0"] + want["1"])}


def test_nested_regions_of_any_depth(spark):
    rows = [(d, "a" + "{{x|" * d + "y" + "}}" * d + "b") for d in (0, 1, 4, 5, 23)] + [(99, "p {{ open {{in}} q"), (98, "r }} s")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r["id"]: r["t"] for r in wiki.drop_nested_pages(df, "t", r"\{\{", r"\}\}").collect()}
    assert all(got[d] == ("ab" if d else "ayb") for d in (0, 1, 4, 5, 23))
    assert got[99] == "p  open  q" and got[98] == "r  s"


def test_clean_page(spark):
    text = ("<!-- c -->{{Box\n|a={{b}}}}'''Bold''' and ''it'' [[Paris|the city]]s, [[dog]]s [[File:a.png|x [[in]] y]] [http://a.b/c see] "
            "<ref name=\"x\">gone</ref>kept<ref name=y /> <math>1</math>,<math>2</math> &amp; ( a ) <br/>x\n{| t\n{| u |}\n|}end __TOC__.....")
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = wiki.clean_pages(df, "t").first()["clean"]
    assert got == 'Bold and "it" the citys, dogs see kept formula_1,formula_2 & (a) x\nend '


def test_links_of_any_depth_leave_no_marks(spark):
    texts = [(0, "a [[x|b [[y|c [[z|d]] ]] ]] end"), (1, "[[unclosed and ]] [[open"), (2, "[[:Own]] [[:File:y|n]] [[File:x|[[in]]]]s [[w:ok| l ]]"), (3, "]] x [["),
             (4, "[[Haus]]ähnlich \ue010x\ue021"), (5, None), (6, "")]
    df = spark.createDataFrame(texts, "id int, t string")
    got = {r["id"]: r["clean"] for r in wiki.clean_pages(df, "t").collect()}
    assert got == {0: "a b c d end", 1: "unclosed and [[open", 2: ":Own s l", 3: "]] x [[", 4: "Hausähnlich x", 5: None, 6: ""}
    assert not any(0xE000 <= ord(c) <= 0xF8FF for t in got.values() for c in t or "")
    edges = sorted((r["id"], r["pos"], r["target"], r["label"]) for r in wiki.link_edges(df, "id", "t").collect())
    assert [e for e in edges if e[0] in (0, 4)] == [(0, 0, "z", "d"), (0, 1, "y", "c d"), (0, 2, "x", "b c d"), (4, 0, "Haus", "Hausähnlich")]
    assert wiki.link_edges(df.where("id = 3"), "id", "t").count() == 0


def test_links_infobox_sections(spark):
    df = spark.createDataFrame([(1, "[[A|b c]]ful [[D]] {{Infoboks p\n| x = 1\n| long name that is too long = 2\n| y = {{url|u.org}}\n| Y = [[L|m]]\n|z=\n}}\nrest\n")], "id int, t string")
    links = [(r["target"], r["label"]) for r in wiki.link_edges(df, "id", "t").orderBy("pos").collect()]
    assert links == [("A", "b cful"), ("D", "D"), ("L", "m")]
    box = {r["field"]: r["value"] for r in wiki.infobox_fields(df, "id", "t").collect()}
    assert box == {"__x": "1", "y": "l"}
    page = "intro\n== One ==\n* item\npara\nmore\n=== Empty ===\n== Two ==\n"
    rows = textops.compact_sections(spark.createDataFrame([(1, page)], "id int, t string"), "id", "t").orderBy("pos").collect()
    assert [(r["section"], r["text"]) for r in rows] == [(None, "intro"), ("One", "One. para"), ("One", "more")]


def test_template_closure_with_cycle(spark):
    uses = spark.createDataFrame([("a", "b"), ("b", "r"), ("c", "a"), ("x", "y")], "src string, dst string")
    redirects = spark.createDataFrame([("r", "c")], "name string, target string")
    got = {(r["src"], r["dst"]): r["depth"] for r in joins.template_closure(uses, redirects).collect()}
    assert got[("a", "a")] == 3 and got[("a", "c")] == 2 and ("a", "x") not in got and got[("x", "y")] == 1
    limited = joins.template_closure(uses, redirects, max_depth=1)
    assert limited.count() == 4


def test_redirect_and_template_names(spark):
    rows = spark.createDataFrame([("#REDIRECT [[Target page]]\nx", "{{A|{{B}}}} {{ C \n|x}} {{#if:y}}")], "r string, t string")
    got = rows.select(wf.redirect_target("r").alias("r"), wf.template_names("t").alias("t")).first()
    assert got["r"] == "Target page" and sorted(got["t"]) == ["A", "B", "C"]


def test_url_category_takes_first_listed_prefix(spark):
    cats = spark.createDataFrame([("s", "wide", "http://a.com/", 1), ("s", "deep", "http://a.com/x/", 2), ("t", "other", "http://b.com", 3)], "site string, cat string, prefix string, ord int")
    urls = spark.createDataFrame([(1, "http://a.com/x/1"), (2, "http://b.com.cn/"), (3, "ftp://c")], "page_id int, url string")
    got = {r["page_id"]: r["cat"] for r in joins.categorize_by_url(urls, cats).collect()}
    assert got == {1: "wide", 2: "other", 3: None}


def test_filters_and_reports(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, None, "a"), (3, " ", "b")], "id int, body string, k string")
    kept, rejected = filters.require_body(df, "body")
    assert [r["id"] for r in kept.collect()] == [1] and sorted(r["id"] for r in rejected.collect()) == [2, 3]
    assert {r["k"]: r["n"] for r in filters.duplicate_keys(df, "k").collect()} == {"a": 2}
    report = {r["rule"]: (r["violations"], r["rows"]) for r in filters.consistency_report(df, {"null": F.col("body").isNull(), "id": F.col("id") > 5}).collect()}
    assert report == {"null": (1, 3), "id": (0, 3)}
    assert sorted(r["id"] for r in filters.dedupe(df, ["k"], ["id"]).collect()) == [1, 3]


def test_nested_flattening(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('a', named_struct('b', 2, 'c', 'x'), 'd', '7') AS m")
    flat = textops.flatten_struct(df, "m", sep=".")
    assert flat.columns == ["id", "m.a.b", "m.a.c", "m.d"]
    assert flat.select(textops.int_or(F.col("`m.d`")), textops.int_or(F.col("`m.a.c`"))).first()[:] == (7, -1)


def test_registry():
    reg = ex.registry()
    assert len(reg) == 37
    assert {e.classifier for e in reg.values()} == {"nb", "svm"}
    assert sum(len(e.blocks) == 3 for e in reg.values()) == 3
    assert reg["sg_c4_wiki8_25_1000"].blocks[0].source == "fil8-c4-25-1000"


def test_grid_helpers():
    assert models.regularisations([0.1, 10], 100) == [0.1, 0.001]


def test_multilabel_scores(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["b"], ["b"]), (["a"], ["b"])], "t array<string>, p array<string>")
    # a: tp 1, actual 2, predicted 1 -> 2/3; b: tp 1, actual 2, predicted 2 -> 1/2
    assert abs(models.f1_multilabel(df, "t", "p", ["a", "b"]).first()["f1"] - (2 / 3 + 1 / 2) / 2) < 1e-9


def test_vectors(spark):
    docs = [(i, ("red blue green " * 5 if i % 2 else "cat dog cow " * 5).split()) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id int, t array<string>")
    counts = vocab.term_counts(df, "doc_id", F.col("t"))
    _, vectors = models.fit_vectors(df, "t", counts, size=8, min_count=1, iterations=1, partitions=1)
    assert vectors.count() == 6
    assert models.cluster_vectors(vectors, 2).count() == 6
    assert models.vector_min_count(counts, 1, 3) == 101 and models.vector_min_count(counts, 5, 100) == 5


def test_experiment_scores(spark):
    rows = [(i, "ball goal team win" if i % 2 else "court law judge rule", "sport" if i % 2 else "law") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label string")
    res = {"wiki8-c4-c1024": spark.createDataFrame([("0", "ball", 1), ("1", "cour", 1), ("10", "goal", 1), ("11", "judg", 1)], "cluster string, word string, freq int"),
           "fil8-5-1000": spark.createDataFrame([("ball", [1.0, 0.0]), ("law", [0.0, 1.0])], "token string, vec array<double>")}
    got = ex.run_experiments(df, ["base_mixed", "base_svm_c5", "bcluster_c4_wiki8_1024", "sg_word_wiki8_5_1000"], res, folds=3).collect()
    assert len(got) == 4 and all(r["mean"] == 1.0 and r["std"] == 0.0 and len(r["scores"]) == 3 for r in got)


def test_counts_survive_compaction(spark, tmp_path):
    from gramloom.streaming import jobs

    path = str(tmp_path / "counts")
    for i, rows in enumerate([[("a", 1), ("b", 2)], [("a", 3)], [("c", 5)]]):
        spark.createDataFrame(rows, "token string, n bigint").write.parquet(f"{path}/batches/batch={i}")
    want = {("a", 4), ("b", 2), ("c", 5)}
    for removed in (2, 0):
        assert jobs.compact_counts(spark, path) == removed
        assert {tuple(r) for r in jobs.counted_vocabulary(spark, path).collect()} == want
    spark.createDataFrame([("a", 1)], "token string, n bigint").write.parquet(f"{path}/batches/batch=3")
    assert jobs.compact_counts(spark, path) == 1
    assert {tuple(r) for r in jobs.counted_vocabulary(spark, path).collect()} == {("a", 5), ("b", 2), ("c", 5)}
