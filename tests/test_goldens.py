"""Inputs with known outputs: fixed values, as published results must come out the same."""

from pyspark.sql import functions as F

from gramloom.functions import text as t
from gramloom.functions import tokens as tk
from gramloom.operators import clusters as cl
from gramloom.operators import features as ft
from gramloom.operators import vocab
from gramloom.sources import lines as ln

SENTENCE = (
    "'''Anarchism''' originated as a term of abuse first used against early [[working class]] radicals including the "
    "[[Diggers]] of the [[English Revolution]] and the sans-culottes of the [[French Revolution]]. Whilst the term is still "
    "used in a pejorative way to describe ''any act that used violent means to destroy the organization of society, it has "
    "also been taken up as a positive label by self-defined anarchists. In 1998.")
PLAIN = (
    " anarchism originated as a term of abuse first used against early working class radicals including the diggers of the "
    "english revolution and the sans culottes of the french revolution whilst the term is still used in a pejorative way to "
    "describe any act that used violent means to destroy the organization of society it has also been taken up as a positive "
    "label by self defined anarchists in one nine nine eight ")
CLUSTERS = "0\tthe\t6\n10\tchased\t3\n110\tdog\t2\n1110\tmouse\t2\n1111\tcat\t2\n"
TOY = ["the cat chased the mouse", "the dog chased the cat", "the mouse chased the dog"]


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("r")).first()["r"]


def test_plain_alphabet(spark):
    assert one(spark, t.plain_alphabet("s"), s=SENTENCE) == PLAIN


def test_ngrams(spark):
    def grams(lo, hi):
        return one(spark, F.array_join(tk.char_grams_interleaved("s", lo, hi), " "), s="abc def ghi")

    assert grams(3, 3) == "abc bc_ c_d _de def ef_ f_g _gh ghi"
    assert grams(4, 4) == "abc_ bc_d c_de _def def_ ef_g f_gh _ghi"
    assert grams(3, 4) == "abc bc_ abc_ c_d bc_d _de c_de def _def ef_ def_ f_g ef_g _gh f_gh ghi _ghi"


def test_ngrams_keep_code_points_whole(spark):
    assert one(spark, tk.char_grams("s", 2), s="a😀b\nc") == ["a😀", "😀b", "b\n", "\nc"]
    assert one(spark, tk.char_grams("s", 3), s="ab") == []


def test_sentence_tag(spark):
    line = "<s> we , human be subsystem in the holistic system view . </s>"
    assert one(spark, t.strip_tag("s"), s=line) == "we , human be subsystem in the holistic system view ."
    assert one(spark, t.strip_tag("s"), s="no tag") == ""


def test_cluster_file(spark, tmp_path):
    path = tmp_path / "paths"
    path.write_text(CLUSTERS + "broken line\n111\tcow\tmany\n")
    clusters, rejects = ln.read_clusters(spark, str(path))
    rows = {r["word"]: (r["cluster"], r["freq"]) for r in clusters.collect()}
    assert rows == {"the": ("0", 6), "chased": ("10", 3), "dog": ("110", 2), "mouse": ("1110", 2), "cat": ("1111", 2)}
    assert rejects.count() == 2
    docs = spark.createDataFrame(list(enumerate(TOY)), "doc_id int, text string")
    tf = vocab.doc_term_counts(docs, "doc_id", tk.analyze("text"))
    got = {(r["doc_id"], r["cluster"]): r["value"] for r in ft.cluster_features(tf, clusters).collect()}
    assert got == {(0, "0"): 2, (0, "10"): 1, (0, "1111"): 1, (0, "1110"): 1, (1, "0"): 2, (1, "10"): 1, (1, "110"): 1, (1, "1111"): 1,
                   (2, "0"): 2, (2, "10"): 1, (2, "110"): 1, (2, "1110"): 1}
    assert sum(got.values()) == 15


def test_cluster_duplicates_and_prefix(spark):
    lines = spark.createDataFrame([(1, "0101\ta\t5"), (2, "0110\tb\t5"), (3, "0111\ta\t1"), (4, "0100\tc\t9")], "line int, value string")
    clusters, _ = cl.parse_clusters(lines, prefix_size=3)
    rows = {r["word"]: (r["cluster"], r["freq"], r["n_lines"]) for r in clusters.collect()}
    assert rows == {"a": ("011", 1, 2), "b": ("011", 5, 1), "c": ("010", 9, 1)}
    top = [(r["cluster"], r["word"]) for r in cl.top_terms(clusters, 1).orderBy("cluster").collect()]
    assert top == [("010", "c"), ("011", "b")]


def test_initial_clusters(spark):
    tokens = "the cat chased the mouse the dog chased the cat the mouse chased the cat".split()
    docs = spark.createDataFrame([(0, tokens)], "doc_id int, t array<string>")
    assert [r["token"] for r in vocab.initial_clusters(vocab.term_counts(docs, "doc_id", F.col("t")), 3).collect()] == ["the", "chased", "cat"]


def test_score_band(spark, tmp_path):
    path = tmp_path / "freq"
    path.write_text("###TOTAL###\t45\t10\n" + "".join(f"{i}\t{i}\t1\t0.{i}\n" for i in range(1, 10)))
    terms, totals = ln.read_term_scores(spark, str(path))
    assert totals.first().asDict() == {"n_tokens": 45, "n_docs": 10}
    bounds = terms.agg(F.percentile("idf", F.array(F.lit(0.3), F.lit(0.8)))).first()[0]
    assert [round(b, 6) for b in bounds] == [0.34, 0.74]
    assert sorted(r["term"] for r in vocab.score_band(terms, "idf", 0.3, 0.8).collect()) == ["4", "5", "6", "7"]


def test_clean_sentence(spark):
    got = one(spark, t.clean_sentence("s"), s="It's (really)  GOOD, isn't it? We'll see: they've won!")
    assert got == r"it 's \( really \) good , is n't it \? we 'll see they 've won !"


def test_wiki_tokens(spark):
    s = "A_b ''quoted'' 12:30, x#y Ünï²"
    assert one(spark, tk.wiki_tokens("s", "alpha"), s=s) == ["A", "b", "quoted", "x", "y", "Ünï²"]
    assert one(spark, tk.wiki_tokens("s", "all"), s=s) == ["A", "b", '"quoted"', "##:##,", "x", "y", "Ünï²"]
    assert one(spark, tk.wiki_tokens("s", "nopunct-lower-num"), s=s) == ["a", "b", "quoted", "12", "30", "x", "y", "ünï²"]


def test_character_ids(spark):
    ids = one(spark, tk.char_ids("s", length=8), s="aZ é-\n")
    space, unknown = tk.ALPHABET.index(" "), len(tk.ALPHABET)
    assert ids == [0, unknown, space, unknown, tk.ALPHABET.index("-"), tk.ALPHABET.index("\n"), space, space]
    assert len(one(spark, tk.char_ids("s"), s="x" * 3000)) == 1014


def test_entities(spark):
    s = "&lt;b&gt; &amp;lt; &#233;&#x1F600; &nope; &#xD800; &#0; &auml"
    assert one(spark, t.decode_entities("s"), s=s) == "<b> &lt; é😀 &nope; &#xD800; &#0; &auml"


def test_orders_and_recipes(spark):
    assert tk.parse_order("3") == (3, 3) and tk.parse_order("3,6") == (3, 6)
    assert one(spark, tk.recipe(None)(F.col("s")), s="A1") == " a one "
    assert one(spark, tk.recipe([2, 3])(F.col("s")), s="ab") == ["_a", "ab", "b_", "_ab", "ab_"]
    assert one(spark, F.array_join(tk.word_ngrams(F.split("s", " "), 1, 3), "|"), s="a b c") == "a|b|c|a b|b c|a b c"
    assert one(spark, tk.word_ngrams(F.split("s", " "), 2, 2), s="a") == []
