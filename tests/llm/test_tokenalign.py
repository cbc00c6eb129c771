"""Cross-tokenizer alignment beside the libraries and brute force over whole texts."""

import hashlib
import random
from bisect import bisect_left

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramloom.llm import tokenalign as ta

TEXTS = [
    None, "", " ", "  two  spaces ", "One text, of some words.", "One text, of some words.", "tab\tand\nlines \n here ", "Ünïcode wörds größer   nbsp x 　y",
    "中文 没有空格的句子。 再来", "emoji 🙂 👩‍👩‍👧 end", "a▁b mark", "<|endoftext|> <s> </s> plain", "x\u0085 y   z", "it's don't we'll I'd", "é combining", "\x00 nul \x1c sep",
    "word " * 3000, "longword" * 2000, "1234567890" * 50 + " 12 345", "     indented\n    code = x[1]", "é è ê à", "end space ", "​zero ​ width",
]


def pair():
    return ta.load_pair(*ta.model_files())


def brute(text, p):
    """(A ids, B ids, groups as id lists, links) of a whole text, straight from the definition."""
    if not text:
        return None
    whole = " " + text
    ids_a = p.a.encode(whole, add_special_tokens=False).ids
    ids_b = p.b.encode(text)
    letters = ta.byte_letters()
    bytes_a = [bytes(letters[c] for c in p.a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(x[3:5], 16)]) if p.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in ((i, p.b.id_to_piece(i)) for i in ids_b)]
    if b"".join(bytes_a) != whole.encode() or b"".join(bytes_b) != whole.encode():
        return None

    def spans(parts):
        out, at = [], 0
        for x in parts:
            out.append((at, at + len(x)))
            at += len(x)
        return out

    a, b = spans(bytes_a), spans(bytes_b)
    cuts = sorted({e for _, e in a} & {e for _, e in b})
    groups = {c: ([], []) for c in cuts}
    for side, (ids, where) in enumerate(((ids_a, a), (ids_b, b))):
        for i, (_, end) in zip(ids, where):
            groups[cuts[bisect_left(cuts, end)]][side].append(i)
    found, j0 = [], 0
    for i, (lo, hi) in zip(ids_a, a):
        while b[j0][1] <= lo:
            j0 += 1
        j = j0
        while j < len(b) and b[j][0] < hi:
            found.append((i, ids_b[j]))
            j += 1
    return ids_a, ids_b, list(groups.values()), found


def expected(rows, p):
    got = [brute(t, p) for _, t in rows]
    docs = {}
    for g in got:
        for pair_ in set(g[3]) if g else ():
            docs[pair_] = docs.get(pair_, 0) + 1
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, _), g in zip(rows, got):
        if g is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g[2])
        out.append((i, len(g[0]), len(g[1]), len(g[2]), len(g[3]), sum(docs[x] == best[x[0]] for x in g[3]), sum(docs[x] for x in g[3]), hashlib.sha256(shown.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("slices", [ta.BROADCAST_PAIRS, 7])
def test_equals_brute_force(spark, slices):
    """Also with so small a bound that the table of pairs is broadcast in many slices."""
    rows = list(enumerate(TEXTS if slices > 7 else TEXTS[:6]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ta.link_support(ta.align_tokens(docs, *ta.model_files()), slices).select("doc_id", *COLUMNS).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(rows, pair())


def test_documents_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = ta.op13_token_alignment(spark, sf).orderBy("doc_id").select("doc_id", *COLUMNS).collect()
    assert [tuple(r) for r in got] == expected(rows, pair())
    assert all(r.n_groups > 0 for r in got if r.n_a)


def test_random_texts_are_cut_where_both_tokenizers_end(spark):
    rng = random.Random(6)
    letters = [" ", " ", " ", "\n", "\t", "a", "b", "the", "'s", "9", ".", "é", "ß", " ", "\u0085", " ", "中", "🙂", "​", "я", "̀", "<", "0x"]
    rows = [(i, "".join(rng.choices(letters, k=rng.randrange(1, 40)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ta.link_support(ta.align_tokens(docs, *ta.model_files())).select("doc_id", *COLUMNS).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(rows, pair())


def test_pieces_hold_no_space_inside():
    p = pair().b
    assert not any(ta.SPACE in p.id_to_piece(i).lstrip(ta.SPACE) for i in range(p.get_piece_size()))


def groups_of(a, b, firsts=(0,)):
    return ta.align(np.array(a), np.array(b), np.array(firsts)).tolist()


def test_align_of_random_ends():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randrange(1, 60)
        a = sorted({*rng.sample(range(1, 80), rng.randrange(0, n)), 80})
        b = sorted({*rng.sample(range(1, 80), rng.randrange(0, n)), 80})
        cuts = sorted(set(a) & set(b))
        assert groups_of(a, b) == [0, *[a.index(c) + 1 for c in cuts[:-1]]]
        some = [0, *[a.index(c) + 1 for c in cuts[:-1] if rng.random() < 0.5]]
        assert groups_of(a, b, some) == groups_of(a, b)
        pairs = [(i, j) for i, (x, y) in enumerate(zip([0, *a], a)) for j, (u, v) in enumerate(zip([0, *b], b)) if x < v and u < y]
        assert list(zip(*(x.tolist() for x in ta.links(np.array(a), np.array(b))))) == pairs


def test_align_of_long_intervals_is_fast():
    odd, even = list(range(1, 400_001, 2)) + [400_002], list(range(2, 400_003, 2))
    assert groups_of(odd, even) == [0]
    same = list(range(1, 100_001))
    assert groups_of(same, same) == list(range(100_000))


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ta.link_support(ta.align_tokens(empty, *ta.model_files())).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ["pairs", "n_best", "_row", "_text", "times", "pair", "docs"]})
    got = ta.link_support(ta.align_tokens(docs, *ta.model_files()))
    rows = got.collect()
    assert len(rows) == 3 and all((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.pair) == (2, 2, 2, 2, 2, 6, "x") for r in rows)
