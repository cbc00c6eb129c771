"""The pipeline: stage by stage beside brute force on a small table, and its contract."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from gramloom.llm.langid import fit_language_filters, identify
from gramloom.llm.sentencepieces import load_model, model_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write_tables(spark, folder, docs, items):
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in docs], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]


def test_pipeline_on_planted_cases(spark, tmp_path):
    rng = random.Random(3)
    words = ["the", "of", "and", "in", "house", "water", "light", "stone", "green", "river", "paper", "winter"]
    vocabulary = [a + b for a in words for b in words]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    clean = {i: " ".join(prose(120)) for i in range(40)}
    near = clean[3].split()
    near[60] = "otherword"
    item = prose(30)
    docs = [*clean.items(), (50, clean[0].upper()), (51, clean[1]), (52, " ".join(near)), (53, " ".join(prose(40) + item[5:20] + prose(40))),
            (54, "12345 !!! ###"), (55, None), (56, ""), (57, " ".join(prose(40) + item[5:14] + prose(40)))]
    write_tables(spark, str(tmp_path), docs, [(1, " ".join(item)), (2, None)])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # copies leave the larger id, near copies the smaller one
    assert set(got) == (set(clean) - {0, 1}) | {50, 51, 57}
    library = load_model(model_file()).library
    texts = dict(docs)
    assert all(r.ids == library.encode(texts[i], add_bos=True, add_eos=True) and r.n_tokens == len(r.ids) for i, r in got.items())
    assert all(r.text == texts[i] for i, r in got.items())


def test_stages_keep_columns_and_bear_empty_tables(spark, tmp_path):
    write_tables(spark, str(tmp_path), [], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == COLUMNS


def test_repeated_rows_and_missing_ids(spark, tmp_path):
    prose = "the water of the river and the stone in the house and the light of the winter on the paper"
    write_tables(spark, str(tmp_path), [(7, prose), (7, prose), (None, prose + " again"), (None, prose + " AGAIN"), (8, prose.upper() + " other")], [(1, "x")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.drop_exact(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, len(r.text)) for r in got) == [(0, len(prose) + 6), (7, len(prose)), (8, len(prose) + 6)]


def test_languages_whose_ngrams_repeat_little_stay(spark):
    rng = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(1500)]
    words = ["".join(rng.choices(letters, k=rng.choice([2, 3, 4]))) for _ in range(20_000)]
    chance = [1 / (i + 20) for i in range(len(words))]
    prose = ["".join(rng.choices(words, chance, k=60)) for _ in range(1500)]
    english = ["the water of the river and the stone in the house " * 3 for _ in range(30)]
    rows = [(i, t, "zh", "s", len(t)) for i, t in enumerate(prose)] + [(5000 + i, t, "en", "s", len(t)) for i, t in enumerate(english)] + [(9000, "12 !!", "en", "s", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    scores = identify(docs.where("lang = 'zh'"), fit_language_filters(docs))
    assert scores.where("score < 0.2").count() > 750  # a constant of 0.2 loses most of them
    got = corpus_pipeline.drop_unknown_language(spark, docs, "")
    assert got.columns == COLUMNS
    left = {r.doc_id for r in got.collect()}
    assert len(left & set(range(1500))) >= 1500 * 0.97 and left & set(range(5000, 5030)) == set(range(5000, 5030)) and 9000 not in left


def test_rows_with_null_or_repeated_ids_are_judged_one_by_one(spark, tmp_path):
    rng = random.Random(8)
    text = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(6)]
    near = [t + " more" for t in text]
    item = " ".join(text[5].split()[10:30])
    rows = [(None, text[0]), (4, near[0]), (None, text[1]), (None, near[1]), (7, text[2]), (7, text[3]), (3, near[2]), (9, text[4]), (9, text[5]), (None, item + " x"), (None, None)]
    write_tables(spark, str(tmp_path), rows, [(None, item)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near(spark, docs, str(tmp_path)).collect()]
    ones = [g for g in got if g in [(None, text[1]), (None, near[1])]]
    assert len(ones) == 1 and set(got) - set(ones) == {(4, near[0]), (7, text[3]), (3, near[2]), (9, text[4]), (9, text[5]), (None, item + " x"), (None, None)}
    got = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, (r for r in rows if item not in (r[1] or ""))))


def test_decontamination_query_counts_items_without_id_as_its_twin_does(spark, tmp_path):
    import duckdb

    from gramloom.llm import decontamination

    a, b = (" ".join(f"{c}{i}" for i in range(14)) for c in "ab")
    write_tables(spark, str(tmp_path), [(1, f"x {a} y"), (2, f"{a} {b}"), (3, "nothing of it")], [(None, a), (None, a + " z"), (5, b), (6, None)])
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = decontamination.op9_decontamination(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({decontamination.SQL})").fetchall())
    assert [r.n_hit for r in got.orderBy("doc_id").collect()] == [14, 28, 0]


def test_language_stage_writes_scores_without_texts(spark, tmp_path, monkeypatch):
    written = {}
    real = corpus_pipeline.kept
    monkeypatch.setattr(corpus_pipeline, "kept", lambda df, name: written.setdefault(name, df.columns) and real(df, name))
    docs = spark.createDataFrame([(i, f"the house by the river {i % 3}", "en", "s", 24) for i in range(9)] + [(20, None, "en", "s", None), (21, "", "de", "s", 0)], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, docs, "").collect()} == set(range(9))
    assert "languages" in written and "text" not in written["languages"] and "numbered" not in written
    # rows of one id, or without one, stay or go one by one
    docs = docs.withColumn("doc_id", F.expr("CASE WHEN doc_id >= 20 THEN 1 WHEN doc_id = 5 THEN NULL ELSE doc_id END"))
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_unknown_language(spark, docs, "").collect()), key=str)
    assert got == sorted(((None if i == 5 else i, f"the house by the river {i % 3}") for i in range(9)), key=str)
