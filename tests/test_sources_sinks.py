"""Readers on small files with damaged records, and writers read back."""

import bz2
import gzip
import json
import zipfile

from pyspark.sql import functions as F

from gramloom.sinks import writers as wr
from gramloom.sources import lines as ln
from gramloom.sources import news as nw
from gramloom.sources import records as rc
from gramloom.sources import wiki as wk


def test_posts(spark, tmp_path):
    for group, name, text in [("sci.med", "101", b"From: a@b\nSubject: Hello\nsubject: again\n\n\nBody one\nline \xff two\n-- \nsig"), ("rec.autos", "7", b"Subject: x\n\nno signature")]:
        (tmp_path / group).mkdir()
        (tmp_path / group / name).write_bytes(text)
    rows = {r["id"]: r for r in nw.read_posts(spark, str(tmp_path)).collect()}
    assert rows[101]["group"] == "sci.med" and rows[101]["subject"] == "Hello\nagain" and rows[101]["body"] == "Body one\nline  two"
    assert rows[7]["body"] == "no signature"


def test_sgml(spark, tmp_path):
    doc = ('<REUTERS TOPICS="YES" LEWISSPLIT="TRAIN" CGISPLIT="T" OLDID="5" NEWID="{i}">\n<DATE>d</DATE><TOPICS><D>earn</D><D>acq</D></TOPICS><PLACES></PLACES>'
           '<UNKNOWN>u</UNKNOWN><TEXT><TITLE>A &lt;B></TITLE><DATELINE>x</DATELINE>{b}</TEXT></REUTERS>\n')
    (tmp_path / "a.sgm").write_text("<!DOCTYPE lewis>\n" + doc.format(i=1, b="<BODY>text &amp; more</BODY>") + doc.format(i=2, b=""))
    rows = nw.read_sgml_news(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["id"], r["oldid"], r["has_topics"], r["topics"], r["places"], r["unknown"]) == (1, 5, "YES", ["earn", "acq"], [], "u")
    assert r["title"] == "A <B>" and r["body"] == "text & more"


def test_xml_news(spark, tmp_path):
    folder = tmp_path / "part" / "19960820"
    folder.mkdir(parents=True)
    (folder / "1.xml").write_text(
        '<?xml version="1.0"?><newsitem itemid="2286" date="1996-08-20"><title>T</title><headline>H</headline><text><p>one</p><p>two</p></text><metadata>'
        '<codes class="bip:topics:1.0"><code code="C15"/><code code="CCAT"/></codes><codes class="bip:countries:1.0"><code code="UK"/></codes></metadata></newsitem>')
    (folder / "2.xml").write_text('<newsitem itemid="3" date="d"><title>U</title></newsitem>')
    rows = {r["id"]: r for r in nw.read_xml_news(spark, str(tmp_path)).collect()}
    assert rows["2286"]["text"] == ["one", "two"] and rows["2286"]["codes"] == {"topics": ["C15", "CCAT"], "countries": ["UK"]}
    assert rows["2286"]["byline"] is None and rows["3"]["text"] is None and rows["3"]["codes"] is None


def test_code_list(spark, tmp_path):
    (tmp_path / "codes").write_text(";comment\n\nC15\tPERFORMANCE\nC15\tOTHER\nM1\tPERFORMANCE\nbad\n")
    assert sorted((r["code"], r["term"]) for r in ln.read_code_list(spark, str(tmp_path / "codes")).collect()) == [("C15", "OTHER"), ("C15", "PERFORMANCE"), ("M1", "PERFORMANCE")]


def test_author_conversations(spark, tmp_path):
    (tmp_path / "a1_en_20s_male.xml").write_text(
        '<author lang="en" gender="female" age_group="20s"><conversations count="3"><conversation id="c1">Hi &amp; <b>bold</b> x</conversation><conversation id="c2"/></conversations></author>')
    rows = {r["conv_id"]: r for r in nw.read_author_conversations(spark, str(tmp_path)).collect()}
    assert rows["c1"]["content"] == "Hi & " and rows["c2"]["content"] == ""
    assert (rows["c1"]["author_id"], rows["c1"]["gender"], rows["c1"]["stored_gender"], rows["c1"]["declared"], rows["c1"]["actual"]) == ("a1", "male", "female", 3, 2)


def test_author_documents(spark, tmp_path):
    (tmp_path / "x9.xml").write_text('<author type="blog" lang="en"><documents count="2"><document id="d" url="u1"><![CDATA[a <b>]]></document><document id="d" url="u2"><![CDATA[later]]></document></documents></author>')
    (tmp_path / "truth.txt").write_text("x9:::male:::18-24\nbroken\n")
    rows = nw.read_author_documents(spark, str(tmp_path)).collect()
    assert [(r["author_id"], r["document_id"], r["url"], r["text"]) for r in rows] == [("x9", "d", "u2", "later")]
    assert [tuple(r) for r in nw.read_truth(spark, str(tmp_path / "truth.txt")).collect()] == [("x9", "male", "18-24")]


def test_gzip_sentences_with_limit(spark, tmp_path):
    with gzip.open(tmp_path / "c.gz", "wt") as f:
        f.write("<s> a b </s>\n<s>  </s>\nuntagged\n<s> c </s>\n<s> d </s>\n")
    path = str(tmp_path / "c.gz")
    assert [r["tokens"] for r in ln.read_tagged_sentences(spark, path).orderBy("line").collect()] == [["a", "b"], ["c"], ["d"]]
    assert [r["tokens"] for r in ln.read_tagged_sentences(spark, path, limit=2).collect()] == [["a", "b"], ["c"]]


def test_wiki_dump(spark, tmp_path):
    xml = ('<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.8/"><siteinfo><sitename>W</sitename></siteinfo>'
           '<page><title>A &amp; B</title><ns>0</ns><id>12</id><revision><id>5</id><contributor><username>u</username><id>9</id></contributor><text xml:space="preserve">some &lt;b&gt; text</text></revision></page>'
           '<page><title>R</title><id>13</id><redirect title="A" /><revision><id>6</id><parentid>5</parentid><text xml:space="preserve">#REDIRECT [[A]]</text></revision></page></mediawiki>')
    with bz2.open(tmp_path / "d.xml.bz2", "wt") as f:
        f.write(xml)
    rows = {r["id"]: r for r in wk.read_wiki_pages(spark, str(tmp_path / "d.xml.bz2")).collect()}
    assert rows[12]["title"] == "A & B" and rows[12]["revision_text"] == "some <b> text" and rows[12]["revision_contributor_id"] == 9
    assert rows[12]["revision_parentid"] == -1 and rows[13]["redirect"] == "A" and rows[12]["redirect"] is None
    assert wk.read_wiki_pages(spark, str(tmp_path / "d.xml.bz2"), limit=1).count() == 1


def test_search_dump(spark, tmp_path):
    recs = [({"_type": "page", "_id": "1"}, {"title": "t", "text": "x"}), ({"_type": "page", "_id": "2"}, {"title": "t"}), ({"_type": "namespace", "_id": "3"}, {"title": "t", "text": "x"})]
    with gzip.open(tmp_path / "d.gz", "wt") as f:
        for action, source in recs:
            f.write(json.dumps({"index": action}, separators=(",", ":")) + "\n" + json.dumps(source) + "\n")
    assert [tuple(r) for r in rc.read_search_dump(spark, str(tmp_path / "d.gz")).collect()] == [("1", "t", "x")]


def test_json_tree(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        for i in range(3):
            (tmp_path / d / f"{i}.json").write_text(json.dumps({"title": f"{d}{i}"}, indent=1))
    (tmp_path / "a" / "bad.json").write_text("{not json")
    read = lambda **kw: [r["title"] for r in rc.read_json_tree(spark, str(tmp_path), "title string", **kw).collect()]
    assert sorted(read()) == ["a0", "a1", "a2", "b0", "b1", "b2"]
    assert sorted(read(limit=2)) == ["a0", "a1"] and len(read(limit=4, shuffle_seed=1)) == 4


def test_reviews(spark, tmp_path):
    with gzip.open(tmp_path / "books.json.gz", "wt") as f:
        f.write(json.dumps({"asin": "1", "overall": 5.0, "helpful": [1, 2]}) + "\n")
    r = rc.read_reviews_with_source(spark, str(tmp_path / "books.json.gz")).first()
    assert (r["asin"], r["overall"], r["helpful"], r["sourcefile"]) == ("1", 5.0, [1, 2], "books.json.gz")
    (tmp_path / "y.json").write_text("".join(json.dumps({"review_id": str(i), "stars": 3, "votes": {"useful": i, "cool": 1, "funny": 0}}) + "\n" for i in range(3)))
    rows = rc.read_star_reviews(spark, str(tmp_path / "y.json"), limit=2)
    assert [(r["review_id"], r["votes_useful"]) for r in rows.collect()] == [("0", 0), ("1", 1)]
    assert dict(rows.dtypes)["votes_funny"] == "int" and "votes" not in rows.columns


def test_line_xml_and_polarity(spark, tmp_path):
    (tmp_path / "n.xml").write_text('<?xml version="1.0"?>\n<all_news>\n' + "".join(f"<{f}>{f} 1</{f}>" for f in ln.NEWS_FIELDS) + "\n</all_news>\n")
    rows = ln.read_line_xml(spark, str(tmp_path / "n.xml")).collect()
    assert len(rows) == 1 and rows[0]["pubdate"] == "pubdate 1" and rows[0]["title"] == "title 1"
    (tmp_path / "p").write_bytes(b" good \xff one \n")
    (tmp_path / "n").write_bytes(b"bad\n")
    got = ln.read_labelled_files(spark, {"pos": str(tmp_path / "p"), "neg": str(tmp_path / "n")}).collect()
    assert sorted(tuple(r) for r in got) == [("bad", "neg"), ("good  one", "pos")]


def test_gb18030_news(spark, tmp_path):
    doc = "<doc>\n<url>http://a.com/{0}</url>\n<docno>{0}</docno>\n<contenttitle>标题{0}</contenttitle>\n<content>内容，中文 㐀{0}</content>\n</doc>\n"
    (tmp_path / "n.dat").write_bytes("".join(doc.format(i) for i in range(3)).encode("gb18030"))
    rows = ln.read_block_docs(spark, str(tmp_path / "n.dat")).orderBy("docno").collect()
    assert [r["content"] for r in rows] == [f"内容，中文 㐀{i}" for i in range(3)] and rows[0]["contenttitle"] == "标题0"
    assert ln.read_block_docs(spark, str(tmp_path / "n.dat"), limit=2).count() == 2
    assert spark.conf.get(ln.CHARSET_SWITCH) == "false"
    (tmp_path / "c.txt").write_bytes("1. 搜狐 sohu\n体育：\nhttp://a.com/\n\nhttp://b.com/\n2. 新浪\n财经\nhttp://c.com/\n".encode("gb18030"))
    cats = ln.read_url_categories(spark, str(tmp_path / "c.txt")).orderBy("prefix").collect()
    assert [(r["site"], r["cat"], r["prefix"]) for r in cats] == [("搜狐", "体育", "http://a.com/"), ("搜狐", "体育", "http://b.com/"), ("新浪", "财经", "http://c.com/")]


def test_indexed_texts_and_class_tables(spark, tmp_path):
    texts = tmp_path / "tokenized"
    texts.mkdir()
    for i in range(3):
        (texts / f"{i}.txt").write_text(f"text {i}\n")
    (tmp_path / "index.csv").write_text("0.txt,P1,DEU,high\n2.txt,P2,FRA,low\n9.txt,P2,FRA,low\n")
    rows = rc.read_indexed_texts(spark, str(tmp_path / "index.csv"), str(texts)).orderBy("filename").collect()
    assert [(r["filename"], r["text"], r["l1"]) for r in rows] == [("0.txt", "text 0\n", "DEU"), ("2.txt", "text 2\n", "FRA")]
    (tmp_path / "film.csv").write_text('title,abstract\nA,"one, ""two"""\nB,same\nC,same\nD,\n')
    (tmp_path / "plant.csv").write_text("title,abstract\nE,same\n")
    got = sorted(tuple(r[c] for c in ("title", "abstract", "category")) for r in rc.read_class_csvs(spark, str(tmp_path), ["Film", "Plant"]).collect())
    assert got == [("A", 'one, "two"', "Film"), ("B", "same", "Film"), ("E", "same", "Plant")]


def test_token_stream_and_archives(spark, tmp_path):
    (tmp_path / "text8").write_text(" anarchism originated as\na term ")
    assert [r["token"] for r in ln.read_token_stream(spark, str(tmp_path / "text8")).collect()] == ["anarchism", "originated", "as", "a", "term"]
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("d/1.xml", "<a/>")
    (tmp_path / "bad.zip").write_bytes(b"PK damaged")
    entries, corrupt = rc.explode_archives(spark, str(tmp_path))
    assert [(r["archive"], r["name"], bytes(r["content"])) for r in entries.collect()] == [("good", "d/1.xml", b"<a/>")]
    assert [r["archive"] for r in corrupt.collect()] == ["bad"]


def test_bucketed_articles(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "Ab c!", "x"), (2, "abc", "y"), (3, "Z", "z")], "id int, title string, text string")
    wr.write_bucketed(df, path, "id")
    rows = {r["title"]: r for r in wr.read_bucketed(spark, path).collect()}
    assert set(rows) == {"Ab c!", "Z"} and rows["Z"]["bucket"] == "z_" and rows["Ab c!"]["bucket"] == "ab"
    assert wr.key_collisions(df).count() == 1
    changed = df.withColumn("text", F.lit("new")).unionByName(spark.createDataFrame([(4, "New", "n")], df.schema))
    wr.write_bucketed(changed, path, "id")
    assert {r["title"]: r["text"] for r in wr.read_bucketed(spark, path).collect()} == {"Ab c!": "x", "Z": "z", "New": "n"}
    wr.write_bucketed(changed, path, "id", repeat=True)
    assert {r["title"]: r["text"] for r in wr.read_bucketed(spark, path).collect()} == {"Ab c!": "new", "Z": "new", "New": "n"}


def test_split_files(spark, tmp_path):
    df = spark.range(100).withColumn("text", F.repeat(F.lit("x"), 50))
    wr.write_split(df, str(tmp_path / "s"), 1000, [F.col("id")], compression="bzip2")
    back = spark.read.schema("id bigint, text string").json(str(tmp_path / "s"))
    assert back.count() == 100
    per_file = back.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()
    assert len(per_file) > 5 and max(r["n"] for r in per_file) <= 16


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a1", "c1", "en", 'say "x", y'), ("a2", "c2", "de", None)], "author_id string, conv_id string, lang string, content string")
    wr.write_conversations(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("lang = 'en'").first()["content"] == 'say "x", y'
    wr.build_key_index(df, str(tmp_path / "i"))
    assert wr.build_key_index(df.limit(0), str(tmp_path / "i")).count() == 2
    wr.write_quoted_csv(df.select("author_id", F.array("lang", "conv_id").alias("t"), "content"), str(tmp_path / "q"))
    raw = "".join(p.read_text() for p in (tmp_path / "q").glob("*.csv"))
    assert '"a1","en|c1","say ""x"", y"' in raw and '"author_id","t","content"' in raw


def test_output_files_never_exceed_the_limit(spark):
    sizes = [(i, 7 if i % 10 else 90 if i % 20 else 300) for i in range(400)]
    df = spark.createDataFrame(sizes, "id int, size long")
    files = {}
    for r in wr.assign_output_files(df, 100, [F.col("id")]).collect():
        files.setdefault(r["file_no"], []).append((r["id"], r["size"]))
    assert all(sum(s for _, s in rows) <= 100 or len(rows) == 1 for rows in files.values())
    assert [i for n in sorted(files) for i, _ in sorted(files[n])] == list(range(400))


def test_reader_limits(spark, tmp_path):
    spark.range(20).selectExpr("to_json(struct(id)) AS value").write.text(str(tmp_path / "j"))
    assert [r["id"] for r in rc.read_json_lines(spark, str(tmp_path / "j"), "id bigint", limit=3).collect()] == [0, 1, 2]


def test_scratch_is_cleared(spark, tmp_path):
    from gramloom.session import clear_scratch, scratch_path

    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    clear_scratch(spark)
    assert not wr.path_exists(spark, path)
