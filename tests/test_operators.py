"""Edge cases on small inline tables."""

import io
import json
import sqlite3
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as fn
from sparkloom.operators import geometry, lines, reconcile, study, words
from sparkloom.sources import exchange, html, packages
from sparkloom.streaming import study as stream


def one(spark, column, **values):
    types = {str: "string", int: "int", float: "double"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (fn.repeat_key, " Page 12  of\n340 ", "Page # of #"),
        (fn.term_key, "The  House, (old)", "house old"),
        (fn.term_key, "Das Haus.", "haus"),
        (fn.ascii_digits, "٣४๙５7", "34957"),
        (fn.xml_escaped, "a<b>&\x01", "a&lt;b&gt;&amp;"),
        (fn.markers_escaped, "<1>a</1><2/>", "‹1›a‹/1›‹2/›"),
        (fn.markers_restored, "‹1›a‹/1›", "<1>a</1>"),
        (fn.tags_to_text, "a<1/>b<2>c</2>", "a bc"),
        (fn.markdown_unescaped, r"\*a\_b \\", r"*a_b \ ".strip()),
        (fn.file_stem, "a.b/c.tar.gz", "a.b/c.tar"),
        (fn.html_to_text, "<p>a&nbsp;b<br>c</p>\n\n<div>&lt;d&gt;</div>[sound:x.mp3]", "a b\nc\n<d>"),
        (fn.cell_column, "AB12", 27),
        (words.language, "el perro de la casa y el gato", "es"),
        (words.language, "これは本です", "ja"),
        (words.language, "xyz qqq", ""),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f(F.col("x")), x=value) == want


def test_columns_of_cells(spark):
    names = [one(spark, fn.column_name(F.col("x")), x=n) for n in (0, 25, 26, 27, 701, 702)]
    assert names == ["A", "Z", "AA", "AB", "ZZ", "AAA"]


def test_joined_lines(spark):
    df = spark.createDataFrame([(["An exam-", "ple of", "", "a well-", "Known -", "x"],)], "a array<string>")
    assert df.select(fn.joined_lines("a")).first()[0] == "An example of a well- Known - x"


def test_snippet(spark):
    text = "word " * 30 + "TARGET" + " word" * 30
    got = one(spark, fn.snippet(F.col("x"), F.lit(150), F.lit(6)), x=text)
    assert got.startswith("…word") and "TARGET" in got and got.endswith("word…") and len(got) <= 120


def test_words(spark):
    docs = spark.createDataFrame([(1, "The big-dog's house, the Big-Dog's House. don't"), (2, "HOUSE of cards house-"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.key: (r.n, r.form) for r in words.top_forms(docs).collect()}
    assert got["house"] == (4, "house") and got["big-dog's"] == (2, "big-dog's") and "the" not in got
    phrases = {r.phrase: r.n for r in words.groups(docs).collect()}
    assert phrases == {"big-dog's house": 2}


def test_page_ranges_and_back(spark):
    f = lambda x: one(spark, reconcile.page_ranges(F.col("x"), F.lit(10)), x=x)
    assert f("1-3,7, -2 9-") == [0, 1, 2, 6, 8, 9]
    assert [f(x) for x in ("", "0", "3-2", "11", "a", "1,,2")] == [None, None, None, None, None, [0, 1]]
    df = spark.createDataFrame([("a", n) for n in (1, 2, 3, 5, 7, 8, 8)], "k string, n long")
    assert reconcile.id_ranges(df, "k").first().ranges == "1-3,5,7-8"


def test_import_with_unknown_ids(spark):
    known = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    parsed = spark.createDataFrame([(2,), (999,), (2,)], "id long")
    assert tuple(reconcile.import_counts(known, parsed).first()) == (1, 1, 2)
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id long, target string, ord int")
    assert reconcile.latest(rows).first().target == "b"


def test_merge_and_three_way(spark):
    schema = "id long, target string"
    current = spark.createDataFrame([(1, "old"), (2, " "), (3, None)], schema)
    parsed = spark.createDataFrame([(1, "new"), (2, "two"), (9, "x")], schema)
    got = {r.id: (r.target, r.changed) for r in reconcile.merged(current, parsed).collect()}
    assert got == {1: ("old", False), 2: ("two", True), 3: (None, False)}
    assert {r.id: r.target for r in reconcile.merged(current, parsed, overwrite=True).collect()}[1] == "new"


def test_bookmarks(spark):
    marks = spark.createDataFrame([(1, "2.1 Results"), (2, "Intro"), (3, "None")], "id long, text string")
    segs = spark.createDataFrame([(10, "Intro ...... 4", "toc"), (11, "intro", "Einleitung"), (12, "3.4 Results", "3.4 Ergebnisse")], "id long, text string, target string")
    got = {r.id: r.target for r in reconcile.bookmark_targets(marks, segs).collect()}
    assert got == {1: "2.1 Ergebnisse", 2: "Einleitung", 3: None}


def test_marker_issues(spark):
    got = one(spark, reconcile.marker_issues(F.col("a"), F.col("b")), a="<1>x</1> <2/>", b="<1>y <3/>")
    assert (got.missing, got.broken) == (2, 2)


def test_numbers_move_over(spark):
    f = lambda t, a, b: one(spark, lines.number_transfer(F.col("t"), F.col("a"), F.col("b")), t=t, a=a, b=b)
    assert f("Seite 3 von 10 (3)", "Page 3 of 10", "Page 4 of 10") == "Seite 4 von 10 (3)"
    assert f("x 3", "3", "4 5") == "x 3" and f("3 und 3", "3 3", "7 8") == "7 und 8"


def test_search(spark):
    docs = spark.createDataFrame([(1, "a.b A.B xa.b"), (2, None)], "doc_id long, text string")
    hits = lambda **k: [(r.start, r.length) for r in lines.matches(docs, lines.search_pattern("a.b", **k)).orderBy("start").collect()]
    assert hits() == [(0, 3), (4, 3), (9, 3)] and hits(word=True) == [(0, 3), (4, 3)] and hits(case=True) == [(0, 3), (9, 3)]


def test_bands(spark):
    docs = spark.createDataFrame([(i, "s", f"Report {i}\nbody {chr(97 + i)}\n- {i} -") for i in range(5)], "doc_id long, source string, text string")
    got = [(r.band, r.norm, r.docs, r.lead) for r in lines.band_repeats(docs).collect()]
    assert got == [("top", "Report #", 5, 0)]


def test_streak_needs_today_or_yesterday(spark):
    log = spark.createDataFrame([(u, datetime(2024, 1, d)) for u, ds in {1: (10, 9, 8, 6), 2: (9, 8), 3: (8,)}.items() for d in ds], "user_id int, ts timestamp_ntz")
    assert {r.user_id: r.streak for r in study.streaks(log, F.lit("2024-01-10").cast("date")).collect()} == {1: 3, 2: 2, 3: 0}


def test_round(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 0, None, False), (2, 0, None, True), (3, 1, t, True), (4, 6, t, True), (5, 0, None, False), (6, 2, t, True)]
    both = [(u, *r) for u in (1, 2) for r in rows]
    cards = spark.createDataFrame(both, "user_id int, id int, known int, last timestamp_ntz, seen boolean")
    got = study.round_rows(cards, F.lit("2024-01-10").cast("timestamp_ntz"), cap=2).orderBy("user_id", "place").collect()
    assert [(r.user_id, r.id) for r in got] == [(u, i) for u in (1, 2) for i in (2, 1, 3, 6)]
    # No fewer new words than were seen, whatever the cap.
    assert [r.id for r in study.round_rows(cards.where("user_id = 1"), F.lit("2024-01-10").cast("timestamp_ntz"), cap=2, shown=9).orderBy("place").collect()] == [2, 3, 6]


def test_vocabulary(spark):
    t = datetime(2024, 1, 1)
    have = spark.createDataFrame([("de-en", "Haus", "house", "", "", t, 2, 3, t, True)], study.VOCABULARY)
    new = [("de-en", " haus ", "home", "Das Haus", "", 1, t), ("de-en", "Baum", "tree", "", "", 2, t), ("de-en", "Baum", "trees", "", "x", 3, t), ("bad", "a", "b", "", "", 4, t), ("de-en", "", "b", "", "", 5, t)]
    rows = spark.createDataFrame(new, "pair string, term string, translation string, example string, example_tr string, ord int, ts timestamp_ntz")
    got = {r.term: (r.translation, r.example, r.example_tr, r.seen, r.known, r.fav) for r in study.add_terms(have, rows).collect()}
    assert got == {"Haus": ("home", "Das Haus", "", 3, 3, True), "Baum": ("trees", "", "x", 2, 0, False)}
    dupes = spark.createDataFrame([("de-en", "das Haus", "house; Home", "", "", t, 1, 0, None, False), ("de-en", "Haus", "home; building", "ex", "", t, 2, 4, t, True)], study.VOCABULARY)
    r = study.merge_duplicates(dupes).collect()
    assert len(r) == 1 and (r[0].term, r[0].translation, r[0].example, r[0].seen, r[0].known, r[0].fav) == ("das Haus", "house; Home; building", "ex", 3, 4, True)
    back = study.restore(have, spark.createDataFrame([("de-en", "Haus", "x", "ex", "", t, 9, 5, t, False), ("de-en", "neu", "new", "", "", t, 1, 0, None, False)], study.VOCABULARY))
    got = {r.term: (r.translation, r.example, r.known, r.fav) for r in back.collect()}
    assert got == {"Haus": ("house", "ex", 5, True), "neu": ("new", "", 0, False)}


SEGS = [("f", 1, 0, 'a "q", <b> & c', "x\ny <z>"), ("f", 3, 1, "two", ""), ("f", 6, 2, "six;", 'd "e", & f')]


@pytest.mark.parametrize(("write", "read", "all_ids"), [(exchange.write_markers, exchange.read_markers, True), (exchange.write_csv, exchange.read_csv, False), (exchange.write_json, exchange.read_json, False), (exchange.write_xliff, exchange.read_xliff, False)])
def test_round_trips(spark, write, read, all_ids):
    rows = spark.createDataFrame(SEGS, "file string, id long, page int, source string, target string")
    got = {r.id: r.target for r in read(write(rows)).collect()}
    want = {1: "x\ny <z>", 6: 'd "e", & f'}
    assert got == (want | {3: "two"} if all_ids else want)


def read(spark, reader, text):
    return {r.id: r.target for r in reader(spark.createDataFrame([("f", text)], "file string, text string")).collect()}


def test_tolerant_readers(spark):
    marked = "x\n[[1]]\nOne\n [[ 2 ]] \nTwo\n［［3］］\nThree\n【【4】】 Inline text\n[[5]]\n\n[[1]]\nagain\r\nmore\n«« #٦ »»six"
    assert read(spark, exchange.read_markers, marked) == {1: "again\nmore", 2: "Two", 3: "Three", 4: "Inline text", 6: "six"}
    assert read(spark, exchange.read_csv, "﻿target;id;source\nsieben;7;seven\n;8;eight\nx;y;z") == {7: "sieben"}
    assert read(spark, exchange.read_csv, '1,"a, ""b""\nc"\n2,d') == {1: 'a, "b"\nc', 2: "d"}
    assert read(spark, exchange.read_json, '{"4": " four ", "x": "y", "5": ""}') == {4: "four"}
    assert read(spark, exchange.read_json, '[{"id": 1, "translation": "t"}, {"id": "2", "target": "u", "translation": "v"}]') == {1: "t", 2: "u"}
    two = '<xliff version="2.0"><file id="f"><unit id="4"><segment><source>a</source><target>vi<g id="1">er</g> &amp;</target></segment></unit><unit id="n"><segment><target>x</target></segment></unit></file></xliff>'
    assert read(spark, exchange.read_xliff, two) == {4: "vier &"}


def test_lists(spark):
    rows = lambda f, x: [tuple(r) for r in one(spark, f(F.col("x")), x=x)]
    assert rows(exchange.glossary_rows, "Sprachen: de → en\n- Haus = house | Das Haus | The house\n2. Baum: tree\nnothing\n") == [("Haus", "house", "Das Haus", "The house"), ("Baum", "tree", "", "")]
    assert rows(exchange.vocabulary_rows, "#x\na\tb<br>c\nd;e;f;g\nh -> i\nj") == [("a", "b", "", "c"), ("d", "e", "f", "g"), ("h", "i", "", "")]
    srt = "1\n00:01 --> 00:02\nHello\nyou\n\n2\n00:03 --> 00:04\n\nNOTE x\n\n00:05 --> 00:06\nBye\n"
    assert rows(exchange.cues, srt) == [("00:01 --> 00:02", "Hello\nyou"), ("00:05 --> 00:06", "Bye")]


def test_kinds(spark):
    rows = [(b"%PDF-1", "x", "pdf"), (b"\xff\xd8\xff", "x.pdf", "jpeg"), (b"PK\x03\x04", "a.EPUB", "epub"), (b"PK\x03\x04", "a.x", "zip"), (b"abc", "a.srt", "srt"), (b"WEBVTT\n", "a", "vtt"), (b"", "a", "pdf")]
    df = spark.createDataFrame(rows, "content binary, name string, want string")
    assert [r.k == r.want for r in df.select(exchange.kind_of(F.col("content"), F.col("name")).alias("k"), "want").collect()] == [True] * len(rows)


def test_html_blocks():
    page = "<html><head><title>t</title></head><body><script>'</p>'</script><p>Hi <b>bold <i>x</i></b> you<br>two</p><ul><li><a href=x>all</a></li><li>--</li></ul>tail <img> end</body></html>"
    assert html.blocks(page) == [("p", "Hi <1>bold <2>x</2></1> you\ntwo"), ("li", "all"), ("body", "tail <1/> end")]
    assert html.blocks(None) == [] and html.blocks("") == []


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def deck(tmp_path):
    db = sqlite3.connect(tmp_path / "c.db")
    db.execute("create table col (models text)")
    db.execute("create table notes (id int, mid int, flds text)")
    db.execute("insert into col values (?)", (json.dumps({"5": {"flds": [{"name": "Back"}, {"name": "Front"}, {"name": "Example"}]}}),))
    db.execute("insert into notes values (1, 5, ?)", ("house\x1f<b>Haus</b>\x1fDas Haus",))
    db.commit()
    db.close()
    return zipped(**{"collection.anki2": (tmp_path / "c.db").read_bytes()})


def test_packages(spark, tmp_path):
    word = packages.write_docx([(1, "Hello\nyou"), (2, "a < b")])
    book = zipped(**{
        "META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><title>T</title><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/></spine></p>',
        "o/a.xhtml": "<p>extra</p>", "o/b.xhtml": "<p>main</p>",
    })
    files = spark.createDataFrame([("w", word), ("bad", b"no zip")], "path string, content binary")
    got = packages.segments(files, "docx").orderBy("path", "no").collect()
    assert [(r.path, r.text) for r in got] == [("bad", None), ("w", "[[1]]"), ("w", "Hello\nyou"), ("w", "[[2]]"), ("w", "a < b")] and "BadZipFile" in got[0].error
    text = "\n".join(r.text for r in got if r.path == "w")
    assert read(spark, exchange.read_markers, text) == {1: "Hello\nyou", 2: "a < b"}
    e = spark.createDataFrame([("e", book)], "path string, content binary")
    assert [(r.tag, r.text, r.hidden) for r in packages.segments(e, "epub").orderBy("no").collect()] == [("title", "T", True), ("p", "main", False), ("p", "extra", True)]
    assert packages.zip_entries(e).count() == 4
    f = spark.createDataFrame([("f", b"<F><description><book-title>B</book-title></description><body><p>a  <i>b</i></p></body></F>")], "path string, content binary")
    assert [(r.text, r.hidden) for r in packages.segments(f, "fb2").orderBy("no").collect()] == [("B", True), ("a b", False)]
    d = spark.createDataFrame([("d", deck(tmp_path))], "path string, content binary")
    assert [tuple(r)[2:6] for r in packages.decks(d).collect()] == [("Haus", "house", "Das Haus", "")]
    sheet = zipped(**{
        "xl/workbook.xml": '<w xmlns:r="u"><sheet name="S" r:id="r1"/></w>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="s.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>hi</t></si></sst>", "xl/s.xml": '<s><c r="A1" t="s"><v>0</v></c><c r="B1"><v>4</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></s>',
    })
    x = spark.createDataFrame([("x", sheet)], "path string, content binary")
    assert [(r.cell, r.value) for r in packages.cells(x).orderBy("no").collect()] == [("A1", "hi"), ("B1", "4"), ("C1", "in")]


def test_chunks_and_rules(spark):
    rules = [(150.0, 0.0, 151.0, 40.0)]
    rows = [(1, 0, 0, 0, "a", 0.0, 20.0, rules), (1, 0, 0, 1, "b", 25.0, 60.0, rules), (1, 0, 0, 2, " ", 60.0, 140.0, rules), (1, 0, 0, 3, "c", 145.0, 149.0, []), (1, 0, 0, 4, "d", 152.0, 170.0, rules)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line int, pos int, text string, x0 double, x1 double, rules array<struct<x0:double,y0:double,x1:double,y1:double>>")
    df = df.withColumn("y0", F.lit(10.0)).withColumn("y1", F.lit(20.0)).withColumn("size", F.lit(10.0))
    assert {r.text: r.chunk for r in geometry.chunks(df).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2}


def test_neighbours_columns_and_groups(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 40.0, 10.0), (1, 0, 2, 50.0, 1.0, 90.0, 11.0), (1, 0, 3, 0.5, 15.0, 40.0, 25.0), (1, 0, 4, 95.0, 0.0, 99.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, no int, x0 double, y0 double, x1 double, y1 double")
    df = df.withColumn("rotation", F.lit(0)).withColumn("size", F.lit(10.0)).withColumn("oy", F.col("y1"))
    assert {r.no: r.left for r in geometry.left_neighbours(df).collect()} == {2: 1, 4: 2}
    assert {(r.no, r.other) for r in geometry.aligned(df).collect()} == {(1, 3), (3, 1)}
    area = spark.createDataFrame([(1, 0, 7, 0.0, 0.0, 45.0, 12.0)], "doc_id long, page int, seg_id int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.no, r.seg_id) for r in geometry.inside(df, area).collect()] == [(1, 7)]
    parts = [(1, 0, 1, 0.0, 10.0, False, False), (1, 0, 2, 12.0, 20.0, True, False), (1, 0, 3, 25.0, 30.0, False, False), (1, 0, 4, 60.0, 70.0, True, False), (1, 0, 5, 61.0, 65.0, True, True)]
    f = spark.createDataFrame(parts, "doc_id long, page int, seg_id int, x0 double, x1 double, formula boolean, frame boolean").withColumn("y0", F.lit(0.0)).withColumn("y1", F.lit(10.0)).withColumn("size", F.lit(10.0))
    assert {(r.seg_id, r.lead) for r in geometry.formula_groups(f).collect()} == {(1, 2), (2, 2), (3, 2)}


def test_streams(spark, tmp_path):
    rows = [(1, 1, datetime(2024, 1, 1, 8)), (1, 1, datetime(2024, 1, 1, 9)), (1, 2, datetime(2024, 1, 2, 9)), (2, 1, datetime(2024, 1, 5, 9))]
    spark.createDataFrame(rows, "user_id int, card int, ts timestamp_ntz").write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema("user_id int, card int, ts timestamp_ntz").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    days = {(r.user_id, str(r.day), r.n) for r in run(stream.study_days(log), "days", "complete")}
    assert days == {(1, "2024-01-01", 2), (1, "2024-01-02", 1), (2, "2024-01-05", 1)}
    assert {(r.user_id, r.card) for r in run(stream.new_words(log), "fresh", "append")} == {(1, 1), (1, 2), (2, 1)}
