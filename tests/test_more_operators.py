"""Edge cases of selections, layout, Markdown and further exchange functions."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from sparkloom.functions import arrays, stopwords
from sparkloom.functions import text as fn
from sparkloom.operators import geometry, lines, reconcile, selection, study
from sparkloom.sources import exchange, markdown

from .test_operators import one


def test_text_functions(spark):
    code = lambda x: one(spark, fn.language_code(F.col("x")), x=x)
    assert [code(x) for x in ("de-AT", "German (Austria)", "Klingon!", "")] == ["de", "de", "klingon", ""]
    gap = lambda s, w: one(spark, fn.cloze(F.col("s"), F.col("w")), s=s, w=w)
    assert gap("The house, a House.", "the house (n)") == "The _____, a _____." and gap("Sie wohnten dort", "wohnen") == "Sie _____ dort"
    assert gap("我喜欢书", "书 (shū)") == "我喜欢_____" and gap("a+b c", "a+b") == "_____ c" and gap("cat", "dog") == "cat"
    entry = one(spark, fn.contents_entry(F.col("x")), x="2.1  Results ....... xiv")
    assert (entry.title, entry.page) == ("2.1 Results", "xiv") and one(spark, fn.contents_entry(F.col("x")), x="1234 ..... 7") is None
    assert one(spark, fn.script_text(F.col("x"), F.lit(5.0), F.lit(3.0), F.lit(10.0)), x="-2") == "⁻²"
    assert one(spark, fn.script_text(F.col("x"), F.lit(5.0), F.lit(-1.0), F.lit(10.0)), x="2a") == "2a"
    assert one(spark, fn.with_language(F.col("x"), "de"), x="<html xml:lang='en' lang=\"en\"><p/>") == '<html lang="de" xml:lang="de"><p/>'
    assert one(spark, fn.font_family(F.col("x"), F.lit(False), F.lit(True)), x="Foo") == "serif"
    assert one(spark, fn.prose_words(F.col("x")), x="sin x of the αβγ aβc word") == 4
    text = "le chat est dans la maison avec " * 6
    assert one(spark, fn.latin_language(F.col("x"), stopwords.STOP), x=text) == "fr" and one(spark, fn.latin_language(F.col("x"), stopwords.STOP), x="le la") is None


def test_selections(spark):
    rows = [(1, 0, False, None, "Alpha", "x"), (2, 0, True, None, "12", None), (3, 1, False, "note", "beta", " "), (4, 1, False, None, "gamma", None)]
    segs = spark.createDataFrame(rows, "id int, page int, skip boolean, extra string, text string, target string")
    hidden = spark.createDataFrame([(4,)], "id int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(selection.translatable(segs, hidden)) == [1, 3]
    assert ids(selection.listed(segs, hidden, status="numbers")) == [2] and ids(selection.listed(segs, hidden, status="todo")) == [3] and ids(selection.listed(segs, hidden, status="done")) == [1]
    assert ids(selection.listed(segs, hidden, page=1, status="extra")) == [3] and ids(selection.listed(segs, hidden, pattern=lines.search_pattern("ALPHA"))) == [1]
    assert ids(selection.asked(segs, 2, 9, only_todo=True)) == [3, 4]
    words = [(1, 0, 0, "Hello", 90.0), (1, 0, 0, "wor", 20.0), (1, 0, 0, "|", 95.0), (1, 0, 0, "--", 50.0), (1, 0, 1, "xy", 20.0), (1, 0, 2, "—", 90.0)]
    got = selection.read_words(spark.createDataFrame(words, "doc_id int, page int, line int, text string, conf double"))
    assert sorted(r.text for r in got.collect()) == ["Hello", "wor"]
    files = spark.createDataFrame([(0, 3), (1, 0), (2, 5)], "ord int, todo int")
    assert selection.next_file(files, 0).first().ord == 2 and selection.next_file(files, 2).first().ord == 0


def test_repeats_follow_their_lead(spark):
    rows = [("a", "once", 1, "Page 1", "Seite 1"), ("a", "once", 2, "Page 2", None), ("b", "keep", 3, "x", "y"), ("c", "each", 4, "z", "q"), ("c", "each", 5, "z", None), ("d", "once", 6, "p", " "), ("d", "once", 7, "p", "old")]
    got = lines.synced(spark.createDataFrame(rows, "key string, mode string, id int, text string, target string"))
    assert {r.id: r.target for r in got.collect()} == {2: "Seite 2", 3: "", 7: ""}


def test_lists_and_decks(spark):
    schema = "term string, translation string, example string, example_tr string"
    have = spark.createDataFrame([("Haus", "house", "ex", "")], schema)
    new = spark.createDataFrame([("haus ", "home", "", "e", 0), ("Baum", "tree", "", "", 1), (" ", "x", "", "", 2)], schema + ", ord int")
    assert {r.term: tuple(r)[1:] for r in study.merge_keywords(have, new).collect()} == {"Haus": ("home", "ex", "e"), "Baum": ("tree", "", "")}
    t = datetime(2024, 1, 1)
    v = spark.createDataFrame([("de-en", w, "t", "", "", t, 1, 0, None, False) for w in ("a", "b")], study.VOCABULARY)
    moved = study.moved(v, spark.createDataFrame([("a",)], "term string"), "de-en", "de-fr", F.lit(t))
    assert sorted((r.pair, r.term) for r in moved.collect()) == [("de-en", "b"), ("de-fr", "a")]
    deck = lambda *w: spark.createDataFrame([(x,) for x in w], "term string")
    assert study.deck_added(deck("a", "b", "c"), v).first().added and not study.deck_added(deck("a", "c", "d", "e"), v).first().added
    rows = spark.createDataFrame([("a\tb", "c", "x\ny", "", 1)], schema + ", ord int")
    assert [r.text for r in exchange.deck_text(rows, "D", "t").orderBy("ord").collect()][-1] == "a b<br><i>x<br>y</i>\tc\tt"


def test_layout(spark):
    spans = spark.createDataFrame([(1, 0, 0, 0, "foo", 0.0, 10.0), (1, 0, 0, 1, "bar", 12.0, 20.0), (1, 0, 0, 2, "baz", 20.5, 30.0)], "doc_id int, page int, line int, pos int, text string, x0 double, x1 double").withColumn("size", F.lit(10.0))
    assert geometry.spaced_text(spans).first().text == "foo barbaz"
    assert one(spark, geometry.typical_gap(F.array(F.lit(0.2), F.lit(0.9), F.lit(0.4))), x=1) == 0.4
    st = spark.createDataFrame([(1, 0, "Note 1:", False), (1, 1, "text", True), (2, 0, "bold", False), (3, 0, "a", False), (3, 1, "b", True)], "seg int, pos int, text string, base boolean")
    assert [(r.seg, r.words) for r in geometry.styled_start(st, "seg").collect()] == [(1, "Note 1:")]
    w = spark.createDataFrame([(1, 1, 0, "plain word", "n", "n"), (1, 1, 1, "word new", "b", "n")], "doc_id int, seg_id int, pos int, text string, style string, main string")
    assert [(r.word, r.style) for r in geometry.odd_words(w).collect()] == [("new", "b")]
    seg = spark.createDataFrame([(1, 0, 5, 100.0, 0.0, 200.0, 10.0, 10.0)], "doc_id int, page int, seg_id int, x0 double, y0 double, x1 double, y1 double, size double")
    edge = spark.createDataFrame([(1, 0, 300.0, 0.0, 310.0, 10.0), (1, 0, 250.0, 50.0, 260.0, 60.0)], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    r = geometry.free_span(seg, edge, 500.0).first()
    assert (r.left, r.right) == (20.0, 296.0)
    para = [("j", 0, 50.0, 400.0), ("j", 1, 50.0, 401.0), ("j", 2, 50.0, 200.0), ("r", 0, 100.0, 400.0), ("r", 1, 150.0, 400.0), ("c", 0, 200.0, 300.0), ("c", 1, 150.0, 350.0), ("s", 0, 200.0, 300.0)]
    al = spark.createDataFrame(para, "p string, no int, x0 double, x1 double")
    for k, x in (("size", 10.0), ("left", 50.0), ("right", 450.0), ("width", 500.0)):
        al = al.withColumn(k, F.lit(x))
    assert {r.p: r.align for r in geometry.alignment(al.withColumn("rotation", F.lit(0)), "p").collect()} == {"j": "justify", "r": "right", "c": "center", "s": "center"}


MARKDOWN = {
    "---\na: b\n---\n# Title #\nsome\ntext\n\n```\ncode\n```\n- one\n  more\n- [x] two\n> quoted": [
        ("h", 1, "Title"), ("p", 0, "some\ntext"), ("li", 0, "one\n  more"), ("li", 0, "two"), ("quote", 0, "quoted"),
    ],
    "|a|b|\n|---|---|\n|c \\| d|e|\n\nx | y\n:--- | ---:\nz | w": [("td", 0, v) for v in ("a", "b", "c \\| d", "e", "x", "y", "z", "w")],
    "<div>\n# no\n</div>\n\n[x]: y\n***\n* * *\nUnder\n=====\ntwo\nlines\n---\n---\nend": [("h", 1, "Under"), ("h", 2, "two\nlines"), ("p", 0, "end")],
    "~~~py\n```\n# no\n~~~\n1. n\n   ```\n   in\n2) m\n  * k\n###### six ##\n####### seven\n    > deep": [
        ("li", 0, "n\n   ```\n   in"), ("li", 0, "m"), ("li", 0, "k"), ("h", 6, "six"), ("p", 0, "####### seven"), ("quote", 0, "deep"),
    ],
    "---\nno end of front matter": [("p", 0, "no end of front matter")], "```\nopen to the end\n# no": [], "a\r\nb\r\rc": [("p", 0, "a\nb"), ("p", 0, "c")],
    "para\n# head\nmore\n- item\n\n  late": [("p", 0, "para"), ("h", 1, "head"), ("p", 0, "more"), ("li", 0, "item"), ("p", 0, "late")],
    "": [], "\n \n": [],
}


def test_markdown(spark):
    rows = [*enumerate(MARKDOWN), (99, None)]
    got = {}
    for r in markdown.segments(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.no, r.tag, r.level, r.text))
    for i, want in enumerate(MARKDOWN.values()):
        assert [x[1:] for x in sorted(got.get(i, []))] == want and [x[0] for x in sorted(got.get(i, []))] == list(range(len(want)))
    assert 99 not in got


def test_long_markdown(spark):
    text = "\n".join(f"# h{i}\n- item {i}\n  more\n> q" for i in range(5000))
    assert markdown.segments(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 15000


def test_files_of_ids_across_slots(spark):
    """Large and empty files, ids in no file, and slots that no file starts in."""
    sizes = [3, 0, 200_000, 5, 70_000, 1, 0]
    files = spark.createDataFrame([(i * 40_000, 100 + i, n) for i, n in enumerate(sizes)], "ord long, file_id long, max_id long")
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    assert {r.file_id: r.offset for r in reconcile.offsets(files).collect()} == {100 + i: s for i, s in enumerate(starts)}
    ids = [0, 1, 3, 4, 5, 65_536, 131_072, 200_003, 200_004, 200_008, 200_009, 270_008, 270_009, 270_010, 900_000]
    want = {g: next(((100 + i, g - s) for i, (s, n) in enumerate(zip(starts, sizes)) if s < g <= s + n), (None, None)) for g in ids}
    got = reconcile.to_file(spark.createDataFrame([(g,) for g in [*ids, *ids]], "gid long"), files).collect()
    assert {r.gid: (r.file_id, r.id) for r in got} == want and len(got) == len(ids)


def test_tags_that_close_before_they_open(spark):
    for target, want in (("<1>a</1>", (0, 0)), ("</1>a<1>", (0, 1)), ("<1>a", (1, 1)), ("a</1>", (1, 1)), ("<1><1>a</1>", (0, 0)), ("<2/>", (2, 1))):
        assert tuple(one(spark, reconcile.marker_issues(F.lit("<1></1>"), F.col("x")), x=target)) == want


def test_cut_of_long_texts(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abc🙂é\n") for _ in range(5000))
    spans = [(rng.randrange(5000), rng.randrange(3000)) for _ in range(200)] + [(0, 5000), (1023, 1), (1024, 1024), (4999, 1), (7, 0)]
    df = spark.createDataFrame([(text, a, min(n, 5000 - a)) for a, n in spans], "text string, a int, n int")
    for r in df.select("a", "n", arrays.cut(arrays.pieces(F.col("text")), F.col("a"), F.col("n")).alias("got")).collect():
        assert r.got == text[r.a : r.a + r.n]


def test_running_maximum(spark):
    rng = random.Random(4)
    values = [rng.randrange(10**6) for _ in range(1000)]
    made = arrays.running(F.col("v"), lambda x: x, F.greatest, lambda before, x: before, "int")
    got = spark.createDataFrame([(values,), ([],)], "v array<int>").select(made.alias("m")).collect()
    assert got[0].m == [max(values[:i], default=0) for i in range(1000)] and got[1].m == []


def test_any_format(spark):
    rows = [("a.txt", "[[1]]\nx"), ("b.json", '{"2": "y"}'), ("c.csv", "id,target\n3,z"), ("d", '<?xml?><xliff><trans-unit id="4"><target>w</target></trans-unit></xliff>'), ("e", "[[5]] in")]
    got = exchange.read_any(spark.createDataFrame(rows, "file string, text string"))
    assert {r.id: r.target for r in got.collect()} == {1: "x", 2: "y", 3: "z", 4: "w", 5: "in"}
    assert one(spark, exchange.keyword_block(F.col("x")), x="a\n[[Keywords]]\nb = c\nd = e\n[[3]]\nf") == "b = c\nd = e"
    files = spark.createDataFrame([("f", "hello world"), ("g", "same")], "file string, text string")
    edits = spark.createDataFrame([("f", 6, 11, "you"), ("f", 0, 1, "J")], "file string, start int, end int, value string")
    assert {r.file: r.text for r in exchange.spliced(edits, files).collect()} == {"f": "Jello you", "g": "same"}


def test_places_of_segments():
    """A repeat further on is left to the segment it belongs to, short texts are not looked for far away."""
    assert reconcile.places("onetwothree", ["one", "two", "three"]) == [(0, 0), (1, 3), (2, 6)]
    assert reconcile.places("chaptertextchapter", ["chapter", "missing", "text", "chapter"]) == [(0, 0), (2, 7), (3, 11)]
    assert reconcile.places("axxxxxxxxbxxxxxxxxa", ["a", "xxxxxxxxb", "a"]) == [(0, 0), (1, 1), (2, 18)]
    assert reconcile.places("intro" + "body" * 20 + "title", ["title", "intro"]) == [(1, 0)]
    assert reconcile.places("start" + "x" * 5000 + "short", ["start", "short"]) == [(0, 0)]
    long = "y" * 100 + "end"
    assert reconcile.places("z" * 5000 + long, [long]) == [(0, 5000)]
