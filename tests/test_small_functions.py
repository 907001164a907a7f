"""Boxes, paths, entities, encodings and inline markers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import boxes
from sparkloom.functions import text as fn
from sparkloom.operators import reconcile, study
from sparkloom.sources import exchange

from .test_operators import one, read


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (fn.entities_decoded, "a &amp; b&#233;&#x1F600;&#1;&copy;&foo; &lt;", "a & bé😀©&foo; <"),
        (fn.latex_cleaned, "```latex\n\\[ x^2 \\]\n```", "x^2"),
        (fn.latex_cleaned, "$$\\begin{equation*} y \\end{equation*}$$", "y"),
        (fn.script_json, '{"a": "</script>"}', '{"a": "\\u003c/script>"}'),
    ],
)
def test_texts(spark, f, value, want):
    assert one(spark, f(F.col("x")), x=value) == want


def test_paths(spark):
    f = lambda b, h: one(spark, fn.resolved_path(F.col("b"), F.col("h")), b=b, h=h)
    assert f("o/text/a.xhtml", "../img/x%20y.png#p") == "o/img/x y.png" and f("a.xml", "../../b.xml") == "b.xml" and f("o/a", "./c+d") == "o/c+d"


def test_encodings(spark):
    rows = [("é", b"\xef\xbb\xbf\xc3\xa9"), ("é", "é".encode("utf-16-le")), ("é", "\ufeffé".encode("utf-16-be")), ("é", b"\xe9"), ("é", b"\xc3\xa9"), ("", b"")]
    rows[1] = ("é", b"\xff\xfe" + rows[1][1])
    df = spark.createDataFrame(rows, "want string, content binary")
    assert all(r.want == r.got for r in df.select("want", fn.decoded(F.col("content")).alias("got")).collect())


def test_boxes(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    b = F.struct(*(F.lit(v).alias(k) for k, v in (("x0", 10.0), ("y0", 20.0), ("x1", 30.0), ("y1", 25.0))))
    got = spark.range(1).select(
        boxes.view(lit(0, 1, -1, 0, 100, 0), b, F.lit(100.0), F.lit(50.0)).alias("v"), boxes.local(b, F.lit(90)).alias("l"), boxes.hsl(*lit(255, 128, 0)).alias("h"),
        boxes.hex_parts(*lit(300, 15.6, -1)).alias("x"), F.array(*boxes.multiplied(lit(1, 0, 0, 1, 5, 6), lit(0, 1, -1, 0, 0, 0))).alias("m"), F.array(*boxes.applied(boxes.turned(F.lit(90.0)), lit(1, 0))).alias("t"),
    ).first()
    assert tuple(got.v) == (0.75, 0.2, 0.8, 0.6) and tuple(got.l) == (-25.0, 10.0, -20.0, 30.0)
    assert got.h.h == pytest.approx(0.0837, abs=1e-3) and got.h.s == 1.0 and got.x == "#ff1000" and got.m == [0.0, 1.0, -1.0, 0.0, 5.0, 6.0]
    assert got.t == pytest.approx([0.0, 1.0])


def test_inline_markers(spark):
    f = lambda x: read(spark, exchange.read_markers_inline, x)
    assert f("[[1]] one [[2]] two [1] see [[1]] x\n[[5]]\nfive\n**((6))** six") == {1: "one", 2: "two [1] see [[1]] x", 5: "five", 6: "six"}
    assert f("\\[\\[3\\]\\] a\\*b") == {3: "a*b"} and f("«<1> x") == {} and f("no marker") == {} and f("[[2]]\nb\n[[1]]\na") == {1: "a", 2: "b"}


def test_choices(spark):
    segs = spark.createDataFrame([(1, True, True, 9.0), (2, False, False, 9.0), (3, True, False, 9.0)], "id int, skip boolean, formula boolean, size double")
    chosen = spark.createDataFrame([(1, "text"), (2, "formula")], "id int, kind string")
    assert {r.id: (r.skip, r.formula) for r in reconcile.kinds(segs, chosen).collect()} == {1: (False, False), 2: (True, True), 3: (True, False)}
    over = spark.createDataFrame([(2, 12.0), (3, None)], "id int, size double")
    assert {r.id: r["size"] for r in reconcile.overridden(segs, over, "size").collect()} == {1: 9.0, 2: 12.0, 3: 9.0}
    targets = spark.createDataFrame([(1, "x"), (2, " ")], "id int, target string")
    assert reconcile.done_count(segs, targets, spark.createDataFrame([(3,)], "id int")).first().done == 2
    groups, latex = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "seg_id int, lead int"), spark.createDataFrame([(1, "x"), (3, "")], "id int, latex string")
    assert [r.id for r in reconcile.unread_formulas(groups, latex).collect()] == [3]


def test_backups(spark):
    t = datetime(2024, 1, 1)
    v = spark.createDataFrame([("de-en", "Haus", "house", "", "", t, 1, 2, t, True), ("de-fr", "Baum", "arbre", "", "", t, 1, 0, None, False)], study.VOCABULARY)
    back = exchange.read_backup(exchange.backup(v).unionByName(spark.createDataFrame([("x", "no json")], "pair string, text string")), study.VOCABULARY)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, v.collect()), key=str)
