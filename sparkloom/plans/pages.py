"""Boxes of pages. Orders are pages and their lines boxes: quantity gives the left edge, discount the top, tax the width. All boxes of a page have a number
of their own, by line number and part."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import geometry as ops
from ..sources.tables import table
from .registry import query

BOXES_SQL = """b AS (SELECT l_orderkey AS doc_id, 0 AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS no, l_linenumber, l_partkey,
  l_quantity * 8 AS x0, l_quantity * 8 + 10 + round(l_tax * 100) * 10 AS x1, round(l_discount * 100) * 6 AS y0, round(l_discount * 100) * 6 + 12 AS y1, 10.0::DOUBLE AS size FROM lineitem)"""


def boxes(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    no = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    left, top = F.col("l_quantity") * 8, F.round(F.col("l_discount") * 100) * 6
    return l.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), no.alias("no"), "l_linenumber", "l_partkey", left.alias("x0"), (left + 10 + F.round(F.col("l_tax") * 100) * 10).alias("x1"),
        top.alias("y0"), (top + 12).alias("y1"), F.lit(10.0).alias("size"), F.lit(0).alias("rotation"), (top + 10).alias("oy"),
    )


@query(
    f"""WITH {BOXES_SQL}, p AS (SELECT a.doc_id, a.page, a.no, b.no AS other, b.x1 FROM b a JOIN b ON a.doc_id = b.doc_id AND a.no <> b.no WHERE b.x1 <= a.x0 AND b.y0 + 3 < a.y1 - 3 AND a.y0 + 3 < b.y1 - 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, no ORDER BY x1 DESC, other) AS r FROM p) SELECT doc_id, page, no, other AS "left" FROM r WHERE r = 1"""
)
def left_neighbours(spark, sf_dir):
    return ops.left_neighbours(boxes(spark, sf_dir))


@query(
    f"""WITH {BOXES_SQL} SELECT a.doc_id, a.page, a.no, b.no AS other FROM b a JOIN b ON a.doc_id = b.doc_id AND a.no <> b.no WHERE abs(a.x0 - b.x0) <= 1.5 AND abs(a.y0 - b.y0) BETWEEN 5 AND 35"""
)
def aligned_lines(spark, sf_dir):
    return ops.aligned(boxes(spark, sf_dir))


AREAS_SQL = "q AS (SELECT DISTINCT l_orderkey AS doc_id, 0 AS page, CAST(i AS INTEGER) AS seg_id, i * 100.0 AS x0, i * 100.0 + 100 AS x1, 0.0 AS y0, 30.0 AS y1 FROM lineitem, generate_series(0, 4) AS g(i))"


def areas(spark, sf_dir):
    """Five columns in the upper half of a page."""
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()
    return keys.select("doc_id", F.lit(0).alias("page"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seg_id")).select(
        "doc_id", "page", "seg_id", (F.col("seg_id") * 100.0).alias("x0"), (F.col("seg_id") * 100.0 + 100).alias("x1"), F.lit(0.0).alias("y0"), F.lit(30.0).alias("y1")
    )


@query(f"WITH {BOXES_SQL}, {AREAS_SQL} SELECT b.doc_id, b.page, b.no, q.seg_id FROM b JOIN q USING (doc_id) WHERE (b.x0 + b.x1) / 2 BETWEEN q.x0 - 1 AND q.x1 + 1 AND (b.y0 + b.y1) / 2 BETWEEN q.y0 - 1 AND q.y1 + 1")
def lines_inside(spark, sf_dir):
    return ops.inside(boxes(spark, sf_dir), areas(spark, sf_dir))


@query(f"WITH {BOXES_SQL} SELECT doc_id, page, round(min(x0), 2) AS x0, round(min(y0), 2) AS y0, round(max(x1), 2) AS x1, round(max(y1), 2) AS y1 FROM b GROUP BY doc_id, page")
def page_boxes(spark, sf_dir):
    return ops.boxes(boxes(spark, sf_dir), "doc_id", "page")


@query(f'WITH {BOXES_SQL} SELECT doc_id, page, min(x0) AS "left", max(x1) AS "right" FROM b WHERE no % 4 <> 0 GROUP BY doc_id, page')
def text_margins(spark, sf_dir):
    """Every fourth line is turned."""
    return ops.margins(boxes(spark, sf_dir).withColumn("rotation", F.when(F.col("no") % 4 == 0, 90).otherwise(0)))


@query(
    """WITH g AS (SELECT l_orderkey AS doc_id, list_sort(list(round(l_discount * 10, 2)) FILTER (WHERE round(l_discount * 10, 2) < 0.8)) AS g FROM lineitem GROUP BY l_orderkey)
SELECT doc_id, CASE WHEN len(g) > 0 THEN g[CAST(floor(len(g) / 2) AS INTEGER) + 1] ELSE CAST(0.3 AS DOUBLE) END AS gap FROM g"""
)
def word_gaps(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.round(F.col("l_discount") * 10, 2)).alias("g"))
    return own.select("doc_id", ops.typical_gap(F.col("g")).alias("gap"))


@query(
    f"""WITH {BOXES_SQL}, e AS (SELECT doc_id, x0, x1, y0, y1 FROM b WHERE no % 2 = 0), s AS (SELECT * FROM b WHERE no % 2 = 1),
j AS (SELECT s.doc_id, s.page, s.no, s.x0, s.x1, max(CASE WHEN e.x1 <= s.x0 + 0.5 THEN e.x1 + 4 END) AS l, min(CASE WHEN e.x0 >= s.x1 - 0.5 THEN e.x0 - 4 END) AS r
  FROM s LEFT JOIN e ON e.doc_id = s.doc_id AND e.y1 >= s.y0 + 2.4 AND e.y0 <= s.y1 - 2.4 GROUP BY ALL)
SELECT doc_id, page, no AS seg_id, least(x0, greatest(coalesce(l, 20), 20)) AS "left", greatest(x1, least(coalesce(r, 480), 480)) AS "right" FROM j"""
)
def free_spans(spark, sf_dir):
    """How far odd boxes may grow between even ones on a page 500 wide."""
    b = boxes(spark, sf_dir)
    return ops.free_span(b.where("no % 2 = 1").withColumnRenamed("no", "seg_id"), b.where("no % 2 = 0"), 500)


@query(
    f"""WITH {BOXES_SQL}, n AS (SELECT *, lead(x0) OVER w AS u0, lead(x1) OVER w AS u1, lead(y0) OVER w AS v0, lead(y1) OVER w AS v1 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
o AS (SELECT *, x1 <= u0 + 1 OR u1 <= x0 + 1 AS side, CASE WHEN x1 <= u0 + 1 THEN x1 ELSE u1 END AS g0, CASE WHEN x1 <= u0 + 1 THEN u0 ELSE x0 END AS g1, (greatest(y0, v0) + least(y1, v1)) / 2 AS mid,
  CASE WHEN y0 <= v0 THEN y1 ELSE v1 END - 2.4 AS top, CASE WHEN y0 <= v0 THEN v0 ELSE y0 END + 2.4 AS bottom, greatest(x0, u0) AS l, least(x1, u1) AS r FROM n WHERE u0 IS NOT NULL)
SELECT doc_id, no, CASE WHEN side THEN 200 BETWEEN least(g0, g1) - 0.5 AND greatest(g0, g1) + 0.5 AND mid BETWEEN 0 AND 40 ELSE r > l AND 30 BETWEEN top AND bottom AND 0 < r - 1 AND 500 > l + 1 END AS divided FROM o"""
)
def divided_boxes(spark, sf_dir):
    """Whether an upright rule at 200, down to 40, or a flat one at 30 runs between a box and the next."""
    rule = lambda *v: F.struct(*(F.lit(float(x)).alias(k) for k, x in zip(("x0", "y0", "x1", "y1"), v)))
    order = Window.partitionBy("doc_id").orderBy("no")
    b = boxes(spark, sf_dir)
    names = ("x0", "y0", "x1", "y1")
    rows = b.select("doc_id", "no", *names, *(F.lead(c).over(order).alias(f"n_{c}") for c in names)).where("n_x0 is not null")
    cut = ops.divided({c: F.col(c) for c in names}, {c: F.col(f"n_{c}") for c in names}, F.array(rule(199, 0, 201, 40), rule(0, 29.5, 500, 30.5)))
    return rows.select("doc_id", "no", cut.alias("divided"))


SPANS_SQL = "w AS (SELECT l_orderkey AS doc_id, 0 AS page, l_linenumber % 2 AS line, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, CASE WHEN l_partkey % 5 = 0 THEN 'w' || l_partkey || ' ' ELSE 'w' || l_partkey END AS text, l_quantity FROM lineitem)"


def spans(spark, sf_dir):
    order = Window.partitionBy("l_orderkey", F.col("l_linenumber") % 2).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    text = F.concat(F.lit("w"), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 5 == 0, " ").otherwise(""))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), (F.col("l_linenumber") % 2).alias("line"), F.row_number().over(order).alias("pos"), text.alias("text"), "l_quantity")


@query(
    f"""WITH {SPANS_SQL}, p AS (SELECT *, pos * 100 AS x0, pos * 100 + 50 + l_quantity AS x1 FROM w), g AS (SELECT *, x0 - lag(x1) OVER o > 1.5 AND NOT suffix(lag(text) OVER o, ' ') AS blank FROM p WINDOW o AS (PARTITION BY doc_id, line ORDER BY pos))
SELECT doc_id, page, line, string_agg(CASE WHEN blank THEN ' ' || text ELSE text END, '' ORDER BY pos) AS text FROM g GROUP BY doc_id, page, line"""
)
def spaced_lines(spark, sf_dir):
    """Blanks put in where spans stand apart."""
    s = spans(spark, sf_dir).select("*", (F.col("pos") * 100).alias("x0"), (F.col("pos") * 100 + 50 + F.col("l_quantity")).alias("x1"), F.lit(10.0).alias("size"))
    return ops.spaced_text(s)


@query(
    f"""WITH {SPANS_SQL}, f AS (SELECT *, min(CASE WHEN l_quantity > 20 THEN pos END) OVER (PARTITION BY doc_id, line) AS base FROM w),
l AS (SELECT doc_id, line, string_agg(trim(text), ' ' ORDER BY pos) AS words, count(*) AS n FROM f WHERE pos < base GROUP BY doc_id, line) SELECT doc_id, line, words FROM l WHERE n <= 4"""
)
def styled_starts(spark, sf_dir):
    """Light spans before the first heavy one; every word has a digit."""
    s = spans(spark, sf_dir).withColumns({"base": F.col("l_quantity") > 20, "text": F.trim("text")})
    return ops.styled_start(s, "doc_id", "line").select("doc_id", "line", "words")


@query(
    f"""WITH {SPANS_SQL}, s AS (SELECT doc_id, line, pos, 'w' || (CAST(l_quantity AS BIGINT) % 9) AS word, CAST(l_quantity AS BIGINT) % 3 AS style FROM w),
f AS (SELECT doc_id, line, word, arg_min(style, pos) AS style FROM s WHERE style <> 0 GROUP BY doc_id, line, word)
SELECT doc_id, CAST(line AS INTEGER) AS seg_id, word, style FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = f.doc_id AND s.line = f.line AND s.word = f.word AND s.style = 0)"""
)
def odd_words(spark, sf_dir):
    """Words in another style than the main one that never occur in it."""
    q = F.col("l_quantity").cast("long")
    s = spans(spark, sf_dir).select("doc_id", F.col("line").cast("int").alias("seg_id"), F.concat(F.lit("w"), (q % 9).cast("string")).alias("text"), (q % 3).alias("style"), F.lit(0).alias("main"), "pos")
    return ops.odd_words(s)


@query(
    f"""WITH RECURSIVE {BOXES_SQL.replace('0 AS page', 'CAST(0 AS INTEGER) AS page')}, k AS (SELECT *, l_partkey % 3 = 0 AS formula, l_partkey % 11 = 0 AS frame FROM b),
e AS (SELECT a.doc_id, a.no AS a, b.no AS b FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.no <> b.no WHERE (a.formula OR b.formula) AND NOT a.frame AND NOT b.frame AND greatest(greatest(a.x0, b.x0) - least(a.x1, b.x1), greatest(a.y0, b.y0) - least(a.y1, b.y1)) < 8),
r(doc_id, a, b) AS (SELECT doc_id, a, b FROM e UNION SELECT r.doc_id, r.a, e.b FROM r JOIN e ON r.doc_id = e.doc_id AND r.b = e.a),
m AS (SELECT doc_id, a AS no, b FROM r UNION SELECT doc_id, a, a FROM r)
SELECT m.doc_id, CAST(0 AS INTEGER) AS page, m.no AS seg_id, min(k.no) AS lead FROM m JOIN k ON k.doc_id = m.doc_id AND k.no = m.b WHERE k.formula GROUP BY m.doc_id, m.no"""
)
def formula_groups(spark, sf_dir):
    """Boxes that hang together through formulas; parts that three divides are formulas, those that eleven divides frames."""
    b = boxes(spark, sf_dir).withColumnRenamed("no", "seg_id").withColumns({"formula": F.col("l_partkey") % 3 == 0, "frame": F.col("l_partkey") % 11 == 0})
    return ops.formula_groups(b.select("doc_id", "page", "seg_id", "x0", "x1", "y0", "y1", "size", "formula", "frame"))


@query(
    """WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 AS kind FROM orders)
SELECT doc_id, CASE kind WHEN 0 THEN 'justify' WHEN 1 THEN 'right' WHEN 2 THEN 'center' WHEN 3 THEN 'left' ELSE 'center' END AS align FROM o"""
)
def alignments(spark, sf_dir):
    """Paragraphs laid out by kind: full lines with a short last one, flush right, centred, flush left, one centred line."""
    lines = {0: ((50, 400), (50, 401), (50, 200)), 1: ((100, 400), (150, 400)), 2: ((200, 300), (150, 350)), 3: ((50, 390), (50, 300)), 4: ((200, 300),)}
    made = F.lit(None).cast("array<struct<no:int,x0:double,x1:double>>")
    for kind, rows in lines.items():
        made = F.when(F.col("doc_id") % 5 == kind, F.array(*(F.struct(F.lit(i).alias("no"), F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1")) for i, (a, b) in enumerate(rows)))).otherwise(made)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).select("doc_id", F.inline(made))
    laid = o.withColumns({"size": F.lit(10.0), "left": F.lit(50.0), "right": F.lit(450.0), "width": F.lit(500.0), "rotation": F.lit(0)})
    return ops.alignment(laid, "doc_id")
