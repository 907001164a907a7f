"""Lines and boxes of pages: chunks, paragraphs, styles, neighbours, columns and formula groups.

Boxes are x0, y0, x1, y1 with y downwards. All windows and joins stay inside a page, the unit that bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page")


def divided(a: dict[str, Column], b: dict[str, Column], rules: Column) -> Column:
    """Whether one of the ``rules`` (array of struct x0, y0, x1, y1) runs between two boxes of horizontal text."""
    side = (a["x1"] <= b["x0"] + 1) | (b["x1"] <= a["x0"] + 1)
    ends = (F.when(a["x1"] <= b["x0"] + 1, a["x1"]).otherwise(b["x1"]), F.when(a["x1"] <= b["x0"] + 1, b["x0"]).otherwise(a["x0"]))
    lo, hi, mid = F.least(*ends), F.greatest(*ends), (F.greatest(a["y0"], b["y0"]) + F.least(a["y1"], b["y1"])) / 2
    upright = lambda r: (r["x1"] - r["x0"] < 3) & ((r["x0"] + r["x1"]) / 2).between(lo - 0.5, hi + 0.5) & mid.between(r["y0"], r["y1"])
    first = a["y0"] <= b["y0"]
    pick = lambda k: (F.when(first, a[k]).otherwise(b[k]), F.when(first, b[k]).otherwise(a[k]))
    (up0, low0), (up1, low1) = pick("y0"), pick("y1")
    top, bottom = up1 - 0.2 * (up1 - up0), low0 + 0.2 * (low1 - low0)
    left, right = F.greatest(a["x0"], b["x0"]), F.least(a["x1"], b["x1"])
    flat = lambda r: (r["y1"] - r["y0"] < 3) & ((r["y0"] + r["y1"]) / 2).between(top, bottom) & (r["x0"] < right - 1) & (r["x1"] > left + 1)
    return F.coalesce(F.when(side, F.exists(rules, upright)).otherwise((right > left) & F.exists(rules, flat)), F.lit(False))


def chunks(spans: DataFrame) -> DataFrame:
    """Adds chunk: a line's spans (by pos) are cut where the gap is over twice the larger size or a rule stands between.

    Spans of white space are left out. Needs doc_id, page, line, pos, text, size, the box, and rules.
    """
    order = Window.partitionBy(*PAGE, "line").orderBy("pos")
    rows = spans.where(F.trim("text") != "")
    before = {k: F.lag(k).over(order) for k in ("x0", "y0", "x1", "y1")}
    rows = rows.select("*", *(v.alias(f"_{k}") for k, v in before.items()), F.lag("size").over(order).alias("_size"))
    gap = F.col("x0") - F.col("_x1")
    a, b = {k: F.col(f"_{k}") for k in before}, {k: F.col(k) for k in before}
    cut = (gap > 2 * F.greatest("size", "_size")) | ((gap > 0) & divided(a, b, F.col("rules")))
    rows = rows.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    return rows.withColumn("chunk", F.sum("_cut").over(order)).drop("_cut", "_size", *(f"_{k}" for k in before))


BULLET = "^\\s*(?:[•·◦▪–—*-]|\\d{1,3}[.)])\\s"


def paragraphs(lines: DataFrame, *within: str) -> DataFrame:
    """Adds paragraph: lines (by no, inside ``within``) that follow each other as one text.

    A new one begins at another rotation, at sizes that differ by more than a quarter, at a pitch over
    twice the larger size, at a bullet, and around standalone lines. Needs no, text, oy, size, rotation, standalone.
    """
    order = Window.partitionBy(*within).orderBy("no")
    was = lambda c: F.lag(c).over(order)
    big, low = F.greatest("size", was("size")), F.least("size", was("size"))
    pitch = F.abs(F.col("oy") - was("oy"))
    same = (pitch < 0.3 * low) & (F.col("rotation") == was("rotation"))
    cut = (
        F.col("standalone") | was("standalone")
        | (~same & ((F.col("rotation") != was("rotation")) | (big / F.greatest(F.lit(0.1), low) > 1.25) | (pitch > 2 * big) | F.col("text").rlike(BULLET)))
    )
    flagged = lines.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    return flagged.withColumn("paragraph", F.sum("_cut").over(order)).drop("_cut")


def dominant(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """The value with most text (length without outer white space, plus 0.01 each), the first of equals; needs text and pos."""
    weight = F.sum(F.length(F.trim("text")) + F.lit(0.01))
    per = rows.groupBy(*by, value).agg(weight.alias("w"), F.min("pos").alias("p"))
    return per.groupBy(*by).agg(F.max_by(value, F.struct(F.round("w", 6), -F.col("p"))).alias(value))


def line_pitch(lines: DataFrame, *by: str) -> DataFrame:
    """Median distance of the baselines in a paragraph, of distances over 0.3 sizes."""
    order = Window.partitionBy(*by).orderBy("no")
    step = lines.withColumn("d", F.abs(F.col("oy") - F.lag("oy").over(order))).where(F.col("d") > 0.3 * F.col("size"))
    return step.groupBy(*by).agg(F.round(F.median("d"), 2).alias("line_pitch"))


def boxes(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.round(f(c), 2).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))


def left_neighbours(lines: DataFrame) -> DataFrame:
    """(doc_id, page, no, left): of the lines whose right edge is at most a line's left edge and whose middle half
    overlaps its own, the one with the greatest right edge."""
    quarter = lambda p: (F.col(f"{p}.y1") - F.col(f"{p}.y0")) / 4
    near = (F.col("b.x1") <= F.col("a.x0")) & (F.col("b.y0") + quarter("b") < F.col("a.y1") - quarter("a")) & (F.col("a.y0") + quarter("a") < F.col("b.y1") - quarter("b"))
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.rotation") == F.col("b.rotation"))
    pairs = lines.alias("a").join(lines.alias("b"), same & near & (F.col("a.no") != F.col("b.no")))
    return pairs.groupBy("a.doc_id", "a.page", "a.no").agg(F.max_by("b.no", F.struct("b.x1", -F.col("b.no"))).alias("left"))


def aligned(lines: DataFrame, within: float = 1.5) -> DataFrame:
    """(doc_id, page, no, other): lines whose left edges differ by at most ``within`` and whose baselines by 0.5 to 3.5 sizes.

    An equi-join on rounded edges, each line standing for the edges around its own.
    """
    a = lines.select(*PAGE, "no", "x0", "oy", "size", F.explode(F.array(*(F.round("x0") + d for d in range(-2, 3)))).alias("slot"))
    b = lines.select(*PAGE, F.col("no").alias("other"), F.col("x0").alias("_x"), F.col("oy").alias("_y"), F.round("x0").alias("slot"))
    step = F.abs(F.col("oy") - F.col("_y"))
    keep = (F.col("no") != F.col("other")) & (F.abs(F.col("x0") - F.col("_x")) <= within) & step.between(0.5 * F.col("size"), 3.5 * F.col("size"))
    return a.join(b, [*PAGE, "slot"]).where(keep).select(*PAGE, "no", "other")


def inside(points: DataFrame, areas: DataFrame, slack: float = 1.0) -> DataFrame:
    """(doc_id, page, no, seg_id): lines whose centre is in a segment's box, give or take ``slack``."""
    x, y = (F.col("p.x0") + F.col("p.x1")) / 2, (F.col("p.y0") + F.col("p.y1")) / 2
    on = (F.col("p.doc_id") == F.col("s.doc_id")) & (F.col("p.page") == F.col("s.page"))
    on &= x.between(F.col("s.x0") - slack, F.col("s.x1") + slack) & y.between(F.col("s.y0") - slack, F.col("s.y1") + slack)
    return points.alias("p").join(areas.alias("s"), on).select("p.doc_id", "p.page", "p.no", "s.seg_id")


def as_of(rows: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Adds ``value`` of the last mark at or before each row, by key; null if there is none. Both sides go through one window."""
    left = rows.withColumn("_o", F.lit(1)).withColumn("_v", F.lit(None).cast(marks.schema[value].dataType))
    right = marks.select(key, at, F.col(value).alias("_v")).withColumn("_o", F.lit(0))
    order = Window.partitionBy(key).orderBy(at, "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(order))
    return both.where("_o = 1").drop("_o", "_v")


def formula_groups(areas: DataFrame, factor: float = 0.8) -> DataFrame:
    """(doc_id, page, seg_id, lead): boxes of a page that hang together through formulas.

    Two boxes touch if one is a formula, none a frame, and both gaps are under ``factor`` of the larger size. Groups need a
    formula; their lead is its smallest id. A page is worked on by one task; needs seg_id, box, size, formula, frame.
    """

    def page_groups(ids: list, x0: list, x1: list, y0: list, y1: list, size: list, formula: list, frame: list) -> list[tuple[int, int]]:
        up = list(range(len(ids)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        near = sorted((i for i in up if not frame[i]), key=lambda i: x0[i])
        reach = factor * max(size, default=0)
        # The furthest right edge so far: what begins beyond its reach touches nothing before it.
        open_: list[int] = []
        for i in near:
            open_ = [j for j in open_ if x0[i] - x1[j] < reach]
            for j in open_:
                gaps = max(x0[i], x0[j]) - min(x1[i], x1[j]), max(y0[i], y0[j]) - min(y1[i], y1[j])
                if (formula[i] or formula[j]) and max(gaps) < factor * max(size[i], size[j]):
                    up[top(j)] = top(i)
            open_.append(i)
        members: dict[int, list[int]] = {}
        for i in range(len(ids)):
            members.setdefault(top(i), []).append(i)
        leads = ((min((ids[i] for i in own if formula[i]), default=None), own) for own in members.values() if len(own) > 1)
        return [(ids[i], lead) for lead, own in leads if lead is not None for i in own]

    columns = ("seg_id", "x0", "x1", "y0", "y1", "size", "formula", "frame")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(d, p, *g) for d, p, *own in zip(*(rows[c] for c in (*PAGE, *columns))) for g in page_groups(*map(list, own))]
            yield pd.DataFrame(out, columns=[*PAGE, "seg_id", "lead"])

    # A page is one row, so that many pages go through Python in one batch.
    pages = areas.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("own")).select(*PAGE, *(F.col(f"own.{c}").alias(c) for c in columns))
    return pages.mapInPandas(run, "doc_id long, page int, seg_id int, lead int")


def margins(lines: DataFrame) -> DataFrame:
    """Left and right ends of the horizontal lines of a page."""
    return lines.where("rotation = 0").groupBy(*PAGE).agg(F.min("x0").alias("left"), F.max("x1").alias("right"))


def typical_gap(gaps: Column) -> Column:
    """Upper median of the gaps under 0.8; 0.3 if there are none."""
    normal = F.array_sort(F.filter(gaps, lambda g: g < 0.8))
    return F.coalesce(F.get(normal, F.floor(F.size(normal) / 2).cast("int")), F.lit(0.3))


def overlap_share(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The part of box a that b covers."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area > 0, w * h / area).otherwise(0.0)


def spaced_text(spans: DataFrame) -> DataFrame:
    """(doc_id, page, line, text): spans by pos, with a blank where none is and the gap is over 0.15 of the smaller size."""
    order = Window.partitionBy(*PAGE, "line").orderBy("pos")
    gap = F.col("x0") - F.lag("x1").over(order) > 0.15 * F.least("size", F.lag("size").over(order))
    bare = ~F.lag("text").over(order).endswith(" ") & ~F.col("text").startswith(" ")
    part = F.concat(F.when(F.coalesce(gap & bare, F.lit(False)), " ").otherwise(""), "text")
    rows = spans.select(*PAGE, "line", "pos", part.alias("part"))
    own = rows.groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("p"))
    return own.select(*PAGE, "line", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text"))


def styled_start(spans: DataFrame, *by: str) -> DataFrame:
    """(by..., words): the spans before the first in the base style, if not all are, have four words at most and end in a
    word with a digit or in a colon or full stop. Needs pos, text, base."""
    order = Window.partitionBy(*by).orderBy("pos")
    rows = spans.where(F.trim("text") != "").withColumn("_b", F.max(F.col("base").cast("int")).over(order)).withColumn("_any", F.max(F.col("base").cast("int")).over(Window.partitionBy(*by)))
    lead = rows.where("_b = 0 and _any = 1").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    text = F.trim(F.array_join(F.transform("p", lambda x: x["text"]), " "))
    words = F.split("words", "\\s+")
    return lead.select(*by, text.alias("words")).where((F.size(words) <= 4) & F.element_at(words, -1).rlike("\\d|[:.]$"))


def odd_words(spans: DataFrame, most: int = 64) -> DataFrame:
    """(seg_id, word, style): words in another style than the segment's main one that never occur in it, in the style they first have.

    Needs doc_id, seg_id, pos, text, style, main; the most is per segment, as in the format it serves.
    """
    rows = spans.select("doc_id", "seg_id", "style", "main", F.col("pos"), F.posexplode(F.split(F.trim("text"), "\\s+")).alias("i", "word")).where("word <> ''")
    plain = rows.where("style = main").select("doc_id", "seg_id", "word").distinct()
    first = rows.where("style <> main").groupBy("doc_id", "seg_id", "word").agg(F.min_by("style", F.struct("pos", "i")).alias("style"), F.min(F.struct("pos", "i")).alias("at"))
    odd = first.join(plain, ["doc_id", "seg_id", "word"], "left_anti")
    return odd.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "seg_id").orderBy("at"))).where(F.col("_n") <= most).select("doc_id", "seg_id", "word", "style")


def free_span(segments: DataFrame, edges: DataFrame, width: float) -> DataFrame:
    """(doc_id, page, seg_id, left, right): how far a segment may grow before an edge that overlaps its middle band.

    The page's margin is 0.04 of its width, 24 at most; a gap of 0.4 sizes stays free.
    """
    s, e = segments.alias("s"), edges.alias("e")
    h = F.col("s.y1") - F.col("s.y0")
    band = (F.col("e.y1") >= F.col("s.y0") + 0.2 * h) & (F.col("e.y0") <= F.col("s.y1") - 0.2 * h)
    both = s.join(e, (F.col("s.doc_id") == F.col("e.doc_id")) & (F.col("s.page") == F.col("e.page")) & band, "left")
    margin = min(0.04 * width, 24)
    right = F.min(F.when(F.col("e.x0") >= F.col("s.x1") - 0.5, F.col("e.x0") - 0.4 * F.col("s.size")))
    left = F.max(F.when(F.col("e.x1") <= F.col("s.x0") + 0.5, F.col("e.x1") + 0.4 * F.col("s.size")))
    own = both.groupBy("s.doc_id", "s.page", "s.seg_id", "s.x0", "s.x1").agg(left.alias("l"), right.alias("r"))
    return own.select(
        "doc_id", "page", "seg_id", F.least("x0", F.greatest(F.coalesce("l", F.lit(margin)), F.lit(margin))).alias("left"),
        F.greatest("x1", F.least(F.coalesce("r", F.lit(width - margin)), F.lit(width - margin))).alias("right"),
    )


def alignment(lines: DataFrame, *by: str) -> DataFrame:
    """(by..., align) of paragraphs: left, center, right or justify. Needs no, x0, x1, size, rotation, left, right (margins) and width."""
    a = lines.groupBy(*by).agg(
        F.max("size").alias("size"), F.min("x0").alias("l0"), F.max("x0").alias("l1"), F.min("x1").alias("r0"), F.max("x1").alias("r1"), F.count("*").alias("n"), F.first("rotation").alias("rot"),
        F.max(F.struct("no", "x1"))["x1"].alias("last"), F.array_sort(F.collect_list(F.struct("no", "x1"))).alias("all"), F.max((F.col("x0") + F.col("x1")) / 2).alias("c1"),
        F.min((F.col("x0") + F.col("x1")) / 2).alias("c0"), F.first("left").alias("ml"), F.first("right").alias("mr"), F.first("width").alias("w"),
    )
    tol = 0.6 * F.col("size")
    body = F.transform(F.slice("all", F.lit(1), F.greatest(F.col("n").cast("int") - 1, F.lit(1))), lambda x: x["x1"])
    middle = (F.col("l0") + F.col("r1")) / 2
    centred = ((F.abs(middle - F.col("w") / 2) < 0.02 * F.col("w")) | (F.abs(middle - (F.col("ml") + F.col("mr")) / 2) < 0.02 * F.col("w"))) & (F.col("r1") - F.col("l0") < 0.8 * F.col("w"))
    single = (
        F.when(F.col("l0") - F.col("ml") < 2 * F.col("size"), "left").when(centred, "center")
        .when((F.abs(F.col("r1") - F.col("mr")) < tol) & (F.col("l0") - F.col("ml") > 0.3 * F.col("w")), "right").otherwise("left")
    )
    even, flush = F.col("l1") - F.col("l0") < tol, F.col("r1") - F.col("r0") < tol
    block = even & (F.col("n") >= 3) & (F.array_max(body) - F.array_min(body) < tol) & (F.col("last") < F.array_max(body) - tol)
    several = F.when(block, "justify").when(even, "left").when(flush, "right").when(F.col("c1") - F.col("c0") < tol, "center").otherwise("left")
    return a.select(*by, F.when(F.col("rot") != 0, "left").when(F.col("n") == 1, single).otherwise(several).alias("align"))
