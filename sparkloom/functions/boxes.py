"""Points, boxes, matrices and colours as columns. A box is x0, y0, x1, y1; a matrix a..f maps (x, y) to (a x + c y + e, b x + d y + f)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]
Matrix = tuple[Column, Column, Column, Column, Column, Column]


def applied(m: Matrix, p: Point) -> Point:
    a, b, c, d, e, f = m
    return a * p[0] + c * p[1] + e, b * p[0] + d * p[1] + f


def multiplied(m: Matrix, n: Matrix) -> Matrix:
    """The matrix that applies n, then m."""
    x = applied((*m[:4], F.lit(0.0), F.lit(0.0)), (n[0], n[1]))
    y = applied((*m[:4], F.lit(0.0), F.lit(0.0)), (n[2], n[3]))
    return (*x, *y, *applied(m, (n[4], n[5])))


def turned(degrees: Column) -> Matrix:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return c, s, -s, c, F.lit(0.0), F.lit(0.0)


def box(*points: Point) -> Column:
    """The smallest box around the points."""
    x, y = F.array(*(p[0] for p in points)), F.array(*(p[1] for p in points))
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def view(m: Matrix, b: Column, width: Column, height: Column) -> Column:
    """A box through a page's rotation matrix, as shares of the displayed page."""
    r = box(applied(m, (b["x0"], b["y0"])), applied(m, (b["x1"], b["y1"])))
    return F.struct((r["x0"] / width).alias("x0"), (r["y0"] / height).alias("y0"), (r["x1"] / width).alias("x1"), (r["y1"] / height).alias("y1"))


def local(b: Column, rotation: Column) -> Column:
    """A box in the frame of its text: x along the reading direction, y downwards from the line's top."""
    pick = lambda r0, r90, r180, r270: F.when(rotation == 90, r90).when(rotation == 180, r180).when(rotation == 270, r270).otherwise(r0)
    return F.struct(
        pick(b["x0"], -b["y1"], -b["x1"], b["y0"]).alias("x0"), pick(b["y0"], b["x0"], -b["y1"], -b["x1"]).alias("y0"),
        pick(b["x1"], -b["y0"], -b["x0"], b["y1"]).alias("x1"), pick(b["y1"], b["x1"], -b["y0"], -b["x0"]).alias("y1"),
    )


def hsl(r: Column, g: Column, b: Column) -> Column:
    """Hue, saturation and lightness (0 to 1) of a colour with parts 0 to 255."""
    r, g, b = r / 255, g / 255, b / 255
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    light, span = (hi + lo) / 2, hi - lo
    sat = span / F.when(light > 0.5, 2 - hi - lo).otherwise(hi + lo)
    hue = F.when(hi == r, (g - b) / span + F.when(g < b, 6).otherwise(0)).when(hi == g, (b - r) / span + 2).otherwise((r - g) / span + 4) / 6
    grey = span == 0
    return F.struct(F.when(grey, 0.0).otherwise(hue).alias("h"), F.when(grey, 0.0).otherwise(sat).alias("s"), light.alias("l"))


def hex_parts(r: Column, g: Column, b: Column) -> Column:
    """'#rrggbb' of parts that are rounded and held to 0..255."""
    part = lambda v: F.lpad(F.lower(F.hex(F.least(F.greatest(F.round(v), F.lit(0)), F.lit(255)).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))
