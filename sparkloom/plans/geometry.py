"""Page geometry. The tables have none, so lines of documents are laid out by a rule: 13 units a line and 40 more
after every seventh, size 10 or, every fifth line, 14."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import hex_colour, rotation
from ..operators import geometry as ops
from ..operators import lines as text_lines
from ..sources.tables import table
from .registry import query

LAID_SQL = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
g AS (SELECT doc_id, no, text, CAST(no * 13 + 40 * (no // 7) AS DOUBLE) AS oy, CAST(CASE WHEN no % 5 = 0 THEN 14 ELSE 10 END AS DOUBLE) AS size FROM l),
c AS (SELECT *, CASE WHEN lag(no) OVER w IS NOT NULL AND (greatest(size, lag(size) OVER w) / least(size, lag(size) OVER w) > 1.25 OR oy - lag(oy) OVER w > 2 * greatest(size, lag(size) OVER w)
  OR regexp_matches(text, '^\\s*(?:[•·◦▪–—*-]|\\d{1,3}[.)])\\s')) THEN 1 ELSE 0 END AS cut FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
p AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY doc_id ORDER BY no) AS BIGINT) AS paragraph FROM c)"""


def laid(spark, sf_dir):
    d = text_lines.lines(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("line", "text")
    no = F.col("no")
    return d.select(
        "doc_id", F.lit(0).alias("page"), "no", "text", (no * 13 + 40 * F.floor(no / 7)).cast("double").alias("oy"), F.when(no % 5 == 0, 14.0).otherwise(10.0).alias("size"),
        F.lit(0).alias("rotation"), F.lit(False).alias("standalone"), F.lit(50.0).alias("x0"), F.lit(50.0).alias("_"),
    ).drop("_")


@query(f"WITH {LAID_SQL} SELECT doc_id, paragraph, count(*) AS lines, CAST(min(no) AS INTEGER) AS first FROM p GROUP BY doc_id, paragraph")
def paragraph_groups(spark, sf_dir):
    return ops.paragraphs(laid(spark, sf_dir), "doc_id").groupBy("doc_id", "paragraph").agg(F.count("*").alias("lines"), F.min("no").alias("first"))


@query(
    f"""WITH {LAID_SQL}, d AS (SELECT doc_id, paragraph, size, abs(oy - lag(oy) OVER (PARTITION BY doc_id, paragraph ORDER BY no)) AS d FROM p)
SELECT doc_id, paragraph, round(median(d), 2) AS line_pitch FROM d WHERE d > 0.3 * size GROUP BY doc_id, paragraph"""
)
def line_pitch(spark, sf_dir):
    return ops.line_pitch(ops.paragraphs(laid(spark, sf_dir), "doc_id"), "doc_id", "paragraph")


@query(
    f"""WITH {LAID_SQL}, w AS (SELECT doc_id, size, round(sum(length(trim(text)) + 0.01), 6) AS w, min(no) AS p FROM g GROUP BY doc_id, size),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, p) AS rn FROM w) SELECT doc_id, size FROM r WHERE rn = 1"""
)
def dominant_size(spark, sf_dir):
    return ops.dominant(laid(spark, sf_dir).withColumn("pos", F.col("no")), "size", "doc_id")


@query(
    """WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts, event_id AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'purchase') WHERE r = 1)
SELECT c.event_id, coalesce(p.last, -1) AS last FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts"""
)
def last_before(spark, sf_dir):
    """As-of join, as for the current bookmark: a user's last purchase at or before each click."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    clicks, bought = e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'")
    marks = bought.groupBy("user_id", "ts").agg(F.max("event_id").alias("last"))
    return ops.as_of(clicks, marks, "user_id", "ts", "last").select("event_id", F.coalesce("last", F.lit(-1)).alias("last"))


@query(
    """SELECT doc_id, '#' || lpad(lower(to_hex((doc_id * 7919) & 16777215)), 6, '0') AS colour,
CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 180 WHEN 2 THEN 90 WHEN 3 THEN 270 ELSE -1 END AS rotation FROM documents"""
)
def colours_and_rotations(spark, sf_dir):
    n = F.col("doc_id")
    dx = F.when(n % 5 == 0, 1.0).when(n % 5 == 1, -1.0).otherwise(0.1)
    dy = F.when(n % 5 == 2, -1.0).when(n % 5 == 3, 1.0).otherwise(0.1)
    return table(spark, sf_dir, "documents").select("doc_id", hex_colour(n * 7919).alias("colour"), F.coalesce(rotation(dx, dy), F.lit(-1)).alias("rotation"))
