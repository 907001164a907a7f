"""Which segments, words and rows a view, an answer or an export takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def translatable(segments: DataFrame, hidden: DataFrame) -> DataFrame:
    """Segments that are neither skipped nor hidden members of a repeat."""
    return segments.where(~F.col("skip")).join(hidden.select("id"), "id", "left_anti")


def listed(segments: DataFrame, hidden: DataFrame, page: int | None = None, status: str = "all", pattern: str | None = None, scope: str = "both") -> DataFrame:
    """Segments of a list: by page, by status (all, todo, done, numbers, extra) and by a search in source, target or both.

    ``segments`` has id, page, skip, extra, text, target. Numbers have a list of their own, and hidden members none but it.
    """
    rows = segments.where(F.col("skip") if status == "numbers" else ~F.col("skip"))
    if status != "numbers":
        rows = rows.join(hidden.select("id"), "id", "left_anti")
    if page is not None:
        rows = rows.where(F.col("page") == page)
    if status in ("todo", "done"):
        rows = rows.where(blank("target") if status == "todo" else ~blank("target"))
    if status == "extra":
        rows = rows.where(F.col("extra").isNotNull())
    if pattern:
        found = {"src": F.col("text").rlike(pattern), "tr": F.coalesce("target", F.lit("")).rlike(pattern)}
        rows = rows.where(found["src"] | found["tr"] if scope == "both" else found[scope])
    return rows


def asked(segments: DataFrame, first: int, last: int, only_todo: bool = False) -> DataFrame:
    """Segments for a translator: pages from ``first`` to ``last`` (from 1), and only those without a target if so asked."""
    rows = segments.where(~F.col("skip") & F.col("page").between(first - 1, last - 1))
    return rows.where(blank("target")) if only_todo else rows


def vocabulary(rows: DataFrame, stage: Column, due: Column, which: str = "all", favourites: bool = False, text: str = "") -> DataFrame:
    """Vocabulary rows of a stage (new, learning, mature), due ones, or all; favourites only; with a text in any of four fields."""
    if which == "due":
        rows = rows.where(due)
    elif which != "all":
        rows = rows.where(stage == which)
    if favourites:
        rows = rows.where("fav")
    if text.strip():
        rows = rows.where(F.lower(F.concat_ws(" ", "term", "translation", "example", "example_tr")).contains(text.strip().lower()))
    return rows


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{24}\\z"), F.lit(False))


def clamped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def read_words(words: DataFrame) -> DataFrame:
    """Words of a reader that are kept: those without letters or digits from confidence 80, brackets alone never; those
    under 30 only with a letter, in a line that has a word of 60 or more; lines with no letter or digit are dropped.

    Needs doc_id, page, line, text, conf.
    """
    line = Window.partitionBy("doc_id", "page", "line")
    named, lettered = F.col("text").rlike("[\\p{L}\\p{N}]"), F.col("text").rlike("\\p{L}")
    rows = words.withColumn("_sure", F.max("conf").over(line) >= 60)
    rows = rows.where(~F.col("text").rlike("^[\\[\\](){}|]+$") & (named | (F.col("conf") >= 80)) & ((F.col("conf") >= 30) | (F.col("_sure") & lettered)))
    return rows.withColumn("_any", F.max(named).over(line)).where("_any").drop("_any", "_sure")


def unsure_words(words: DataFrame, segments: DataFrame, least: float = 70) -> DataFrame:
    """(doc_id, page, seg_id, text): words under ``least`` with a letter or digit whose centre is in a segment that nobody has edited."""
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.y0") + F.col("w.y1")) / 2
    on = (F.col("w.doc_id") == F.col("s.doc_id")) & (F.col("w.page") == F.col("s.page")) & x.between(F.col("s.x0"), F.col("s.x1")) & y.between(F.col("s.y0"), F.col("s.y1"))
    low = words.where((F.col("conf") < least) & F.col("text").rlike("[\\p{L}\\p{N}]")).alias("w")
    return low.join(segments.where(~F.col("edited")).alias("s"), on).select("w.doc_id", "w.page", "s.seg_id", "w.text")


def confidence(words: DataFrame, *by: str) -> DataFrame:
    """Letters of sure words (60 or more), and the mean confidence by word length."""
    n = F.length("text")
    return words.groupBy(*by).agg(
        F.sum(F.when(F.col("conf") >= 60, F.length(F.regexp_replace("text", "[^\\p{L}]", ""))).otherwise(0)).alias("letters"),
        (F.sum(F.col("conf") * n) / F.sum(n)).alias("conf"),
    )


def next_joinable(segments: DataFrame) -> DataFrame:
    """Adds next: the following segment of the page with the same reader flag and no frame, numbers passed over."""
    able = ~F.col("skip") & ~F.col("frame")
    after = Window.partitionBy("doc_id", "page", "ocr").orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    return segments.withColumn("next", F.when(~F.col("frame"), F.first(F.when(able, F.col("id")), ignorenulls=True).over(after)))


def scanned_pages(pages: DataFrame, segments: DataFrame, share: float = 0.3) -> DataFrame:
    """Pages without a segment that have an image over ``share`` of their area; ``images`` is an array of boxes."""
    empty = pages.join(segments.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    area = lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
    return empty.where(F.exists("images", lambda c: area(c) > share * F.col("width") * F.col("height"))).select("doc_id", "page")


def unreferenced(stored: DataFrame, used: DataFrame) -> DataFrame:
    return stored.select("key").distinct().join(used.select("key"), "key", "left_anti")


def missing_glyphs(texts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(char, n): characters of texts that a font doesn't have; at most one row for each character of Unicode."""
    chars = texts.select(F.explode(F.split("text", "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("n"))
    return chars.join(glyphs.select("char"), "char", "left_anti")


def next_file(files: DataFrame, current: int) -> DataFrame:
    """The next file with work after the current one, going round; files (ord, todo)."""
    return files.where("todo > 0").orderBy((F.col("ord") <= current).cast("int"), "ord").limit(1)


def shown(rows: DataFrame, order: str, most: int, *by: str) -> DataFrame:
    """The first ``most`` rows of each list, with their place (from 1) and more, the number of rows left out."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long")
    size = rows.groupBy(*by).agg(F.greatest(F.lit(0).cast("long"), F.count("*") - most).alias("more"))
    return rows.withColumn("place", place).where(F.col("place") <= most).join(size, list(by))


def dealt(rows: DataFrame, key: str, seed: int, *by: str) -> DataFrame:
    """Adds dealt: the place of each row in its list (from 1) once it is shuffled; the seed decides, whatever the partitioning."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.withColumn("dealt", F.row_number().over(Window.partitionBy(*by).orderBy(order, key)).cast("long"))
