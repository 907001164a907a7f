"""The study log: days, streaks, due cards, grades, stages, and the vocabulary with its merges.

Nothing reads the clock; the time is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import term_key

#: Days until a word comes back, by how often it was known; at most this many study days are kept (fixed values).
STEPS = (1, 3, 7, 14, 30, 90)
DAYS_KEPT = 400


def days(log: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, day): the last 400 distinct days of each user."""
    d = log.select(user, F.to_date("ts").alias("day")).distinct()
    return d.withColumn("back", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("day")))).where(F.col("back") <= DAYS_KEPT).drop("back")


def streaks(log: DataFrame, today: Column, user: str = "user_id") -> DataFrame:
    """(user, streak): days in a row up to ``today``, or to the day before if today is none; 0 if both are not there."""
    d = log.select(user, F.to_date("ts").alias("day"), today.alias("today")).where("day <= today").distinct()
    back = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("day"))) - 1
    last = F.max("day").over(Window.partitionBy(user))
    run = d.withColumn("back", back).withColumn("last", last).where((F.date_diff("last", "day") == F.col("back")) & (F.date_diff("today", "last") <= 1))
    n = run.groupBy(user).agg(F.count("*").alias("streak"))
    return log.select(user).distinct().join(n, user, "left").select(user, F.coalesce("streak", F.lit(0)).alias("streak"))


def interval_days(known: Column) -> Column:
    steps = F.array(*map(F.lit, STEPS))
    return F.element_at(steps, F.greatest(F.lit(1), F.least(known, F.lit(len(STEPS)))).cast("int"))


def graded(log: DataFrame, *by: str) -> DataFrame:
    """Adds up grades in order of (ts, event_id): again starts anew, hard keeps at least one, known adds one, easy two.

    ``log`` has ts, event_id and grade; returns (by..., known, last, grades). A card's grades are few.
    """
    step = lambda n, g: (
        F.when(g["grade"] == "again", 0).when(g["grade"] == "hard", F.greatest(F.lit(1), n)).when(g["grade"] == "known", n + 1).otherwise(n + 2)
    )
    own = log.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "grade"))).alias("g"), F.max("ts").alias("last"), F.count("*").alias("grades"))
    return own.select(*by, F.aggregate("g", F.lit(0), step).alias("known"), "last", "grades")


def due_at(known: Column, last: Column) -> Column:
    """When a known word is due; null for one that is not known (it always is)."""
    return F.when(known > 0, last + F.make_dt_interval(interval_days(known)))


def stage(known: Column) -> Column:
    return F.when(F.coalesce(known, F.lit(0)) <= 0, "new").when(known < 4, "learning").otherwise("mature")


def round_rows(cards: DataFrame, now: Column, cap: int, shown: int = 0, user: str = "user_id") -> DataFrame:
    """(user, id, place) of each user's round: new words first, those seen before ahead, up to the day's cap but never fewer than
    were seen; then the due ones, longest due first. ``cards(user, id, known, last, seen)``."""
    due = F.when(F.col("known") > 0, due_at(F.col("known"), F.col("last")).cast("timestamp_ntz"))
    fresh = F.col("known") <= 0
    rows = cards.select(user, "id", fresh.alias("fresh"), (fresh & F.coalesce("seen", F.lit(False))).alias("ahead"), due.alias("due"))
    own = Window.partitionBy(user, "fresh")
    rows = rows.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("ahead"), "id")), "most": F.greatest(F.lit(max(0, cap - shown)), F.sum(F.col("ahead").cast("int")).over(own))})
    rows = rows.where((F.col("fresh") & (F.col("rank") <= F.col("most"))) | (F.col("due") <= now))
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("fresh"), F.desc("ahead"), "due", "id"))
    return rows.select(user, "id", place.alias("place"))


def daily_new(log: DataFrame, *by: str) -> DataFrame:
    """(by..., day, n): cards seen for the first time on a day."""
    first = log.groupBy(*by, "card").agg(F.min("ts").alias("ts"))
    return first.groupBy(*by, F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def gap_sessions(log: DataFrame, hours: float, user: str = "user_id") -> DataFrame:
    """(user, session, start, end, n): runs of rows with gaps of at most ``hours``."""
    order = Window.partitionBy(user).orderBy("ts", "event_id")
    new = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))) > int(hours * 3.6e9)
    cut = log.select(user, "ts", "event_id").withColumn("new", F.coalesce(new.cast("int"), F.lit(0)))
    numbered = cut.withColumn("session", F.sum("new").over(order))
    return numbered.groupBy(user, "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


def recent(files: DataFrame, user: str, most: int = 8, size: int = 300_000_000) -> DataFrame:
    """The newest files of each user: ``most`` at most, and ``size`` bytes together; the newest always stays."""
    order = Window.partitionBy(user).orderBy(F.desc("ts"), F.desc("id"))
    ranked = files.withColumn("place", F.row_number().over(order)).withColumn("total", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("place") <= most) & ((F.col("total") <= size) | (F.col("place") == 1)))


def expired(files: DataFrame, now: Column, hours: float = 48) -> DataFrame:
    """Files older than ``hours`` with an id of 24 hex digits; none if hours is 0 or less."""
    old = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) > int(hours * 3.6e9)
    return files.where(F.col("id").rlike("^[0-9a-f]{24}$") & old & F.lit(hours > 0))


VOCABULARY = "pair string, term string, translation string, example string, example_tr string, added timestamp_ntz, seen int, known int, last timestamp_ntz, fav boolean"


def add_terms(vocabulary: DataFrame, rows: DataFrame) -> DataFrame:
    """New rows (pair, term, translation, example, example_tr, ord, ts) merged in by pair and lower-cased term.

    Rows of a term are taken in order: the last translation, the last example that is not blank. A term that is there keeps
    its spelling and learning state and is seen once more for each row.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    good = rows.where(blank("term").isNotNull() & blank("translation").isNotNull() & F.col("pair").rlike("^[a-z]{2,8}-[a-z]{2,8}$"))
    key = F.lower(F.trim("term"))
    new = good.groupBy("pair", key.alias("key")).agg(
        F.min_by(F.trim("term"), "ord").alias("n_term"),
        F.max_by(F.trim("translation"), "ord").alias("n_translation"),
        F.max_by(blank("example"), F.when(blank("example").isNotNull(), F.col("ord"))).alias("n_example"),
        F.max_by(blank("example_tr"), F.when(blank("example_tr").isNotNull(), F.col("ord"))).alias("n_example_tr"),
        F.min("ts").alias("n_ts"),
        F.count("*").cast("int").alias("n"),
    )
    both = vocabulary.withColumn("key", key).join(new, ["pair", "key"], "full_outer")
    return both.select(
        "pair",
        F.coalesce("term", "n_term").alias("term"),
        F.coalesce("n_translation", "translation").alias("translation"),
        F.coalesce("n_example", "example", F.lit("")).alias("example"),
        F.coalesce("n_example_tr", "example_tr", F.lit("")).alias("example_tr"),
        F.coalesce("added", "n_ts").alias("added"),
        (F.when(F.col("term").isNull(), 0).otherwise(F.coalesce("seen", F.lit(1))) + F.coalesce("n", F.lit(0))).cast("int").alias("seen"),
        F.coalesce("known", F.lit(0)).alias("known"),
        "last",
        F.coalesce("fav", F.lit(False)).alias("fav"),
    )


def merge_duplicates(vocabulary: DataFrame) -> DataFrame:
    """One row for each pair and normalised term: the longest term (then the most known, then the first added) stays, translations are
    put together, the learning state takes the best of all."""
    rows = vocabulary.withColumn("norm", term_key(F.col("term")))
    order = F.struct((-F.length("term")).alias("l"), (-F.coalesce("known", F.lit(0))).alias("k"), "added", "term")
    own = rows.where("norm <> ''").groupBy("pair", "norm").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), "term", "translation", "example", "example_tr"))).alias("g"),
        F.max("known").alias("known"), F.max("last").alias("last"), F.sum(F.coalesce("seen", F.lit(1))).cast("int").alias("seen"),
        F.min("added").alias("added"), F.bool_or("fav").alias("fav"),
    )
    words = F.filter(F.flatten(F.transform("g", lambda r: F.split(r["translation"], "[ \\t]*;[ \\t]*"))), lambda w: w != "")
    once = F.filter(words, lambda w, i: F.array_position(F.transform(words, F.lower), F.lower(w)) == i + 1)
    first = lambda f: F.coalesce(F.get(F.filter(F.transform("g", lambda r: r[f]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0)), F.lit(""))
    return own.select(
        "pair", F.get("g", F.lit(0))["term"].alias("term"), F.array_join(once, "; ").alias("translation"), first("example").alias("example"), first("example_tr").alias("example_tr"),
        "added", "seen", F.coalesce("known", F.lit(0)).alias("known"), "last", F.coalesce("fav", F.lit(False)).alias("fav"),
    )


def restore(current: DataFrame, backup: DataFrame) -> DataFrame:
    """A backup merged in by pair and exact term: the higher known, then the newer last wins, favourites stay, blanks are filled."""
    all_ = current.withColumn("o", F.lit(0)).unionByName(backup.where("term is not null and term <> ''").withColumn("o", F.lit(1)))
    kept = lambda c: F.coalesce(F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("o"))), F.lit("")).alias(c)
    best = F.struct(F.coalesce("known", F.lit(0)).alias("k"), F.coalesce(F.col("last"), F.lit("1970-01-01").cast("timestamp_ntz")).alias("l"), (-F.col("o")).alias("o"))
    return all_.groupBy("pair", "term").agg(
        kept("translation"), kept("example"), kept("example_tr"), F.min_by("added", "o").alias("added"), F.min_by("seen", "o").alias("seen"),
        F.max_by(F.coalesce("known", F.lit(0)), best).alias("known"), F.max_by("last", best).alias("last"), F.bool_or(F.coalesce("fav", F.lit(False))).alias("fav"),
    )


def merge_keywords(current: DataFrame, rows: DataFrame) -> DataFrame:
    """A document's list with new rows (term, translation, example, example_tr, ord) by lower-cased term: translations are replaced, examples if not blank."""
    filled = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("o"))).alias(c)
    both = current.withColumn("o", F.lit(-1)).unionByName(rows.withColumnRenamed("ord", "o")).withColumn("key", F.lower(F.trim("term"))).where("key <> ''")
    out = both.groupBy("key").agg(F.min_by("term", "o").alias("term"), F.max_by("translation", "o").alias("translation"), filled("example"), filled("example_tr"))
    return out.select("term", "translation", F.coalesce("example", F.lit("")).alias("example"), F.coalesce("example_tr", F.lit("")).alias("example_tr"))


def moved(vocabulary: DataFrame, terms: DataFrame, source: str, target: str, now: Column) -> DataFrame:
    """Rows of a pair's terms added to another pair, as ``add_terms`` adds them; nothing happens if the pairs are equal."""
    if not target or source == target:
        return vocabulary
    picked = terms.select("term").distinct().withColumn("_m", F.lit(True))
    marked = vocabulary.join(picked, "term", "left").withColumn("_m", F.coalesce("_m", F.lit(False)) & (F.col("pair") == source))
    gone = marked.where("_m").select(F.lit(target).alias("pair"), "term", "translation", "example", "example_tr", F.lit(0).alias("ord"), now.alias("ts"))
    return add_terms(marked.where("not _m").select(vocabulary.columns), gone)


def deck_added(deck: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: whether a pair has at least one, and four fifths, of a deck's rows."""
    terms = deck.select("term").distinct()
    best = vocabulary.join(terms, "term", "left_semi").groupBy("pair").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("best"))
    size = deck.agg(F.greatest(F.lit(1), F.floor(F.count("*") * 0.8)).alias("need"))
    return best.join(size, F.lit(True)).select((F.col("best") >= F.col("need")).alias("added"))
