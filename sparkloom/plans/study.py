"""The study log, played by the events: a user's event is a grade of the card ``event_id % 20``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import study as ops
from ..sources.tables import table
from .registry import query

NOW = "2024-01-30 12:00:00"
GRADE_SQL = "CASE event_type WHEN 'error' THEN 'again' WHEN 'view' THEN 'hard' WHEN 'click' THEN 'known' WHEN 'purchase' THEN 'easy' END"
LOG_SQL = f"log AS (SELECT *, {GRADE_SQL} AS grade, event_id % 20 AS card FROM events WHERE event_type <> 'signup')"
FOLD_SQL = f"""{LOG_SQL},
g AS (SELECT user_id, card, list({{'ts': ts, 'id': event_id, 'g': grade}} ORDER BY ts, event_id) AS g, max(ts) AS last, count(*) AS grades FROM log GROUP BY user_id, card),
f AS (SELECT user_id, card, last, grades, CAST(list_reduce(list_transform(g, lambda x: CASE x.g WHEN 'again' THEN -1000 WHEN 'hard' THEN 0 WHEN 'known' THEN 1 ELSE 2 END),
  lambda n, d: CASE WHEN d = -1000 THEN 0 WHEN d = 0 THEN greatest(1, n) ELSE n + d END, 0) AS INTEGER) AS known FROM g)"""
DAYS_SQL = "CASE least(greatest(known, 1), 6) WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 7 WHEN 4 THEN 14 WHEN 5 THEN 30 ELSE 90 END"


def log(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    grade = F.when(F.col("event_type") == "error", "again").when(F.col("event_type") == "view", "hard").when(F.col("event_type") == "click", "known").when(F.col("event_type") == "purchase", "easy")
    return e.select("event_id", "ts", "user_id", (F.col("event_id") % 20).alias("card"), grade.alias("grade"))


def cards(spark, sf_dir):
    return ops.graded(log(spark, sf_dir), "user_id", "card")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(
    f"""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) <= DATE '{NOW[:10]}'),
r AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) - 1 AS back, max(day) OVER (PARTITION BY user_id) AS last FROM d),
n AS (SELECT user_id, count(*) AS streak FROM r WHERE last - day = back AND DATE '{NOW[:10]}' - last <= 1 GROUP BY user_id)
SELECT user_id, coalesce(streak, 0) AS streak FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN n USING (user_id)"""
)
def streaks(spark, sf_dir):
    return ops.streaks(table(spark, sf_dir, "events").select("user_id", "ts"), F.lit(NOW[:10]).cast("date"))


@query("SELECT user_id, CAST(day AS VARCHAR) AS day FROM (SELECT user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC) AS r FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS ts FROM events)) WHERE r <= 400")
def study_days(spark, sf_dir):
    return ops.days(table(spark, sf_dir, "events").select("user_id", "ts")).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {FOLD_SQL} SELECT user_id, card, known, last, grades FROM f")
def grade_fold(spark, sf_dir):
    return cards(spark, sf_dir)


@query(
    f"""WITH {FOLD_SQL}, d AS (SELECT *, CASE WHEN known > 0 THEN last + to_days({DAYS_SQL}) END AS due FROM f)
SELECT user_id, card, known, due, due IS NULL OR due <= TIMESTAMP '{NOW}' AS is_due FROM d"""
)
def due_cards(spark, sf_dir):
    due = ops.due_at(F.col("known"), F.col("last"))
    return cards(spark, sf_dir).select("user_id", "card", "known", due.alias("due")).withColumn("is_due", F.col("due").isNull() | (F.col("due") <= now()))


@query(f"WITH {FOLD_SQL} SELECT user_id, CASE WHEN known <= 0 THEN 'new' WHEN known < 4 THEN 'learning' ELSE 'mature' END AS stage, count(*) AS n FROM f GROUP BY ALL")
def stages(spark, sf_dir):
    return cards(spark, sf_dir).groupBy("user_id", ops.stage(F.col("known")).alias("stage")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {FOLD_SQL}, d AS (SELECT user_id, last + to_days({DAYS_SQL}) AS due FROM f WHERE known > 0)
SELECT user_id, greatest(1, CAST(ceil((epoch_us(min(due)) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000.0) AS BIGINT)) AS days FROM d GROUP BY user_id"""
)
def next_due(spark, sf_dir):
    due = F.min(ops.due_at(F.col("known"), F.col("last")))
    left = (F.unix_micros(due.cast("timestamp")) - F.unix_micros(now().cast("timestamp"))) / 86400000000.0
    return cards(spark, sf_dir).where("known > 0").groupBy("user_id").agg(F.greatest(F.lit(1), F.ceil(left)).cast("long").alias("days"))


@query(
    f"""WITH {FOLD_SQL}, n AS (SELECT user_id, count(*) FILTER (WHERE known <= 0) AS fresh, count(*) FILTER (WHERE known <= 0 AND grades > 2) AS seen FROM f GROUP BY user_id)
SELECT user_id, greatest(0, fresh - greatest(2, seen)) AS waiting FROM n"""
)
def waiting_words(spark, sf_dir):
    """New words held back by a cap of two a day; words graded more than twice count as seen."""
    fresh, seen = F.count_if(F.col("known") <= 0), F.count_if((F.col("known") <= 0) & (F.col("grades") > 2))
    return cards(spark, sf_dir).groupBy("user_id").agg(F.greatest(F.lit(0), fresh - F.greatest(F.lit(2), seen)).cast("long").alias("waiting"))


@query(
    f"""WITH {LOG_SQL}, f AS (SELECT user_id, card, min(ts) AS ts FROM log GROUP BY user_id, card)
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM f GROUP BY ALL"""
)
def daily_new_words(spark, sf_dir):
    return ops.daily_new(log(spark, sf_dir), "user_id").withColumn("day", F.col("day").cast("string"))


@query(
    """WITH l AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM l)
SELECT user_id, session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, session"""
)
def gap_sessions(spark, sf_dir):
    return ops.gap_sessions(table(spark, sf_dir, "events"), 12)


@query(
    """WITH r AS (SELECT user_id, event_id AS id, row_number() OVER w AS place, sum(CAST(value * 1000000 AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))
SELECT user_id, id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8 AND (total <= 300000000 OR place = 1)"""
)
def recent_files(spark, sf_dir):
    files = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "ts", F.round(F.col("value") * 1000000).cast("long").alias("size"))
    return ops.recent(files, "user_id").select("user_id", "id", "place")


@query(f"SELECT substring(sha256(CAST(event_id AS VARCHAR)), 1, 24) AS id, ts FROM events WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) > 172800000000")
def expired_files(spark, sf_dir):
    files = table(spark, sf_dir, "events").select(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 24).alias("id"), "ts")
    return ops.expired(files, now())
