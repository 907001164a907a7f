"""Word lists, word groups and languages of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stopwords
from ..functions.text import CJK, PIECE, WORD
from ..operators import words
from ..sources.tables import dealt, table
from .registry import query


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


STOP_SQL = "(" + ", ".join(quoted(w) for w in stopwords.ALL) + ")"
TAIL_SQL = quoted("[-'’\\x{00AD}]+$")
TOKENS_SQL = f"""
raw AS (SELECT doc_id, text, unnest(regexp_extract_all(text, {quoted(WORD)})) AS w,
               generate_subscripts(regexp_extract_all(text, {quoted(WORD)}), 1) - 1 AS pos FROM documents),
forms AS (SELECT doc_id, text, pos, regexp_replace(w, {TAIL_SQL}, '') AS form FROM raw),
tokens AS (SELECT doc_id, text, pos, form, lower(form) AS key FROM forms
           WHERE form <> '' AND lower(form) NOT IN {STOP_SQL}
             AND NOT (length(form) < 3 AND NOT regexp_matches(form, {quoted(CJK)})))"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"WITH {TOKENS_SQL} SELECT key, count(*) AS n FROM tokens GROUP BY key")
def word_frequency(spark, sf_dir):
    return words.frequencies(docs(spark, sf_dir))


@query(
    f"""WITH {TOKENS_SQL},
f AS (SELECT key, form, count(*) AS c, min(doc_id * 1000000 + pos) AS first FROM tokens GROUP BY key, form),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, first) AS rn, sum(c) OVER (PARTITION BY key) AS n FROM f)
SELECT key, CAST(n AS BIGINT) AS n, form FROM r WHERE rn = 1"""
)
def word_top_forms(spark, sf_dir):
    return words.top_forms(docs(spark, sf_dir))


@query(f"WITH {TOKENS_SQL}, m AS (SELECT key, min(doc_id * 1000000 + pos) AS f FROM tokens GROUP BY key) SELECT key, f // 1000000 AS doc_id, f % 1000000 AS pos FROM m")
def word_first_seen(spark, sf_dir):
    return words.first_seen(docs(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""WITH {TOKENS_SQL},
r AS (SELECT key, doc_id, row_number() OVER (PARTITION BY key ORDER BY length(text) < 40, doc_id) AS rn FROM tokens)
SELECT key, doc_id FROM r WHERE rn = 1"""
)
def word_passages(spark, sf_dir):
    return words.passages(docs(spark, sf_dir))


@query(
    f"""WITH {TOKENS_SQL},
n AS (SELECT key, count(*) AS n FROM tokens GROUP BY key),
known AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '\\p{{L}}+'))) AS key FROM benchmark)
SELECT key, n FROM n WHERE key NOT IN (SELECT key FROM known) ORDER BY n DESC, key LIMIT 30"""
)
def top_unknown_words(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("\\p{L}+"), F.lit(0))).alias("term"))
    return words.unknown(words.frequencies(docs(spark, sf_dir)), known)


@query(
    f"""WITH {TOKENS_SQL},
n AS (SELECT key, count(*) AS n FROM tokens GROUP BY key),
known AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '\\p{{L}}+'))) AS key FROM benchmark)
SELECT key, n, key IN (SELECT key FROM known) AS known FROM n"""
)
def known_words(spark, sf_dir):
    """Words of the documents that a glossary has, or not."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0))).alias("key")).distinct()
    seen = words.frequencies(docs(spark, sf_dir))
    return seen.join(terms.withColumn("known", F.lit(True)), "key", "left").select("key", "n", F.coalesce("known", F.lit(False)).alias("known"))


GROUPS_SQL = f"""
p AS (SELECT list_transform(regexp_extract_all(text, {quoted(PIECE)}),
        lambda x: CASE WHEN regexp_matches(x, '^\\p{{L}}') THEN lower(regexp_replace(x, {TAIL_SQL}, '')) END) AS r FROM documents),
g AS (SELECT r, unnest(generate_series(1, len(r))) AS i FROM p),
t AS (SELECT r[i] AS a, r[i + 1] AS b, r[i + 2] AS c FROM g),
s AS (SELECT *, a IN {STOP_SQL} OR (length(a) < 3 AND NOT regexp_matches(a, {quoted(CJK)})) AS sa,
        b IN {STOP_SQL} OR (length(b) < 3 AND NOT regexp_matches(b, {quoted(CJK)})) AS sb,
        c IN {STOP_SQL} OR (length(c) < 3 AND NOT regexp_matches(c, {quoted(CJK)})) AS sc FROM t WHERE a IS NOT NULL AND b IS NOT NULL),
m AS (SELECT a || ' ' || b AS phrase, 2 AS size FROM s WHERE NOT sa AND NOT sb
      UNION ALL SELECT a || ' ' || b || ' ' || c, 3 FROM s WHERE NOT sa AND c IS NOT NULL AND NOT sc),
counted AS (SELECT phrase, size, count(*) AS n FROM m GROUP BY phrase, size HAVING count(*) >= 2),
inside AS (SELECT phrase, sum(n) AS inside FROM (
      SELECT split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) AS phrase, n FROM counted WHERE size = 3
      UNION ALL SELECT split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3), n FROM counted WHERE size = 3) GROUP BY phrase)
SELECT phrase, size, n FROM counted LEFT JOIN inside USING (phrase) WHERE size = 3 OR n > coalesce(inside, 0)"""


@query(f"WITH {GROUPS_SQL}")
def word_groups(spark, sf_dir):
    return words.groups(docs(spark, sf_dir))


def _language_sql() -> str:
    scores = []
    for lang in sorted(stopwords.STOP):
        stop = "[" + ", ".join(quoted(w) for w in stopwords.STOP[lang]) + "]"
        score = f"len(list_filter(w, lambda x: list_contains({stop}, x)))"
        if lang in words.OWN:
            score += f" + least(9, 3 * len(regexp_extract_all(text, {quoted(words.OWN[lang])})))"
        if lang in words.MARKS:
            score = f"CASE WHEN length(text) > 200 AND NOT regexp_matches(text, {quoted(words.MARKS[lang])}) THEN 0 ELSE {score} END"
        scores.append((lang, score))
    best = "greatest(" + ", ".join(f"s_{k}" for k, _ in scores) + ")"
    pick = " ".join(f"WHEN s_{k} = {best} THEN {quoted(k)}" for k, _ in scores)
    scripts = " ".join(f"WHEN regexp_matches(text, {quoted(p)}) THEN {quoted(k)}" for k, p in words.SCRIPTS)
    return f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents),
s AS (SELECT *, {', '.join(f'{v} AS s_{k}' for k, v in scores)} FROM w)
SELECT doc_id, CASE {scripts} WHEN len(w) < 3 THEN '' WHEN {best} < 2 THEN '' {pick} END AS language FROM s"""


@query(_language_sql())
def detect_language(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", words.language(F.col("text")).alias("language"))


@query(
    f"""WITH {TOKENS_SQL}, d AS (SELECT doc_id, lang FROM documents),
n AS (SELECT lang, key, count(*) AS n FROM tokens JOIN d USING (doc_id) GROUP BY lang, key),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, key) AS place FROM n)
SELECT lang, key, n, place FROM r WHERE place <= 25"""
)
def top_words_by_language(spark, sf_dir):
    from pyspark.sql import Window

    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    n = words.tokens(d, "lang").groupBy("lang", "key").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    return n.withColumn("place", place.cast("long")).where("place <= 25")
