"""Lines, repeats, copies and searches in the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import lines
from ..sources.tables import table
from .registry import query
from .words import docs, quoted

KEY_SQL = "trim(regexp_replace(regexp_replace({}, '[0-9]+', '#', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
LINES_SQL = "l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents)"


@query(
    """WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t]*(?:\\n[ \\t]*)+') AS a FROM documents),
t AS (SELECT doc_id, list_filter(list_transform(a, lambda x: regexp_replace(x, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda x: x <> '') AS a FROM p)
SELECT doc_id, unnest(a) AS text, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS no FROM t"""
)
def paragraph_segments(spark, sf_dir):
    return lines.paragraphs(docs(spark, sf_dir))


@query(
    f"""WITH {LINES_SQL}
SELECT doc_id, CAST(no AS INTEGER) AS no, line,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM l"""
)
def text_lines(spark, sf_dir):
    return lines.lines(docs(spark, sf_dir))


CLASSES = {"bullet": fn.BULLET, "leaders": fn.LEADERS, "section": fn.SECTION, "address": fn.ADDRESS, "marker": "^[ \\t]*\\[\\[[ ]*[0-9]+[ ]*\\]\\]"}


@query(
    f"""WITH {LINES_SQL}
SELECT {', '.join(f'regexp_matches(line, {quoted(p)}) AS {k}' for k, p in CLASSES.items())}, NOT regexp_matches(line, '\\p{{L}}') AS skipped, count(*) AS n
FROM l GROUP BY ALL"""
)
def line_classes(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line"))
    flags = [F.col("line").rlike(p).alias(k) for k, p in CLASSES.items()]
    return rows.select(*flags, (~F.col("line").rlike(fn.LETTER)).alias("skipped")).groupBy(*CLASSES, "skipped").agg(F.count("*").alias("n"))


BANDS_SQL = f"""WITH e AS (SELECT doc_id, source, 'top' AS band, string_split(text, chr(10))[1] AS line FROM documents
  UNION ALL SELECT doc_id, source, 'bottom', string_split(text, chr(10))[-1] FROM documents),
k AS (SELECT doc_id, source, band, {KEY_SQL.format('line')} AS norm FROM e),
f AS (SELECT source, band, norm, count(DISTINCT doc_id) AS docs, min(doc_id) AS lead FROM k WHERE regexp_matches(norm, '\\p{{L}}') GROUP BY ALL),
p AS (SELECT source, greatest(2, ceil(count(*) * 0.05)) AS need FROM documents GROUP BY source)
SELECT source, band, norm, docs, lead FROM f JOIN p USING (source) WHERE docs >= need"""


@query(BANDS_SQL)
def repeated_bands(spark, sf_dir):
    """Headers and footers by source; the share is 0.05, as few lines reach the usual 0.3 in these tables."""
    return lines.band_repeats(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), 0.05)


REPEATS_SQL = f"""k AS (SELECT doc_id, {KEY_SQL.format('line')} AS norm FROM l),
p AS (SELECT norm, doc_id, count(*) AS c FROM k WHERE regexp_matches(norm, '\\p{{L}}') GROUP BY ALL),
g AS (SELECT norm, count(*) AS docs, CAST(sum(c) AS BIGINT) AS n, min(doc_id) AS lead FROM p GROUP BY norm HAVING count(*) >= 2)"""


@query(f"WITH {LINES_SQL}, {REPEATS_SQL} SELECT norm, docs, n, lead FROM g")
def repeated_lines(spark, sf_dir):
    return lines.repeated_lines(docs(spark, sf_dir))


@query(
    f"""WITH {LINES_SQL}, {REPEATS_SQL},
m AS (SELECT DISTINCT norm, doc_id, CASE WHEN docs % 3 = 0 THEN 'keep' WHEN docs % 3 = 1 THEN 'each' ELSE 'once' END AS mode, lead FROM p JOIN g USING (norm))
SELECT DISTINCT doc_id AS id FROM m WHERE mode = 'keep' OR (mode = 'once' AND doc_id <> lead)"""
)
def repeat_hidden(spark, sf_dir):
    """Members hidden by their group; the mode follows from the group's size, as the tables have none."""
    d = docs(spark, sf_dir)
    groups = lines.repeated_lines(d).select("norm", F.when(F.col("docs") % 3 == 0, "keep").when(F.col("docs") % 3 == 1, "each").otherwise("once").alias("mode"))
    members = d.select("doc_id", F.explode(F.split("text", lines.BREAK)).alias("line")).select(F.col("doc_id").alias("id"), fn.repeat_key(F.col("line")).alias("norm")).distinct()
    return lines.hidden_ids(members.join(groups, "norm").select(F.col("norm").alias("key"), "id", "mode"))


@query("SELECT substring(sha256(text), 1, 24) AS id, count(*) AS n, min(doc_id) AS kept FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.substring(F.sha2("text", 256), 1, 24).alias("id"))
    return d.groupBy("id").agg(F.count("*").alias("n"), F.min("doc_id").alias("kept"))


@query("SELECT doc_id, substring(sha256(text), 1, 24) AS sha, sha1(text) AS media_key, substring(sha1(text), 1, 8) AS checksum, md5(text) AS md5 FROM documents")
def content_hashes(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id", F.substring(F.sha2(t, 256), 1, 24).alias("sha"), F.sha1(t).alias("media_key"), F.substring(F.sha1(t), 1, 8).alias("checksum"), F.md5(t).alias("md5")
    )


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '(?:the|and)')) AS hits, regexp_replace(text, '(?:the|and)', '<>', 'g') AS text
FROM documents WHERE regexp_matches(text, '(?:the|and)')"""
)
def replace_all(spark, sf_dir):
    got = lines.replaced(docs(spark, sf_dir), "(?:the|and)", "<>")
    return got.withColumn("hits", F.col("hits").cast("long"))


@query(
    """WITH m AS (SELECT doc_id, string_split(text, 'ation') AS g FROM documents WHERE contains(text, 'ation')),
u AS (SELECT doc_id, unnest(g[:-2]) AS g, generate_subscripts(g[:-2], 1) - 1 AS no FROM m)
SELECT doc_id, CAST(no AS INTEGER) AS no, 5 AS length,
  CAST(sum(length(g) + 5) OVER (PARTITION BY doc_id ORDER BY no) - 5 AS INTEGER) AS start FROM u"""
)
def find_matches(spark, sf_dir):
    return lines.matches(docs(spark, sf_dir), lines.search_pattern("ation", case=True))


@query("SELECT count(*) AS docs, CAST(sum(length(text) - length(replace(text, chr(65533), ''))) AS BIGINT) AS unreadable, CAST(count(*) FILTER (WHERE NOT regexp_matches(text, '\\p{L}')) AS BIGINT) AS skipped FROM documents")
def unreadable_characters(spark, sf_dir):
    t = F.col("text")
    lost = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
    return docs(spark, sf_dir).agg(F.count("*").alias("docs"), F.sum(lost).alias("unreadable"), F.count_if(~t.rlike(fn.LETTER)).alias("skipped"))


@query(
    """WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a FROM documents)
SELECT doc_id, sha256(coalesce(list_reduce(a, lambda acc, x: CASE WHEN regexp_matches(acc, '\\p{L}-$') AND regexp_matches(x, '^\\p{Ll}')
  THEN substring(acc, 1, length(acc) - 1) || x ELSE acc || ' ' || x END), '')) AS joined FROM b"""
)
def joined_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(fn.joined_lines(F.split("text", "\n")), 256).alias("joined"))


@query(
    """SELECT doc_id, sha256(replace(replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS xml,
  sha256(regexp_replace(text, '<(/?[0-9]+/?)>', '‹\\1›', 'g')) AS escaped FROM documents"""
)
def escaped_texts(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.sha2(fn.xml_escaped(t), 256).alias("xml"), F.sha2(fn.markers_escaped(t), 256).alias("escaped"))


TERM_SQL = f"trim(regexp_replace(regexp_replace(lower(trim(line)), {quoted(fn.ARTICLE)}, ''), '[ \\t\\n\\r.,;:!?\"''()\\[\\]/-]+', ' ', 'g'))"


@query(f"WITH {LINES_SQL}, k AS (SELECT doc_id, {TERM_SQL} AS term FROM l) SELECT term, count(*) AS n, min(doc_id) AS first FROM k WHERE term <> '' GROUP BY term HAVING count(*) > 1")
def duplicate_terms(spark, sf_dir):
    k = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", fn.term_key(F.col("line")).alias("term"))
    return k.where("term <> ''").groupBy("term").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
