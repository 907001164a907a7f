"""Answers reconciled by id. Documents are the segments, labels are a partial answer, conversations are
files with numbered segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile as ops
from ..sources.tables import table
from .registry import query

TARGETS_SQL = "t AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN ' ' ELSE 'q' || quality END AS target, CASE WHEN quality = 1 THEN 1.0 ELSE 0.9 END AS scale FROM labels)"


def known(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") / 10).cast("int").alias("page"), "lang", "text")


def targets(spark, sf_dir):
    """Labels as targets; toxic ones are blank."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, " ").otherwise(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("target"),
        F.when(F.col("quality") == 1, 1.0).otherwise(0.9).alias("scale"),
    )


def segments(spark, sf_dir):
    """Conversations as files with segments: (conv_id, id, role, text), ids from 1."""
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("id"), "role", "text")


@query(
    """WITH k AS (SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0), p AS (SELECT DISTINCT doc_id AS id FROM labels)
SELECT count(*) FILTER (WHERE k.id IS NOT NULL AND p.id IS NOT NULL) AS matched, count(*) FILTER (WHERE k.id IS NULL) AS unknown,
  count(*) FILTER (WHERE p.id IS NULL) AS missing FROM k FULL JOIN p ON k.id = p.id"""
)
def import_reconcile(spark, sf_dir):
    """Every seventh document is taken as not known, so that there are unknown ids."""
    return ops.import_counts(known(spark, sf_dir).where("id % 7 <> 0"), targets(spark, sf_dir))


@query(
    """WITH k AS (SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0), p AS (SELECT DISTINCT doc_id AS id FROM labels)
SELECT coalesce(k.id, p.id) AS id, CASE WHEN k.id IS NULL THEN 'unknown' WHEN p.id IS NULL THEN 'missing' ELSE 'matched' END AS state FROM k FULL JOIN p ON k.id = p.id"""
)
def import_states(spark, sf_dir):
    return ops.matched(known(spark, sf_dir).where("id % 7 <> 0"), targets(spark, sf_dir))


@query(
    f"""WITH {TARGETS_SQL}, c AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE '' END AS target FROM documents),
j AS (SELECT c.id, c.target, t.target AS new FROM c LEFT JOIN t USING (id))
SELECT id, CASE WHEN new IS NOT NULL AND trim(target) = '' THEN new ELSE target END AS target,
  coalesce(new IS NOT NULL AND trim(target) = '' AND target IS DISTINCT FROM new, false) AS changed FROM j"""
)
def import_merge(spark, sf_dir):
    current = known(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, "old").otherwise("").alias("target"))
    return ops.merged(current, targets(spark, sf_dir))


@query(
    f"""WITH {TARGETS_SQL}, s AS (SELECT doc_id AS id, CAST(floor(doc_id / 10) AS INTEGER) AS page FROM documents)
SELECT count(*) FILTER (WHERE coalesce(trim(target), '') <> '') AS replaced, count(*) FILTER (WHERE coalesce(trim(target), '') = '') AS untranslated,
  count(*) FILTER (WHERE coalesce(trim(target), '') <> '' AND scale < 0.98) AS shrunk,
  count(DISTINCT CASE WHEN coalesce(trim(target), '') <> '' THEN page END) AS pages FROM s LEFT JOIN t USING (id)"""
)
def build_stats(spark, sf_dir):
    return ops.build_stats(known(spark, sf_dir), targets(spark, sf_dir))


@query(
    f"""WITH {TARGETS_SQL}, s AS (SELECT doc_id AS id, lang FROM documents WHERE regexp_matches(text, '\\p{{L}}'))
SELECT lang, count(*) AS total, count(*) FILTER (WHERE coalesce(trim(target), '') <> '') AS done FROM s LEFT JOIN t USING (id) GROUP BY lang"""
)
def progress(spark, sf_dir):
    rows = known(spark, sf_dir).withColumn("skip", ~F.col("text").rlike("\\p{L}"))
    return ops.progress(rows, targets(spark, sf_dir), "lang")


@query(
    """WITH s AS (SELECT doc_id + 1 AS id, source, length(text) AS n FROM documents),
p AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY floor((id - 1) / 20)) AS part FROM s)
SELECT source, part, count(*) AS segments, CAST(sum(n) AS BIGINT) AS chars, sum(n) > 40000 AS large FROM p GROUP BY source, part"""
)
def part_buckets(spark, sf_dir):
    """Parts of 20 ids for each source, with their size; a part over 40,000 characters is large."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"), "source", F.length("text").alias("n"))
    got = ops.parts(d, 20, "source").groupBy("source", "part").agg(F.count("*").alias("segments"), F.sum("n").alias("chars"))
    return got.withColumn("large", F.col("chars") > 40000)


FILES_SQL = """f AS (SELECT conv_id AS file_id, max(turn) + 1 AS max_id FROM conversations GROUP BY conv_id),
o AS (SELECT *, CAST(coalesce(sum(max_id) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM f)"""


def files(spark, sf_dir):
    return segments(spark, sf_dir).groupBy(F.col("conv_id").alias("file_id")).agg(F.max("id").alias("max_id")).withColumn("ord", F.col("file_id"))


@query(f'WITH {FILES_SQL} SELECT file_id, max_id, "offset" FROM o')
def batch_offsets(spark, sf_dir):
    return ops.offsets(files(spark, sf_dir)).drop("ord")


@query(
    f"""WITH {FILES_SQL}, g AS (SELECT DISTINCT doc_id AS gid FROM documents)
SELECT gid, coalesce(file_id, -1) AS file_id, coalesce(gid - "offset", -1) AS id FROM g LEFT JOIN o ON gid BETWEEN "offset" + 1 AND "offset" + max_id"""
)
def id_to_file(spark, sf_dir):
    got = ops.to_file(known(spark, sf_dir).select(F.col("id").alias("gid")), files(spark, sf_dir))
    return got.select("gid", F.coalesce("file_id", F.lit(-1)).alias("file_id"), F.coalesce("id", F.lit(-1)).alias("id"))


@query(
    """WITH a AS (SELECT doc_id AS id, md5(text) AS key FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS id, md5(text) AS key FROM documents WHERE doc_id % 3 <> 1),
x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS k FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS k FROM b)
SELECT y.id, x.id AS old_id FROM y JOIN x USING (key, k)"""
)
def occurrence_match(spark, sf_dir):
    """Even documents are the old file and those not 1 modulo 3 the new one; equal texts are matched in turn."""
    d = known(spark, sf_dir).select("id", F.md5("text").alias("key"))
    return ops.by_occurrence(d.where("id % 2 = 0"), d.where("id % 3 <> 1"))


@query(
    """WITH b AS (SELECT doc_id AS id, 'b' || doc_id % 5 AS target FROM documents WHERE doc_id % 2 = 0),
i AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'i' ELSE 'b' || doc_id % 5 END AS target FROM documents WHERE doc_id % 4 <> 3),
c AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'c' ELSE 'b' || doc_id % 5 END AS target FROM documents WHERE doc_id % 2 = 0),
j AS (SELECT id, coalesce(b.target, '') AS b, coalesce(i.target, '') AS i, coalesce(c.target, '') AS c FROM b FULL JOIN i USING (id) FULL JOIN c USING (id)),
r AS (SELECT id, CASE WHEN i <> b AND c <> i THEN i ELSE c END AS target, i <> b AND c <> i AS changed FROM j)
SELECT * FROM r WHERE target <> '' OR changed"""
)
def three_way_merge(spark, sf_dir):
    d = known(spark, sf_dir).select("id")
    was = F.concat(F.lit("b"), (F.col("id") % 5).cast("string"))
    base = d.where("id % 2 = 0").select("id", was.alias("target"))
    incoming = d.where("id % 4 <> 3").select("id", F.when(F.col("id") % 11 == 0, "").when(F.col("id") % 3 == 0, "i").otherwise(was).alias("target"))
    current = d.where("id % 2 = 0").select("id", F.when(F.col("id") % 7 == 0, "c").otherwise(was).alias("target"))
    return ops.three_way(base, incoming, current)


@query("SELECT doc_id AS old_id, row_number() OVER (ORDER BY source, doc_id) AS id FROM documents")
def renumbered_segments(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return ops.renumbered(d, "source")


@query(
    """WITH n AS (SELECT DISTINCT source, doc_id AS n FROM documents), g AS (SELECT *, n - row_number() OVER (PARTITION BY source ORDER BY n) AS g FROM n),
r AS (SELECT source, g, min(n) AS a, max(n) AS b FROM g GROUP BY source, g)
SELECT source, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r GROUP BY source"""
)
def id_ranges(spark, sf_dir):
    """Ids of each source, which have gaps where other sources' ids are."""
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("n"))
    return ops.id_ranges(d, "source")


@query(
    f"""WITH {TARGETS_SQL}, s AS (SELECT doc_id AS id, text FROM documents), m AS (SELECT doc_id AS id, text FROM documents),
h AS (SELECT lower(trim(regexp_replace(text, '[ \\t\\n\\r\\x{{00A0}}]+', ' ', 'g'))) AS key, min(id) AS first FROM s JOIN t USING (id) WHERE trim(target) <> '' GROUP BY 1)
SELECT m.id, t.target FROM m LEFT JOIN h ON lower(trim(regexp_replace(m.text, '[ \\t\\n\\r\\x{{00A0}}]+', ' ', 'g'))) = h.key LEFT JOIN t ON t.id = h.first"""
)
def bookmark_targets(spark, sf_dir):
    """Every document is a bookmark; the texts here have neither leader dots nor section numbers."""
    d = known(spark, sf_dir).select("id", "text")
    return ops.bookmark_targets(d, d.join(targets(spark, sf_dir).select("id", "target"), "id"))


@query(
    """WITH a AS (SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS id FROM labels)
SELECT 'union' AS op, count(*) AS n FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT id FROM a INTERSECT SELECT id FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a) UNION ALL SELECT 'union_all', count(*) FROM (SELECT id FROM a UNION ALL SELECT id FROM b)"""
)
def id_sets(spark, sf_dir):
    a, b = known(spark, sf_dir).where("id % 2 = 0").select("id"), targets(spark, sf_dir).select("id")
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": b.subtract(a), "union_all": a.unionByName(b)}
    out = None
    for op, df in made.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out
