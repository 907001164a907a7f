"""Exports and imports of conversations as files, and pages as books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources import exchange, html
from ..sources.tables import table
from .registry import query

ROWS_SQL = """r AS (SELECT conv_id AS file, turn + 1 AS id, turn // 10 AS page, text AS source, CASE WHEN turn % 3 = 0 THEN 'T: ' || text WHEN turn % 3 = 1 THEN '' END AS target FROM conversations)"""
XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def rows(spark, sf_dir):
    """Turns as segments; every third has a target, the whole turn, and every third an empty one."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("id"), F.floor(F.col("turn") / 10).cast("int").alias("page"), F.col("text").alias("source"))
    kind = (F.col("id") - 1) % 3
    return c.withColumn("target", F.when(kind == 0, F.concat(F.lit("T: "), F.col("source"))).when(kind == 1, ""))


@query(f"WITH {ROWS_SQL} SELECT file, string_agg('[[' || id || ']]' || chr(10) || coalesce(nullif(target, ''), source) || chr(10), chr(10) ORDER BY id) AS text FROM r GROUP BY file")
def export_markers(spark, sf_dir):
    return exchange.write_markers(rows(spark, sf_dir))


CELL = """CASE WHEN regexp_matches({0}, '[",\\r\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""


@query(
    f"""WITH {ROWS_SQL} SELECT file, chr(65279) || 'id,page,source,target' || chr(13) || chr(10) || string_agg(id || ',' || (page + 1) || ',' || {CELL.format('source')} || ',' ||
{CELL.format("coalesce(target, '')")}, chr(13) || chr(10) ORDER BY id) || chr(13) || chr(10) AS text FROM r GROUP BY file"""
)
def export_csv(spark, sf_dir):
    return exchange.write_csv(rows(spark, sf_dir))


@query(
    f"""WITH {ROWS_SQL} SELECT file, CAST(to_json({{'document': CAST(file AS VARCHAR), 'segments': list({{'id': id, 'page': page + 1, 'source': source, 'target': coalesce(target, '')}} ORDER BY id)}}) AS VARCHAR) AS text
FROM r GROUP BY file"""
)
def export_json(spark, sf_dir):
    return exchange.write_json(rows(spark, sf_dir))


@query(
    f"""WITH {ROWS_SQL} SELECT file, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2">' || chr(10) ||
'  <file original="' || file || '" source-language="en" datatype="plaintext">' || chr(10) || '    <body>' || chr(10) ||
string_agg('      <trans-unit id="' || id || '">' || chr(10) || '        <source>' || {XML.format('source')} || '</source>' || chr(10) ||
CASE WHEN coalesce(target, '') <> '' THEN '        <target state="translated">' || {XML.format('target')} || '</target>' || chr(10) ELSE '' END ||
'        <note>page ' || (page + 1) || '</note>' || chr(10) || '      </trans-unit>', chr(10) ORDER BY id) || chr(10) || '    </body>' || chr(10) || '  </file>' || chr(10) || '</xliff>' || chr(10) AS text
FROM r GROUP BY file"""
)
def export_xliff(spark, sf_dir):
    return exchange.write_xliff(rows(spark, sf_dir))


BACK_SQL = f"""WITH {ROWS_SQL}, b AS (SELECT file, id, regexp_replace(coalesce(nullif(target, ''), {{}}, ''), '^\\s+|\\s+$', '', 'g') AS target FROM r)
SELECT * FROM b WHERE target <> ''"""


@query(BACK_SQL.format("source"))
def import_markers(spark, sf_dir):
    """What the marker export gives back: every segment, targets or else sources."""
    return exchange.read_markers(exchange.write_markers(rows(spark, sf_dir)))


@query(BACK_SQL.format("NULL"))
def import_csv(spark, sf_dir):
    return exchange.read_csv(exchange.write_csv(rows(spark, sf_dir)))


@query(BACK_SQL.format("NULL"))
def import_json(spark, sf_dir):
    return exchange.read_json(exchange.write_json(rows(spark, sf_dir)))


@query(BACK_SQL.format("NULL"))
def import_xliff(spark, sf_dir):
    return exchange.read_xliff(exchange.write_xliff(rows(spark, sf_dir)))


@query(
    """WITH l AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)
SELECT item_id, w[1] AS term, w[2] AS translation, CASE WHEN item_id % 2 = 0 THEN w[3] ELSE '' END AS example, '' AS example_tr FROM l WHERE len(w) > 3 AND regexp_matches(w[1], '^\\p{L}+$') AND regexp_matches(w[2], '^\\p{L}+$') AND regexp_matches(w[3], '^\\p{L}+$')"""
)
def glossary_rows(spark, sf_dir):
    """Benchmark items made into glossary lines and read back."""
    w = F.split("text", " ")
    b = table(spark, sf_dir, "benchmark").where((F.size(w) > 3) & w[0].rlike("^\\p{L}+$") & w[1].rlike("^\\p{L}+$") & w[2].rlike("^\\p{L}+$"))
    line = F.concat(F.lit("- "), w[0], F.lit(" = "), w[1], F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" | "), w[2])).otherwise(""))
    return b.select("item_id", F.inline(exchange.glossary_rows(F.concat(F.lit("en -> de\n"), line))))


HTML_SQL = "html"
for _pattern, _by in (("\\[sound:[^\\]]*\\]", ""), ("(?i)<br[^>]*>|</(?:p|div|li|tr|h[1-6])>", "\n"), ("<[^>]*>", "")):
    HTML_SQL = f"regexp_replace({HTML_SQL}, '{_pattern}', '{_by}', 'g')"
for _name, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    HTML_SQL = f"replace({HTML_SQL}, '{_name}', '{_sign}')"
HTML_SQL = f"regexp_replace(regexp_replace(regexp_replace({HTML_SQL}, '[ \\t]+', ' ', 'g'), '[ \\t]*\\n[ \\t\\n]*', '\n', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


@query(f"SELECT page_id, sha256({HTML_SQL}) AS text FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(fn.html_to_text(F.col("html")), 256).alias("text"))


@query()
def html_segments(spark, sf_dir):
    """Blocks of the pages with numbered inline tags; a scanner, which SQL can't express."""
    return html.segments(table(spark, sf_dir, "pages"))
