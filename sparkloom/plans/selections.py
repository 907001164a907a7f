"""Selections, merges and progress over segments. Conversations are files with segments: system turns are numbers that are skipped,
every third turn has a target, every fifth is hidden by a repeat; events are words of a vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines, reconcile, selection, study
from ..sources.tables import table
from .registry import query

SEGMENTS_SQL = """s AS (SELECT conv_id * 1000 + turn AS id, conv_id AS doc_id, turn // 2 AS page, role = 'system' AS skip, text, CASE WHEN turn % 3 = 0 THEN 'T ' || text WHEN turn % 3 = 1 THEN ' ' END AS target,
  CASE WHEN turn % 4 = 0 THEN 'x' END AS extra, turn FROM conversations), v AS (SELECT * FROM s WHERE NOT skip AND turn % 5 <> 4)"""


def segments(spark, sf_dir):
    n = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + n).alias("id"), F.col("conv_id").alias("doc_id"), F.floor(n / 2).alias("page"), (F.col("role") == "system").alias("skip"), "text",
        F.when(n % 3 == 0, F.concat(F.lit("T "), "text")).when(n % 3 == 1, " ").alias("target"), F.when(n % 4 == 0, "x").alias("extra"), "turn",
    )


def hidden(spark, sf_dir):
    return segments(spark, sf_dir).where("turn % 5 = 4").select("id")


@query(f"WITH {SEGMENTS_SQL} SELECT id, sha256(text) AS text FROM v")
def translatable_segments(spark, sf_dir):
    return selection.translatable(segments(spark, sf_dir), hidden(spark, sf_dir)).select("id", F.sha2("text", 256).alias("text"))


@query(
    f"""WITH {SEGMENTS_SQL} SELECT 'todo' AS list, id FROM v WHERE trim(coalesce(target, '')) = '' UNION ALL SELECT 'done', id FROM v WHERE trim(coalesce(target, '')) <> ''
UNION ALL SELECT 'numbers', id FROM s WHERE skip UNION ALL SELECT 'extra', id FROM v WHERE extra IS NOT NULL UNION ALL SELECT 'first page', id FROM v WHERE page = 0
UNION ALL SELECT 'found', id FROM v WHERE regexp_matches(text, 'the') OR regexp_matches(coalesce(target, ''), 'the') UNION ALL SELECT 'found in targets', id FROM v WHERE regexp_matches(coalesce(target, ''), 'the')"""
)
def listed_segments(spark, sf_dir):
    """Segments of the lists by status, page and search."""
    s, h = segments(spark, sf_dir), hidden(spark, sf_dir)
    asked = {"todo": {"status": "todo"}, "done": {"status": "done"}, "numbers": {"status": "numbers"}, "extra": {"status": "extra"}, "first page": {"page": 0}, "found": {"pattern": "the"}, "found in targets": {"pattern": "the", "scope": "tr"}}
    out = None
    for name, how in asked.items():
        part = selection.listed(s, h, **how).select(F.lit(name).alias("list"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {SEGMENTS_SQL} SELECT id FROM s WHERE NOT skip AND page BETWEEN 0 AND 1 AND trim(coalesce(target, '')) = ''")
def asked_segments(spark, sf_dir):
    """Segments of the first two pages that a translator is asked for."""
    return selection.asked(segments(spark, sf_dir), 1, 2, True).select("id")


VOCABULARY_SQL = """w AS (SELECT user_id, event_id, props AS term, event_type AS translation, CAST(event_id % 7 AS INTEGER) AS known, event_id % 3 = 0 AS fav, ts FROM events)"""


def words(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.col("props").alias("term"), F.col("event_type").alias("translation"), F.lit("").alias("example"), F.lit(None).cast("string").alias("example_tr"),
                    (F.col("event_id") % 7).cast("int").alias("known"), (F.col("event_id") % 3 == 0).alias("fav"), "ts")


@query(
    f"""WITH {VOCABULARY_SQL} SELECT 'learning' AS list, event_id FROM w WHERE known BETWEEN 1 AND 3 UNION ALL SELECT 'favourites', event_id FROM w WHERE fav AND known >= 4
UNION ALL SELECT 'found', event_id FROM w WHERE contains(lower(term || ' ' || translation), 'k": 1') UNION ALL SELECT 'due', event_id FROM w WHERE ts <= TIMESTAMP '2024-01-10'"""
)
def vocabulary_lists(spark, sf_dir):
    """A vocabulary by stage, favourites, text and due time."""
    w = words(spark, sf_dir)
    stage, due = study.stage(F.col("known")), F.col("ts") <= F.lit("2024-01-10").cast("timestamp_ntz")
    made = {"learning": {"which": "learning"}, "favourites": {"which": "mature", "favourites": True}, "found": {"text": ' K": 1'}, "due": {"which": "due"}}
    out = None
    for name, how in made.items():
        part = selection.vocabulary(w, stage, due, **how).select(F.lit(name).alias("list"), "event_id")
        out = part if out is None else out.unionByName(part)
    return out


WORDS_SQL = """r AS (SELECT l_orderkey AS doc_id, 0 AS page, CAST(l_linenumber // 3 AS BIGINT) AS line, l_partkey, CASE l_partkey % 4 WHEN 0 THEN '--' WHEN 1 THEN '12' WHEN 2 THEN 'abc' ELSE '[' END AS text, l_quantity * 2 AS conf FROM lineitem)"""


def read(spark, sf_dir):
    n = F.col("l_partkey")
    text = F.when(n % 4 == 0, "--").when(n % 4 == 1, "12").when(n % 4 == 2, "abc").otherwise("[")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.floor(F.col("l_linenumber") / 3).alias("line"), "l_partkey", text.alias("text"), (F.col("l_quantity") * 2).alias("conf"))


@query(
    f"""WITH {WORDS_SQL}, m AS (SELECT *, max(conf) OVER (PARTITION BY doc_id, line) >= 60 AS sure FROM r),
k AS (SELECT * FROM m WHERE text <> '[' AND (text <> '--' OR conf >= 80) AND (conf >= 30 OR (sure AND text = 'abc'))),
a AS (SELECT *, bool_or(text <> '--') OVER (PARTITION BY doc_id, line) AS named FROM k)
SELECT doc_id, line, l_partkey, text, conf FROM a WHERE named"""
)
def reader_words(spark, sf_dir):
    """Words of a reader that are kept; lines of orders are its lines, quantities its confidence."""
    return selection.read_words(read(spark, sf_dir)).select("doc_id", "line", "l_partkey", "text", "conf")


@query(f"WITH {WORDS_SQL} SELECT doc_id, CAST(coalesce(sum(CASE WHEN conf >= 60 AND text = 'abc' THEN 3 END), 0) AS BIGINT) AS letters, sum(conf * length(text)) / sum(length(text)) AS conf FROM r GROUP BY doc_id")
def reader_confidence(spark, sf_dir):
    return selection.confidence(read(spark, sf_dir), "doc_id")


@query(
    """WITH w AS (SELECT l_orderkey AS doc_id, l_partkey, l_quantity * 10 AS x, CASE WHEN l_partkey % 2 = 0 THEN 'ab' ELSE '--' END AS text, l_quantity * 2 AS conf FROM lineitem)
SELECT doc_id, 0 AS page, CAST(CASE WHEN x < 250 THEN 1 ELSE 2 END AS INTEGER) AS seg_id, text FROM w WHERE conf < 70 AND text = 'ab' AND x <> 250 AND NOT (x > 250 AND doc_id % 2 = 0)"""
)
def unsure_reader_words(spark, sf_dir):
    """Unsure words in the left or the right half of a page; the right half of even pages has been edited."""
    line = table(spark, sf_dir, "lineitem")
    x = F.col("l_quantity") * 10
    w = line.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), (x - 4).alias("x0"), (x + 4).alias("x1"), F.lit(10.0).alias("y0"), F.lit(20.0).alias("y1"),
                    F.when(F.col("l_partkey") % 2 == 0, "ab").otherwise("--").alias("text"), (F.col("l_quantity") * 2).alias("conf"))
    half = F.array(*(F.struct(F.lit(i).alias("seg_id"), F.lit(a).alias("x0"), F.lit(b).alias("x1")) for i, a, b in ((1, 0.0, 249.0), (2, 251.0, 600.0))))
    s = line.select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.lit(0).alias("page"), F.inline(half)).withColumns({"y0": F.lit(0.0), "y1": F.lit(100.0), "edited": (F.col("seg_id") == 2) & (F.col("doc_id") % 2 == 0)})
    return selection.unsure_words(w, s)


@query(
    f"""WITH {SEGMENTS_SQL} SELECT a.id, (SELECT min(b.id) FROM s b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.id > a.id AND NOT b.skip AND b.turn % 6 <> 5) AS next FROM s a WHERE a.turn % 6 <> 5
UNION ALL SELECT id, NULL FROM s WHERE turn % 6 = 5"""
)
def next_joinable_segments(spark, sf_dir):
    """The segment that each one can be joined with; every sixth turn has a frame."""
    s = segments(spark, sf_dir).withColumns({"frame": F.col("turn") % 6 == 5, "ocr": F.lit(False)})
    return selection.next_joinable(s).select("id", "next")


@query(
    """SELECT o_orderkey AS doc_id, 0 AS page FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 10) AND o_totalprice > 60000"""
)
def scanned_page_list(spark, sf_dir):
    """Orders are pages with one image each; light lines are their segments."""
    o = table(spark, sf_dir, "orders")
    image = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("o_totalprice") / 100).alias("x1"), F.lit(100.0).alias("y1"))
    pages = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.array(image).alias("images"), F.lit(500.0).alias("width"), F.lit(400.0).alias("height"))
    s = table(spark, sf_dir, "lineitem").where("l_quantity < 10").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"))
    return selection.scanned_pages(pages, s)


@query("SELECT DISTINCT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unreferenced_media(spark, sf_dir):
    """Parts are stored media; lines over 45 use them."""
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("key"))
    return selection.unreferenced(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")), used)


@query(
    """WITH c AS (SELECT unnest(string_split(text, '')) AS char FROM documents), g AS (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM benchmark)
SELECT char, count(*) AS n FROM c WHERE char <> '' AND char NOT IN (SELECT char FROM g) GROUP BY char"""
)
def glyphs_missing(spark, sf_dir):
    """Characters of the documents that the benchmark's texts, as a font, don't have."""
    have = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "")).alias("char")).distinct()
    return selection.missing_glyphs(table(spark, sf_dir, "documents").select("text"), have)


@query(
    f"""WITH {SEGMENTS_SQL}, f AS (SELECT doc_id AS ord, count(*) FILTER (WHERE trim(coalesce(target, '')) = '' AND NOT skip) AS todo FROM s GROUP BY doc_id)
SELECT ord, todo FROM f WHERE todo > 1 ORDER BY ord <= 50, ord LIMIT 1"""
)
def next_file_with_work(spark, sf_dir):
    """The file after number 50 with more than one segment to do."""
    todo = F.count_if(~F.col("skip") & (F.trim(F.coalesce("target", F.lit(""))) == ""))
    f = segments(spark, sf_dir).groupBy(F.col("doc_id").alias("ord")).agg(todo.alias("todo"))
    return selection.next_file(f.where("todo > 1"), 50)


@query(
    f"""WITH {SEGMENTS_SQL} SELECT id, CAST(CASE WHEN turn % 4 = 0 THEN 0.5 WHEN turn % 2 = 0 THEN 9 ELSE 10 END AS DOUBLE) AS size, CASE WHEN turn % 3 = 0 THEN true WHEN turn % 3 = 1 THEN false ELSE skip END AS skip,
  CASE WHEN turn % 3 = 0 THEN true ELSE false END AS formula FROM s"""
)
def user_overrides(spark, sf_dir):
    """Sizes that a user has set in place of detected ones, and kinds that a user has chosen."""
    s = segments(spark, sf_dir).select("id", "turn", "skip", F.when(F.col("turn") % 2 == 0, 9.0).otherwise(10.0).alias("size"), F.lit(False).alias("formula"))
    sizes = s.where("turn % 2 = 0").select("id", F.when(F.col("turn") % 4 == 0, 0.5).alias("size"))
    chosen = s.where("turn % 3 < 2").select("id", F.when(F.col("turn") % 3 == 0, "formula").otherwise("text").alias("kind"))
    return reconcile.kinds(reconcile.overridden(s, sizes, "size"), chosen).select("id", "size", "skip", "formula")


@query(f"WITH {SEGMENTS_SQL} SELECT DISTINCT doc_id * 1000 AS id FROM s WHERE doc_id % 3 <> 0")
def unread_formula_leads(spark, sf_dir):
    """Every conversation is a formula group; every third has LaTeX, and every other of the rest a blank one."""
    g = segments(spark, sf_dir).select((F.col("doc_id") * 1000).alias("lead"))
    latex = g.distinct().select(F.col("lead").alias("id"), F.when(F.col("lead") / 1000 % 3 == 0, "x^2").when(F.col("lead") / 1000 % 2 == 0, " ").alias("latex"))
    return reconcile.unread_formulas(g, latex)


@query(f"WITH {SEGMENTS_SQL} SELECT doc_id, count(*) FILTER (WHERE trim(coalesce(target, '')) <> '' OR turn % 5 = 4) AS done FROM s GROUP BY doc_id")
def done_counts(spark, sf_dir):
    """Segments of each file that are done or kept as they are."""
    s = segments(spark, sf_dir)
    return reconcile.done_count(s.select("id", "doc_id"), s.select("id", "target"), hidden(spark, sf_dir), "doc_id")


@query(
    """WITH m AS (SELECT text AS key, conv_id * 1000 + turn AS id, CASE ascii(text) % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'each' ELSE 'once' END AS mode, CASE WHEN turn % 2 = 0 THEN 'T' ELSE '' END || turn AS target FROM conversations),
l AS (SELECT *, first_value(id) OVER w AS lead, first_value(target) OVER w AS own FROM m WINDOW w AS (PARTITION BY key ORDER BY id))
SELECT id, CASE WHEN mode = 'keep' THEN '' WHEN id = lead THEN target ELSE own END AS target FROM l WHERE mode <> 'each' AND target <> CASE WHEN mode = 'keep' THEN '' WHEN id = lead THEN target ELSE own END"""
)
def synced_members(spark, sf_dir):
    """Equal turns are repeats whose mode follows from their first letter; members take their lead's target."""
    mode = F.when(F.ascii("text") % 3 == 0, "keep").when(F.ascii("text") % 3 == 1, "each").otherwise("once")
    target = F.concat(F.when(F.col("turn") % 2 == 0, "T").otherwise(""), F.col("turn").cast("string"))
    m = table(spark, sf_dir, "conversations").select(F.col("text").alias("key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), mode.alias("mode"), "text", target.alias("target"))
    return lines.synced(m)


# The vocabulary: one row for each user and props, made from events; later events are new rows.
HAVE_SQL = """h AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'en-de' ELSE 'en-fr' END AS pair, event_type || user_id AS term, min(event_id) AS first, max(event_id) AS last FROM events WHERE event_id % 3 = 0 GROUP BY ALL),
n AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'en-de' ELSE 'en-fr' END AS pair, event_type || user_id AS term, 't' || event_id AS translation, CASE WHEN event_id % 2 = 0 THEN 'e' || event_id ELSE ' ' END AS example, event_id AS ord, ts FROM events WHERE event_id % 3 <> 0),
a AS (SELECT pair, term, arg_max(translation, ord) AS translation, arg_max(example, ord) FILTER (WHERE trim(example) <> '') AS example, min(ts) AS ts, count(*) AS n FROM n GROUP BY ALL)"""


def pair():
    return F.when(F.col("user_id") % 2 == 0, "en-de").otherwise("en-fr").alias("pair")


def vocabulary(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0")
    own = e.groupBy(pair(), F.concat("event_type", F.col("user_id").cast("string")).alias("term")).agg(F.min("event_id").alias("first"), F.max("event_id").alias("last_id"), F.min("ts").alias("added"))
    return own.select(
        "pair", "term", F.concat(F.lit("o"), F.col("first").cast("string")).alias("translation"), F.concat(F.lit("x"), F.col("last_id").cast("string")).alias("example"), F.lit("").alias("example_tr"), "added",
        F.lit(2).alias("seen"), (F.col("first") % 5).cast("int").alias("known"), F.lit(None).cast("timestamp_ntz").alias("last"), (F.col("first") % 2 == 0).alias("fav"),
    )


def new_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 3 <> 0")
    return e.select(
        pair(), F.concat(F.lit(" "), F.upper("event_type"), F.col("user_id").cast("string")).alias("term"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("translation"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).otherwise(" ").alias("example"), F.lit("").alias("example_tr"), F.col("event_id").alias("ord"), "ts",
    )


@query(
    f"""WITH {HAVE_SQL} SELECT pair, coalesce(h.term, upper(a.term)) AS term, coalesce(a.translation, 'o' || first) AS translation, coalesce(a.example, 'x' || last, '') AS example, CAST(CASE WHEN h.term IS NULL THEN 0 ELSE 2 END + coalesce(n, 0) AS INTEGER) AS seen,
  CAST(coalesce(first % 5, 0) AS INTEGER) AS known FROM h FULL JOIN a USING (pair, term)"""
)
def vocabulary_add(spark, sf_dir):
    """New rows merged into a vocabulary."""
    return study.add_terms(vocabulary(spark, sf_dir), new_rows(spark, sf_dir)).select("pair", "term", "translation", "example", "seen", "known")


@query(
    f"""WITH {HAVE_SQL}, b AS (SELECT pair, term, first FROM h WHERE first % 2 = 0)
SELECT pair, h.term, 'o' || h.first AS translation, CAST(greatest(h.first % 5, coalesce((b.first + 2) % 5, 0)) AS INTEGER) AS known, h.first % 2 = 0 OR b.first IS NOT NULL AS fav FROM h LEFT JOIN b USING (pair, term)
UNION ALL SELECT 'xx-yy', 'new' || first, 'n', 1, false FROM h WHERE first % 4 = 0"""
)
def vocabulary_restore(spark, sf_dir):
    """A backup of half of the rows, known otherwise and favourites, and of some new ones."""
    v = vocabulary(spark, sf_dir)
    first = F.substring("translation", 2, 20).cast("long")
    half = v.where(first % 2 == 0).withColumns({"known": ((first + 2) % 5).cast("int"), "fav": F.lit(True), "translation": F.lit("never taken")})
    fresh = v.where(first % 4 == 0).withColumns({"pair": F.lit("xx-yy"), "term": F.concat(F.lit("new"), first.cast("string")), "translation": F.lit("n"), "known": F.lit(1), "fav": F.lit(False)})
    return study.restore(v, half.unionByName(fresh)).select("pair", "term", "translation", "known", "fav")


@query(
    f"""WITH {HAVE_SQL}, d AS (SELECT term, pair, first, count(*) OVER (PARTITION BY term) AS c FROM h) SELECT CASE WHEN pair = 'en-de' AND first % 2 = 0 THEN 'it-pt' ELSE pair END AS pair, term, 'o' || first AS translation,
  CAST(CASE WHEN pair = 'en-de' AND first % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS seen FROM d"""
)
def vocabulary_move(spark, sf_dir):
    """Half of the rows of a pair moved to a new one."""
    v = vocabulary(spark, sf_dir)
    even = v.where((F.col("pair") == "en-de") & (F.substring("translation", 2, 20).cast("long") % 2 == 0)).select("term")
    return study.moved(v, even, "en-de", "it-pt", F.lit("2024-02-01").cast("timestamp_ntz")).select("pair", "term", "translation", "seen")


@query(
    f"""WITH {HAVE_SQL}, k AS (SELECT term, min(first) AS first, max(last) AS last FROM h GROUP BY term), m AS (SELECT term, arg_max(translation, ord) AS translation, arg_max(example, ord) FILTER (WHERE example <> ' ') AS e, arg_max(example, ord) AS blank FROM n GROUP BY term)
SELECT coalesce(k.term, upper(m.term)) AS term, coalesce(m.translation, 'o' || first) AS translation FROM k FULL JOIN m USING (term)"""
)
def keyword_merge(spark, sf_dir):
    """A document's keywords with new rows merged in by term."""
    v = vocabulary(spark, sf_dir).select("term", "translation", "example", "example_tr")
    rows = new_rows(spark, sf_dir).select(F.trim("term").alias("term"), "translation", "example", "example_tr", "ord")
    return study.merge_keywords(v, rows).select("term", "translation")


@query(
    """WITH t AS (SELECT event_type || '.' AS norm, user_id, event_id, event_type, ts FROM events WHERE user_id <= 20)
SELECT CAST(user_id AS VARCHAR) AS pair, 'the ' || event_type || '!' AS term, string_agg(DISTINCT 'w' || event_id % 4, '; ' ORDER BY 'w' || event_id % 4) AS words, CAST(count(*) AS INTEGER) AS seen, CAST(max(event_id % 6) AS INTEGER) AS known, min(ts) AS added FROM t GROUP BY user_id, event_type"""
)
def duplicate_merge(spark, sf_dir):
    """Spellings of one term put together; the words of their translations are compared in order."""
    e = table(spark, sf_dir, "events").where("user_id <= 20")
    term = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("the "), "event_type", F.lit("!"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("The "), "event_type")).otherwise(F.col("event_type"))
    v = e.select(F.col("user_id").cast("string").alias("pair"), term.alias("term"), F.concat(F.lit("w"), (F.col("event_id") % 4).cast("string")).alias("translation"), F.lit("").alias("example"), F.lit("").alias("example_tr"),
                 F.col("ts").alias("added"), F.lit(1).alias("seen"), (F.col("event_id") % 6).cast("int").alias("known"), "ts", F.lit(False).alias("fav")).withColumnRenamed("ts", "last")
    got = study.merge_duplicates(v)
    return got.select("pair", F.concat(F.lit("the "), F.regexp_extract("term", "([a-z]+)!?$", 1), F.lit("!")).alias("term"), F.array_join(F.array_sort(F.split("translation", "; ")), "; ").alias("words"), "seen", "known", "added")


@query(
    f"""WITH {HAVE_SQL}, b AS (SELECT max(c) AS best FROM (SELECT count(*) AS c FROM h GROUP BY pair)) SELECT best >= greatest(1, floor((SELECT count(DISTINCT term) FROM h) * 0.8)) AS added FROM b"""
)
def deck_is_added(spark, sf_dir):
    """Whether a pair has four fifths of a deck, here of all terms."""
    v = vocabulary(spark, sf_dir)
    return study.deck_added(v.select("term").distinct(), v)


@query(
    """WITH c AS (SELECT user_id, event_id % 20 AS id, max(ts) AS last, CAST(count(*) % 4 AS INTEGER) AS known, max(event_id) % 3 = 0 AS seen FROM events GROUP BY user_id, event_id % 20),
f AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, id) AS r, count(*) FILTER (WHERE seen) OVER (PARTITION BY user_id) AS s FROM c WHERE known <= 0),
d AS (SELECT user_id, id, last + to_days(CASE known WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 7 END) AS due FROM c WHERE known > 0),
u AS (SELECT user_id, id, 0 AS g, r, NULL AS due FROM f WHERE r <= greatest(1, s) UNION ALL SELECT user_id, id, 1, 0, due FROM d WHERE due <= TIMESTAMP '2024-01-30 12:00:00')
SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY g, r, due, id) AS place FROM u"""
)
def study_rounds(spark, sf_dir):
    """Each user's round: new cards up to a cap of one but never fewer than were seen, then the due ones."""
    e = table(spark, sf_dir, "events")
    c = e.groupBy("user_id", (F.col("event_id") % 20).alias("id")).agg(F.max("ts").alias("last"), (F.count("*") % 4).cast("int").alias("known"), (F.max("event_id") % 3 == 0).alias("seen"))
    got = study.round_rows(c, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 1, 0, "user_id")
    return got.select("user_id", "id", F.col("place").cast("long").alias("place"))


@query(
    """WITH RECURSIVE n AS (SELECT conv_id AS doc_id, turn AS id, CASE WHEN turn > 1 THEN turn // 2 END AS parent, -turn AS ord FROM conversations),
t AS (SELECT doc_id, id, [ord] AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.doc_id, n.id, list_append(t.path, n.ord) FROM n JOIN t ON n.doc_id = t.doc_id AND n.parent = t.id)
SELECT doc_id, id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS INTEGER) AS i, CAST(len(path) - 1 AS INTEGER) AS depth FROM t"""
)
def outline_order(spark, sf_dir):
    """Turns as an outline: turn n hangs on turn n / 2, later ones first."""
    n = F.col("turn")
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), n.alias("id"), F.when(n > 1, F.floor(n / 2)).alias("parent"), (-n).alias("ord"))
    return reconcile.outline(items)


@query(
    """WITH l AS (SELECT user_id, event_id AS ord, event_id % 7 AS id, lag('v' || event_id) OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events),
s AS (SELECT user_id, id, 'v' || max(ord) AS target FROM l GROUP BY user_id, id), w AS (SELECT user_id, id, min(ord) AS first FROM l WHERE back <= 5 GROUP BY user_id, id)
SELECT s.user_id, s.id, CASE WHEN w.first IS NULL THEN s.target ELSE l.before END AS target FROM s LEFT JOIN w USING (user_id, id) LEFT JOIN l ON l.user_id = s.user_id AND l.ord = w.first WHERE w.first IS NULL OR l.before IS NOT NULL"""
)
def undone_edits(spark, sf_dir):
    """Each event sets one of a user's seven targets; the last five are undone."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), (F.col("event_id") % 7).alias("id"))
    value = F.concat(F.lit("v"), F.col("ord").cast("string"))
    log = e.withColumn("before", F.lag(value).over(Window.partitionBy("user_id", "id").orderBy("ord")))
    now = e.groupBy("user_id", "id").agg(F.concat(F.lit("v"), F.max("ord").cast("string")).alias("target"))
    return reconcile.undone(now, log, F.lit(5), "user_id")


@query(
    """WITH k AS (SELECT conv_id AS doc_id, turn AS id, role = 'system' AS hidden, regexp_replace(lower('No. ' || turn || ': ' || text), '[\\s\\p{Z}\\x{00AD}]', '', 'g') AS key FROM conversations)
SELECT doc_id, id, start, length FROM (SELECT doc_id, id, hidden, CAST(coalesce(sum(length(key)) OVER (PARTITION BY doc_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(key) AS length FROM k) WHERE NOT hidden"""
)
def laid_out_segments(spark, sf_dir):
    """Turns, numbered, found again in the text of their conversation; system turns are hidden."""
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("turn").alias("id"), F.concat(F.lit("No. "), F.col("turn").cast("string"), F.lit(": "), "text").alias("text"), (F.col("role") == "system").alias("hidden")
    )
    own = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    return reconcile.laid_out(own.select("doc_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text")), c)
