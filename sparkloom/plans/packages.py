"""Files of other formats, written from the tables and read back; the SQL says what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources import exchange, html, markdown, packages
from ..sources.tables import table
from .registry import query
from .selections import new_rows, vocabulary, HAVE_SQL

#: A text's letters, in lines of their own and without markup.
PLAIN_SQL = "trim(regexp_replace(text, '[^\\p{L}]+', ' ', 'g'))"


def letters():
    return F.trim(F.regexp_replace("text", "[^\\p{L}]+", " "))


def turns(spark, sf_dir):
    """(file, id, text) of conversations with the letters of their turns."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("id"), letters().alias("text"))


TURNS_SQL = f"t AS (SELECT conv_id AS file, turn + 1 AS id, {PLAIN_SQL} AS text FROM conversations)"


def filed(rows, item, kind, ending):
    """(path, ``kind``) with one array for each file."""
    own = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))).alias("own"))
    return own.select(F.concat(F.col("file").cast("string"), F.lit(ending)).alias("path"), F.transform("own", lambda o: o["x"]).alias(kind))


@query(
    f"""WITH d AS (SELECT doc_id, lang, source, {PLAIN_SQL} AS words, n_chars FROM documents),
s AS (SELECT doc_id, unnest([{{'k': 0, 'tag': 'h', 'level': 1, 'text': source}}, {{'k': 1, 'tag': 'p', 'level': 0, 'text': words}}, {{'k': 2, 'tag': 'li', 'level': 0, 'text': lang || chr(10) || '  more'}},
  {{'k': 3, 'tag': 'li', 'level': 0, 'text': CAST(doc_id AS VARCHAR)}}, {{'k': 4, 'tag': 'quote', 'level': 0, 'text': source}}, {{'k': 5, 'tag': 'td', 'level': 0, 'text': CAST(doc_id AS VARCHAR)}}, {{'k': 6, 'tag': 'td', 'level': 0, 'text': lang}},
  {{'k': 7, 'tag': 'td', 'level': 0, 'text': CAST(n_chars AS VARCHAR)}}, {{'k': 8, 'tag': 'td', 'level': 0, 'text': 'a' || chr(92) || '|b'}}, {{'k': 9, 'tag': 'h', 'level': 2, 'text': 'end of' || chr(10) || source}}]) AS s FROM d)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s.k) - 1 AS INTEGER) AS no, s.tag AS tag, s.level AS level, s.text AS text FROM s WHERE s.text <> ''"""
)
def markdown_segments(spark, sf_dir):
    """Documents laid out as Markdown, their raw text as code between the other blocks."""
    n = F.col("doc_id").cast("string")
    code = F.replace("text", F.lit("`"), F.lit("'"))
    parts = ("---\nlang: ", "lang", "\n---\n# ", "source", " ##\n\n", letters(), "\n\n```py\n", code, "\n```\n***\n- ", "lang", "\n  more\n- [x] ", n, "\n> ", "source", "\n| ", n, " | ", "lang", " |\n|---|:-:|\n| ",
             F.col("n_chars").cast("string"), " | a\\|b |\n\n<div>\n", "source", "\n</div>\n\n[l]: http://x\nend of\n", "source", "\n---\n")
    names = {"lang", "source"}
    text = F.concat(*(F.col(p) if isinstance(p, str) and p in names else F.lit(p) if isinstance(p, str) else p for p in parts))
    return markdown.segments(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))


@query(f"WITH {TURNS_SQL} SELECT file, 'cue ' || id || ' --> ' || (id + 1) AS timing, text FROM t WHERE text <> ''")
def subtitle_cues(spark, sf_dir):
    """Turns as subtitles, with notes between them that are no cues."""
    cue = F.concat(F.col("id").cast("string"), F.lit("\r\ncue "), F.col("id").cast("string"), F.lit(" --> "), (F.col("id") + 1).cast("string"), F.lit("\r\n"), "text", F.lit("\r\n\r\nNOTE none\r\n"))
    own = filed(turns(spark, sf_dir), cue, "all", "")
    return own.select(F.col("path").cast("long").alias("file"), F.inline(exchange.cues(F.array_join("all", "\r\n"))))


@query(f"WITH {TURNS_SQL} SELECT file, id, text AS target FROM t WHERE text <> ''")
def inline_markers(spark, sf_dir):
    """Markers of several kinds inside one line."""
    n = F.col("id")
    mark = F.when(n % 3 == 0, F.concat(F.lit("**[["), n.cast("string"), F.lit("]]** "))).when(n % 3 == 1, F.concat(F.lit("【【"), n.cast("string"), F.lit("】 "))).otherwise(F.concat(F.lit("[[ "), n.cast("string"), F.lit(" ]] ")))
    own = filed(turns(spark, sf_dir), F.concat(mark, "text"), "all", "")
    return exchange.read_markers_inline(own.select(F.col("path").cast("long").alias("file"), F.concat(F.lit("before "), F.array_join("all", " ")).alias("text")))


@query(
    f"""WITH {TURNS_SQL} SELECT file || CASE file % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.json' WHEN 2 THEN '.csv' ELSE '.xlf' END AS file, id, text AS target FROM t WHERE text <> ''"""
)
def any_format(spark, sf_dir):
    """Files of all exchange formats in one table, told apart by name or beginning."""
    own = filed(turns(spark, sf_dir).where("text <> ''"), F.struct("id", F.col("text").alias("target")), "s", "")
    no = lambda x: x["id"].cast("string")
    lines = lambda make: F.array_join(F.transform("s", make), "\n")
    made = {
        ".txt": lines(lambda x: F.concat(F.lit("[["), no(x), F.lit("]]\n"), x["target"])), ".json": F.to_json(F.struct(F.col("s").alias("segments"))),
        ".csv": F.concat(F.lit("id;target\n"), lines(lambda x: F.concat(no(x), F.lit(';"'), x["target"], F.lit('"')))),
        ".xlf": F.concat(F.lit("<xliff>"), lines(lambda x: F.concat(F.lit('<unit id="'), no(x), F.lit('"><segment><target>'), x["target"], F.lit("</target></segment></unit>"))), F.lit("</xliff>")),
    }
    kind = F.col("path").cast("long") % 4
    ending, text = (F.coalesce(*(F.when(kind == i, v) for i, v in enumerate(vs))) for vs in (map(F.lit, made), made.values()))
    files = own.select(F.concat("path", ending).alias("file"), text.alias("text"))
    # Above an aggregate the readers see a column, not the expression that makes it.
    return exchange.read_any(files.groupBy("file").agg(F.first("text").alias("text")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE lang || ' = ' || source || chr(10) || 'x = y' END AS block FROM documents")
def keyword_blocks(spark, sf_dir):
    """The keyword lines of a marked text; every third has none."""
    head = F.when(F.col("doc_id") % 3 == 2, "").otherwise(F.concat(F.lit("[[ Keywords ]]\n"), "lang", F.lit(" = "), "source", F.lit("\nx = y")))
    text = F.concat(F.lit("[[1]]\na\n"), head, F.lit("\n[[2]]\nb"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(exchange.keyword_block(text), F.lit("")).alias("block"))


@query("SELECT doc_id, lang AS term, source AS translation, CASE WHEN doc_id % 2 = 0 THEN 'e' || doc_id ELSE '' END AS example, CASE WHEN doc_id % 4 = 0 THEN 'f' ELSE '' END AS example_tr FROM documents")
def vocabulary_text(spark, sf_dir):
    """Vocabulary lines cut at tabs, semicolons or equals signs, with examples in cells of their own or below."""
    n = F.col("doc_id")
    e = F.concat(F.lit("e"), n.cast("string"))
    line = (
        F.when(n % 4 == 0, F.concat_ws("\t", "lang", "source", e, F.lit("f"))).when(n % 4 == 2, F.concat_ws("\t", F.concat("lang", F.lit("<br>"), e), F.concat(F.lit("<b>"), "source", F.lit("</b>"))))
        .when(n % 4 == 1, F.concat_ws(";", "lang", "source")).otherwise(F.concat_ws(" = ", "lang", "source"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(exchange.vocabulary_rows(F.concat(F.lit("#head:tab\n\n"), line, F.lit("\nbad\n")))))


@query(
    f"""WITH {HAVE_SQL}, r AS (SELECT row_number() OVER (ORDER BY pair, term) AS ord, term, first, last FROM h)
SELECT ord, term || '<br><i>x' || last || '</i>' || chr(9) || 'o' || first || chr(9) || 'mine' AS text FROM r
UNION ALL SELECT * FROM (VALUES (-5, '#separator:tab'), (-4, '#html:true'), (-3, '#notetype:Basic'), (-2, '#deck:d'), (-1, '#tags column:3'))"""
)
def deck_lines(spark, sf_dir):
    """A vocabulary as the text of a card deck."""
    from pyspark.sql import Window

    v = vocabulary(spark, sf_dir).withColumn("ord", F.row_number().over(Window.orderBy("pair", "term")).cast("long"))
    return exchange.deck_text(v, "d", "mine")


@query(f"WITH {HAVE_SQL} SELECT pair, term, 'o' || first AS translation, 'x' || last AS example, CAST(2 AS INTEGER) AS seen, CAST(first % 5 AS INTEGER) AS known, first % 2 = 0 AS fav FROM h")
def vocabulary_backup(spark, sf_dir):
    """A vocabulary written as backup texts and read back."""
    v = vocabulary(spark, sf_dir)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.schema)
    return exchange.read_backup(exchange.backup(v), schema).select("pair", "term", "translation", "example", "seen", "known", "fav")


@query("SELECT doc_id AS file, sha256(CASE WHEN length(text) > 30 AND doc_id % 5 <> 0 THEN 'HEAD' || substring(text, 6, 15) || '[' || lang || ']' || substring(text, 31) ELSE text END) AS text FROM documents")
def spliced_texts(spark, sf_dir):
    """Two places of a text replaced; every fifth has no edits."""
    d = table(spark, sf_dir, "documents")
    some = d.where("length(text) > 30 and doc_id % 5 <> 0").select(F.col("doc_id").alias("file"), "lang")
    first = some.select("file", F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("HEAD").alias("value"))
    second = some.select("file", F.lit(20).alias("start"), F.lit(30).alias("end"), F.concat(F.lit("["), "lang", F.lit("]")).alias("value"))
    return exchange.spliced(second.unionByName(first), d.select(F.col("doc_id").alias("file"), "text")).select("file", F.sha2("text", 256).alias("text"))


@query(f"WITH {TURNS_SQL} SELECT file || '.docx' AS file, id, text AS target FROM t WHERE text <> ''")
def word_exchange(spark, sf_dir):
    """Turns as a Word file with markers, and back."""
    own = filed(turns(spark, sf_dir).where("text <> ''"), F.struct("id", "text"), "segments", ".docx")
    got = packages.segments(packages.write_docs(own), "docx")
    text = got.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("no", "text"))).alias("p"))
    return exchange.read_markers(text.select(F.col("path").alias("file"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")))


def entry(name, *parts):
    return F.struct(name.alias("name") if not isinstance(name, str) else F.lit(name).alias("name"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("text"))


def joined(array, make):
    return F.array_join(F.transform(array, make), "")


@query(f"WITH {TURNS_SQL}, p AS (SELECT DISTINCT file FROM t) SELECT file || '.zip' AS path, CAST(0 AS INTEGER) AS no, 'a/' || file || '.txt' AS name, CAST((SELECT sum(strlen(text)) FROM t WHERE t.file = p.file) AS BIGINT) AS size FROM p")
def zip_directory(spark, sf_dir):
    own = filed(turns(spark, sf_dir), F.col("text"), "all", ".zip")
    name = F.concat(F.lit("a/"), F.replace("path", F.lit(".zip"), F.lit(".txt")))
    made = packages.write_zips(own.select("path", F.array(entry(name, F.array_join("all", ""))).alias("entries")))
    return packages.zip_entries(made).select("path", "no", "name", "size")


@query(
    f"""WITH {TURNS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY id DESC) AS r FROM t WHERE text <> '')
SELECT file || '.epub' AS path, CAST(r AS INTEGER) AS no, 'OPS/c' || id || '.xhtml' AS part, 'p' AS tag, text, false AS hidden FROM k UNION ALL SELECT DISTINCT file || '.epub', CAST(0 AS INTEGER), 'OPS/b.opf', 'title', 'Book ' || file, true FROM k"""
)
def epub_segments(spark, sf_dir):
    """Turns as the pages of an e-book whose spine goes backwards."""
    own = filed(turns(spark, sf_dir).where("text <> ''"), F.struct("id", "text"), "s", ".epub")
    book = F.replace("path", F.lit(".epub"), F.lit(""))
    no = lambda x: x["id"].cast("string")
    pages = F.transform("s", lambda x: F.struct(F.concat(F.lit("OPS/c"), no(x), F.lit(".xhtml")).alias("name"), F.concat(F.lit("<html><head><title>no</title></head><body><p>"), x["text"], F.lit("</p></body></html>")).alias("text")))
    opf = entry("OPS/b.opf", "<package><metadata><title>Book ", book, "</title></metadata><manifest>", joined("s", lambda x: F.concat(F.lit('<item id="i'), no(x), F.lit('" href="c'), no(x), F.lit('.xhtml"/>'))),
                "</manifest><spine>", joined(F.reverse("s"), lambda x: F.concat(F.lit('<itemref idref="i'), no(x), F.lit('"/>'))), "</spine></package>")
    box = entry("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>')
    made = packages.write_zips(own.select("path", F.concat(F.array(box, opf), pages).alias("entries")))
    return packages.segments(made, "epub").select("path", "no", "part", "tag", "text", "hidden")


@query(
    f"""WITH {TURNS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY id) AS r FROM t WHERE text <> '')
SELECT file || CASE WHEN file % 2 = 0 THEN '.fb2' ELSE '.fb2.zip' END AS path, CAST(r AS INTEGER) AS no, CASE WHEN id % 3 = 0 THEN 'v' ELSE 'p' END AS tag, text, false AS hidden FROM k
UNION ALL SELECT DISTINCT file || CASE WHEN file % 2 = 0 THEN '.fb2' ELSE '.fb2.zip' END, CAST(0 AS INTEGER), 'book-title', 'Book ' || file, true FROM k"""
)
def fictionbook_segments(spark, sf_dir):
    """Turns as paragraphs and verses of books, every other one zipped."""
    own = filed(turns(spark, sf_dir).where("text <> ''"), F.struct("id", "text"), "s", "")
    tag = lambda x: F.when(x["id"] % 3 == 0, "v").otherwise("p")
    body = joined("s", lambda x: F.concat(F.lit("<"), tag(x), F.lit(">"), x["text"], F.lit("</"), tag(x), F.lit(">")))
    text = F.concat(F.lit("<FictionBook><description><title-info><book-title>Book "), "path", F.lit("</book-title></title-info></description><body><section>"), body, F.lit("</section></body><binary>AAAA</binary></FictionBook>"))
    books = own.select("path", text.alias("text"))
    even = F.col("path").cast("long") % 2 == 0
    zipped = packages.write_zips(books.where(~even).select(F.concat("path", F.lit(".fb2.zip")).alias("path"), F.array(entry("b.fb2", F.col("text"))).alias("entries")))
    plain = books.where(even).select(F.concat("path", F.lit(".fb2")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return packages.segments(plain.unionByName(zipped), "fb2").select("path", "no", "tag", "text", "hidden")


@query(
    f"""WITH {TURNS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY id DESC) - 1 AS r FROM t WHERE text <> '')
SELECT file || '.pptx' AS path, CAST(r AS INTEGER) AS no, 'ppt/slides/s' || id || '.xml' AS part, text, id % 4 = 0 AS hidden FROM k"""
)
def slide_segments(spark, sf_dir):
    """Turns as slides that are shown from the last to the first, every fourth hidden."""
    own = filed(turns(spark, sf_dir).where("text <> ''"), F.struct("id", "text"), "s", ".pptx")
    no = lambda x: x["id"].cast("string")
    ns = 'xmlns:a="a" xmlns:r="r"'
    slides = F.transform("s", lambda x: F.struct(F.concat(F.lit("ppt/slides/s"), no(x), F.lit(".xml")).alias("name"), F.concat(F.lit(f'<sld {ns} show="'), F.when(x["id"] % 4 == 0, "0").otherwise("1"), F.lit('"><a:p><a:r><a:t>'), x["text"], F.lit("</a:t></a:r></a:p></sld>")).alias("text")))
    shown = entry("ppt/presentation.xml", f"<presentation {ns}>", joined(F.reverse("s"), lambda x: F.concat(F.lit('<sldId id="1" r:id="r'), no(x), F.lit('"/>'))), "</presentation>")
    rels = entry("ppt/_rels/presentation.xml.rels", "<Relationships>", joined("s", lambda x: F.concat(F.lit('<Relationship Id="r'), no(x), F.lit('" Target="slides/s'), no(x), F.lit('.xml"/>'))), "</Relationships>")
    made = packages.write_zips(own.select("path", F.concat(F.array(shown, rels), slides).alias("entries")))
    return packages.segments(made, "pptx").select("path", "no", "part", "text", "hidden")


@query(
    f"""WITH {TURNS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY id) - 1 AS r FROM t WHERE text <> '')
SELECT file || '.xlsx' AS path, CAST(r AS INTEGER) AS no, 'Sheet' AS sheet, 'A' || id AS cell, CASE id % 3 WHEN 0 THEN 's' WHEN 1 THEN 'inlineStr' ELSE 'n' END AS type, CASE id % 3 WHEN 2 THEN CAST(id AS VARCHAR) ELSE text END AS value FROM k"""
)
def spreadsheet_cells(spark, sf_dir):
    """Turns as cells: shared strings, strings of their own and numbers."""
    own = filed(turns(spark, sf_dir).where("text <> ''"), F.struct("id", "text"), "s", ".xlsx")
    ref = lambda x: F.concat(F.lit('<c r="A'), x["id"].cast("string"))
    cell = lambda x, i: (
        F.when(x["id"] % 3 == 0, F.concat(ref(x), F.lit('" t="s"><v>'), i.cast("string"), F.lit("</v></c>")))
        .when(x["id"] % 3 == 1, F.concat(ref(x), F.lit('" t="inlineStr"><is><t>'), x["text"], F.lit("</t></is></c>"))).otherwise(F.concat(ref(x), F.lit('"><v>'), x["id"].cast("string"), F.lit("</v></c>")))
    )
    entries = F.array(
        entry("xl/workbook.xml", '<workbook xmlns:r="http://r"><sheets><sheet name="Sheet" r:id="r1"/></sheets></workbook>'), entry("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>'),
        entry("xl/sharedStrings.xml", "<sst>", joined("s", lambda x: F.concat(F.lit("<si><t>"), x["text"], F.lit("</t></si>"))), "</sst>"),
        entry("xl/worksheets/s.xml", "<worksheet><sheetData><row>", F.array_join(F.transform("s", cell), ""), "</row></sheetData></worksheet>"),
    )
    return packages.cells(packages.write_zips(own.select("path", entries.alias("entries")))).select("path", "no", "sheet", "cell", "type", "value")


@query(f"WITH {HAVE_SQL} SELECT pair AS path, term, 'o' || first AS translation, 'x' || last AS example, '' AS example_tr FROM h")
def deck_round_trip(spark, sf_dir):
    """A vocabulary as card decks, and back."""
    v = vocabulary(spark, sf_dir)
    own = v.groupBy(F.col("pair").alias("path")).agg(F.array_sort(F.collect_list(F.struct("term", "translation", "example", "example_tr"))).alias("notes"))
    return packages.decks(packages.write_decks(own, "words")).select("path", "term", "translation", "example", "example_tr")


@query(
    """SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' WHEN 3 THEN 'gif' WHEN 4 THEN 'ole' WHEN 5 THEN 'epub' WHEN 6 THEN 'fb2' WHEN 7 THEN 'zip' WHEN 8 THEN 'vtt' WHEN 9 THEN 'srt' WHEN 10 THEN 'md' ELSE 'pdf' END AS kind FROM documents"""
)
def file_kinds(spark, sf_dir):
    """Kinds of files by their first bytes, then by their names."""
    heads = ("25504446", "FFD8FFE0", "89504E470D0A", "474946383961", "D0CF11E0A1B1", "504B0304", "504B0304", "504B0304", "574542565454", "", "", "")
    names = ("a.txt", "a.pdf", "a", "a.jpg", "a.doc", "A.EPUB", "a.fb2.zip", "a.bin", "a.xyz", "a.srt", "a.MD", "a.unknown")
    n = (F.col("doc_id") % 12).cast("int") + 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), n)
    return table(spark, sf_dir, "documents").select("doc_id", exchange.kind_of(F.concat(F.unhex(pick(heads)), F.encode("lang", "UTF-8")), pick(names)).alias("kind"))


@query("SELECT doc_id, sha256(text) AS text FROM documents")
def decoded_files(spark, sf_dir):
    """Texts in several encodings, told apart by their marks and bytes."""
    t, n = F.col("text"), F.col("doc_id")
    western = t.rlike("^[\\x00-\\x7F\\x{A0}-\\x{FF}]*$")
    raw = (
        F.when(n % 5 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8"))).when(n % 5 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE")))
        .when(n % 5 == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE"))).when((n % 5 == 3) & western, F.encode(F.when(western, t), "ISO-8859-1")).otherwise(F.encode(t, "UTF-8"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fn.decoded(raw), 256).alias("text"))


@query("SELECT conv_id AS file, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(ceil(count(*) / 4) AS BIGINT) AS parts FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def prompt_sizes(spark, sf_dir):
    """Segments, characters and parts of four segments that a prompt for a file has."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return c.groupBy(F.col("conv_id").alias("file")).agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"), F.ceil(F.count("*") / 4).alias("parts"))


@query(
    """SELECT doc_id, unnest([0, 1, 2])::INTEGER AS no, unnest(['h1', 'p', 'li']) AS tag, unnest([source, 'A <1>' || lang || ' <2>i</2></1> x' || chr(10) || 'y <3/>', doc_id || ' & co']) AS text FROM documents"""
)
def book_segments(spark, sf_dir):
    """A page of a book for each document: blocks with numbered inline tags; heads, scripts and blocks without words are left out."""
    n = F.col("doc_id").cast("string")
    parts = ("<html><head><title>no</title></head><body><h1>", F.col("source"), "</h1>\n<p>A <b>", F.col("lang"), " <i>i</i></b> x<br/>y <img src='i'/></p><script>no()</script><p>--</p><ul><li><span>", n, " &amp; co</span></li></ul></body></html>")
    page = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return html.segments(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), page.alias("html"))).withColumnRenamed("page_id", "doc_id")
