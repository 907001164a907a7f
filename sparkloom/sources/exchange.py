"""Exchange formats: numbered markers, CSV, JSON, XLIFF, glossaries and subtitles.

Segments are (file, id, page, source), targets (file, id, target). Writers give one text for each
file, so a file's segments meet in one row; files are what a person translates. Readers take
(file, text), and of equal ids the last wins; blank values are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound, cut, pieces
from ..functions.text import ascii_digits, xml_escaped

#: Two opening and two closing brackets of any of these kinds; ids in any decimal digits.
_OPEN, _CLOSE = "[\\[［【〔(（<«]", "[\\]］】〕)）>»]"
_DIGIT = "\\p{Nd}"
MARKER = f"^\\s*{_OPEN}{{2}}\\s*#?\\s*({_DIGIT}+)\\s*{_CLOSE}{{2}}\\s*(.*)$"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def with_targets(segments: DataFrame, targets: DataFrame) -> DataFrame:
    return segments.join(targets.select("file", "id", "target"), ["file", "id"], "left")


def _by_file(rows: DataFrame, line: Column, separator: str = "\n") -> DataFrame:
    own = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("all"))
    return own.select("file", F.array_join(F.transform("all", lambda x: x["line"]), separator).alias("text"))


def write_markers(rows: DataFrame) -> DataFrame:
    """'[[id]]', then target or else source, then an empty line; only an empty target gives way to the source."""
    value = F.coalesce(F.nullif("target", F.lit("")), F.col("source"))
    return _by_file(rows, F.concat(F.lit("[["), F.col("id").cast("string"), F.lit("]]\n"), value, F.lit("\n")))


def csv_cell(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\\r\\n]'), quoted).otherwise(value)


def write_csv(rows: DataFrame) -> DataFrame:
    """id,page,source,target with a byte order mark; pages from 1; no target is an empty cell."""
    cells = F.concat_ws(",", F.col("id").cast("string"), (F.col("page") + 1).cast("string"), csv_cell(F.col("source")), csv_cell(F.coalesce("target", F.lit(""))))
    return _by_file(rows, cells, "\r\n").select("file", F.concat(F.lit("\ufeffid,page,source,target\r\n"), "text", F.lit("\r\n")).alias("text"))


def write_json(rows: DataFrame) -> DataFrame:
    """{"document", "segments": [{"id", "page" (from 1), "source", "target"}]}."""
    one = F.struct("id", (F.col("page") + 1).alias("page"), "source", F.coalesce("target", F.lit("")).alias("target"))
    own = rows.groupBy("file").agg(F.array_sort(F.collect_list(one)).alias("segments"))
    return own.select("file", F.to_json(F.struct(F.col("file").cast("string").alias("document"), "segments")).alias("text"))


def write_xliff(rows: DataFrame, source: str = "en", target: str = "") -> DataFrame:
    """XLIFF 1.2, a trans-unit for each segment; a target element only if there is a target."""
    unit = F.concat(
        F.lit('      <trans-unit id="'), F.col("id").cast("string"), F.lit('">\n        <source>'), xml_escaped(F.col("source")), F.lit("</source>\n"),
        F.when(F.coalesce("target", F.lit("")) != "", F.concat(F.lit('        <target state="translated">'), xml_escaped(F.col("target")), F.lit("</target>\n"))).otherwise(""),
        F.lit("        <note>page "), (F.col("page") + 1).cast("string"), F.lit("</note>\n      </trans-unit>"),
    )
    body = _by_file(rows, unit)
    name = F.replace(F.replace(xml_escaped(F.col("file").cast("string")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    lang = f' source-language="{source or "en"}"' + (f' target-language="{target}"' if target else "") + ' datatype="plaintext">'
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2">\n  <file original="'
    return body.select("file", F.concat(F.lit(head), name, F.lit(f'"{lang}\n    <body>\n'), "text", F.lit("\n    </body>\n  </file>\n</xliff>\n")).alias("text"))


def read_markers(files: DataFrame) -> DataFrame:
    """(file, id, target) of marked texts: a marker starts a line, its rest and the lines up to the next are the value.

    Lines are rows, numbered by the markers up to them in their file; what has no marker before it is left out.
    """
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("text", "\\r\\n?", "\n"), "\n")).alias("ord", "x"))
    no = F.when(F.col("x").rlike(MARKER), ascii_digits(F.regexp_extract("x", MARKER, 1)).try_cast("long"))
    marked = lines.withColumn("no", no).withColumn("nth", F.count("no").over(Window.partitionBy("file").orderBy("ord")))
    part = F.struct("ord", F.when(F.col("no").isNotNull(), F.regexp_extract("x", MARKER, 2)).otherwise(F.col("x")).alias("x"))
    values = marked.where("nth > 0").groupBy("file", "nth").agg(F.max("no").alias("id"), F.array_sort(F.collect_list(part)).alias("parts"))
    rows = values.select("file", "nth", "id", _stripped(F.array_join(F.transform("parts", lambda p: p["x"]), "\n")).alias("target"))
    return rows.where("target <> ''").groupBy("file", "id").agg(F.max_by("target", "nth").alias("target"))


def read_json(files: DataFrame) -> DataFrame:
    """(file, id, target) of {"segments": [...]}, of a bare list, or of a map from id to text."""
    item = "array<struct<id:string,target:string,translation:string>>"
    wrapped = F.from_json("text", f"struct<segments:{item}>")["segments"]
    bare = F.when(F.col("text").rlike("^\\s*\\["), F.from_json("text", item))
    listed = F.transform(F.coalesce(wrapped, bare), lambda x: F.struct(x["id"].alias("id"), F.coalesce(F.nullif(x["target"], F.lit("")), x["translation"]).alias("target")))
    mapped = F.transform(F.map_entries(F.from_json("text", "map<string,string>")), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("target")))
    rows = files.select("file", F.posexplode(F.coalesce(listed, mapped)).alias("ord", "s"))
    good = rows.select("file", "ord", F.trim("s.id").try_cast("long").alias("id"), _stripped(F.col("s.target")).alias("target")).where("id is not null and target <> ''")
    return good.groupBy("file", "id").agg(F.max_by("target", "ord").alias("target"))


def read_xliff(files: DataFrame) -> DataFrame:
    """(file, id, target) of XLIFF 1.2 trans-units and 2.0 units; the texts of all targets of a unit are put together."""
    unit = F.regexp_extract_all("text", F.lit("(?s)<(?:[a-z]+:)?(?:trans-)?unit\\b[^>]*>.*?</(?:[a-z]+:)?(?:trans-)?unit>"), F.lit(0))
    rows = files.select("file", F.posexplode(unit).alias("ord", "u"))
    inner = F.regexp_extract_all("u", F.lit("(?s)<(?:[a-z]+:)?target\\b[^>]*>(.*?)</(?:[a-z]+:)?target>"), F.lit(1))
    text = F.array_join(F.transform(inner, lambda x: F.regexp_replace(x, "<[^>]*>", "")), "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    got = rows.select("file", "ord", F.trim(F.regexp_extract("u", "\\bid\\s*=\\s*[\"']([^\"']*)[\"']", 1)).try_cast("long").alias("id"), F.regexp_replace(text, "^\\s+|\\s+$", "").alias("target"))
    return got.where("id is not null and target <> ''").groupBy("file", "id").agg(F.max_by("target", "ord").alias("target"))


def csv_delimiter(text: Column) -> Column:
    """The one of comma, semicolon and tab that the first line has most of."""
    head = F.split_part(F.regexp_replace(text, "^\ufeff", ""), F.lit("\n"), F.lit(1))
    count = lambda c: F.length(head) - F.length(F.replace(head, F.lit(c), F.lit("")))
    return F.when((count(";") > count(",")) & (count(";") >= count("\t")), ";").when(count("\t") > count(","), "\t").otherwise(",")


def read_csv(files: DataFrame) -> DataFrame:
    """(file, id, target): quoted cells may hold delimiters and line feeds; with no 'id' in the first row, the first cell is the id and
    the last the target; else target, translation or translated, or the last."""
    clean = F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), "\\r\\n?", "\n")
    d = csv_delimiter(F.col("text"))
    sep = F.when(d == "\t", "\\t").otherwise(d)
    # One cell and what ends it, each as a group of its own; a row ends with a line feed or the text.
    cell = F.concat(F.lit('("(?:[^"]|"")*+"|[^'), sep, F.lit('\\n"]*+)('), sep, F.lit("|\\n|\\z)"))
    cells, ends = F.regexp_extract_all(clean, cell, F.lit(1)), F.regexp_extract_all(clean, cell, F.lit(2))
    both = F.arrays_zip(cells.alias("c"), ends.alias("e"))
    bare = lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    state = F.struct(F.array().cast("array<string>").alias("row"), F.array().cast("array<array<string>>").alias("rows"))
    step = lambda s, x: F.when(
        x["e"].isin("\n", ""), F.struct(F.array().cast("array<string>").alias("row"), F.concat(s["rows"], F.array(F.concat(s["row"], F.array(bare(x["c"]))))).alias("rows"))
    ).otherwise(F.struct(F.concat(s["row"], F.array(bare(x["c"]))).alias("row"), s["rows"].alias("rows")))
    table = files.select("file", F.aggregate(both, state, step, lambda s: s["rows"]).alias("rows"))
    head = F.transform(F.get("rows", F.lit(0)), lambda c: F.lower(F.trim(c)))
    place = lambda *names: F.coalesce(*(F.nullif(F.array_position("head", n), F.lit(0)) for n in names), F.size("head")).cast("int")
    laid = table.withColumn("head", head).withColumn("named", F.array_contains("head", "id"))
    laid = laid.withColumn("i", F.when(F.col("named"), F.array_position("head", "id").cast("int")).otherwise(1)).withColumn(
        "t", F.when(F.col("named"), place("target", "translation", "translated")).otherwise(F.size("head"))
    )
    rows = laid.select("file", "i", "t", "named", F.posexplode("rows").alias("ord", "row")).where("not named or ord > 0")
    got = rows.select("file", "ord", F.trim(F.get("row", F.col("i") - 1)).try_cast("long").alias("id"), _stripped(F.get("row", F.col("t") - 1)).alias("target"))
    return got.where("id is not null and target <> ''").groupBy("file", "id").agg(F.max_by("target", "ord").alias("target"))


def glossary_rows(block: Column) -> Column:
    """Array of (term, translation, example, example_tr): lines 'term = translation | example | its translation'."""
    lines = F.transform(F.split(block, "\\r?\\n"), lambda x: F.trim(F.regexp_replace(x, "^\\s*(?:[-*•]|\\d+[.)])\\s*", "")))

    def row(x: Column) -> Column:
        parts = F.split(x, "\\s\\|\\s")
        pair, colon = "^(.+?)\\s*(?:=|—|–|->|→|\\t)\\s*(.+)$", "^(.+?):\\s+(.+)$"
        first = parts[0]
        get = lambda i: F.when(first.rlike(pair), F.regexp_extract(first, pair, i)).when(first.rlike(colon), F.regexp_extract(first, colon, i))
        more = lambda i: F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
        return F.struct(F.trim(get(1)).alias("term"), F.trim(get(2)).alias("translation"), more(1).alias("example"), more(2).alias("example_tr"))

    language = "(?i)^(?:sprachen|languages?|langs?)?\\s*:?\\s*([a-z]{2,3})\\s*(?:→|->|–|-|>|⇒)\\s*([a-z]{2,3})\\s*$"
    made = F.transform(F.filter(lines, lambda x: (x != "") & ~x.rlike(language)), row)
    return F.filter(made, lambda r: r["term"].isNotNull())


def vocabulary_rows(text: Column) -> Column:
    """Array of (term, translation, example, example_tr): lines cut at tabs, else semicolons, else ' = ' or an arrow; '#' lines are skipped."""
    lines = F.filter(F.split(text, "\\r?\\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))

    def plain(c: Column) -> Column:
        c = F.regexp_replace(F.regexp_replace(c, "(?i)<br\\s*/?>", "\n"), "<[^>]+>", "")
        for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            c = F.replace(c, F.lit(name), F.lit(sign))
        return F.regexp_replace(c, "^\\s+|\\s+$", "")

    def row(x: Column) -> Column:
        cut = F.when(x.contains("\t"), F.split(x, "\t")).when(x.contains(";"), F.split(x, ";")).otherwise(F.split(x, "\\s(?:=|→|->)\\s"))
        cells = F.transform(cut, plain)
        inner = lambda i, k: F.coalesce(F.get(F.split(F.coalesce(F.get(cells, F.lit(i)), F.lit("")), "\n"), F.lit(k)), F.lit(""))
        far = lambda i, k: F.when(F.size(cells) > 3, F.get(cells, F.lit(i + 2))).otherwise(inner(i, k))
        return F.struct(inner(0, 0).alias("term"), inner(1, 0).alias("translation"), far(0, 1).alias("example"), far(1, 1).alias("example_tr"))

    return F.filter(F.transform(lines, row), lambda r: (r["term"] != "") & (r["translation"] != ""))


def cues(text: Column, vtt: bool = False) -> Column:
    """Array of (timing, text) of SRT or WebVTT: blocks between blank lines with a '-->' line that is not their last."""
    blocks = F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\n[ \\t]*\n\\s*")
    blocks = F.slice(blocks, F.lit(2), F.size(blocks)) if vtt else blocks
    pattern = "(?s)^(?:(?!-->).)*?([^\\n]*-->[^\\n]*)\\n(.*\\S.*)$"
    hit = F.filter(blocks, lambda b: b.rlike(pattern))
    return F.transform(hit, lambda b: F.struct(F.trim(F.regexp_extract(b, pattern, 1)).alias("timing"), F.regexp_replace(F.regexp_extract(b, pattern, 2), "\\s+$", "").alias("text")))


def kind_of(content: Column, name: Column) -> Column:
    """A file's kind by its first bytes, then its name; pdf if nothing says otherwise."""
    head, low = F.hex(F.substring(content, 1, 16)), F.lower(name)
    by_bytes = (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E47"), "png").when(head.startswith("47494638"), "gif")
        .when(head.startswith("424D"), "bmp").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff").when(head.startswith("D0CF11E0"), "ole")
    )
    zipped = F.when(head.startswith("504B0304"), F.when(low.rlike("\\.(?:epub|docx|pptx|xlsx|apkg)$"), F.regexp_extract(low, "\\.([a-z0-9]+)$", 1)).when(low.endswith(".fb2.zip"), "fb2").otherwise("zip"))
    by_name = F.when(low.rlike("\\.(?:fb2|srt|vtt|md|txt)$"), F.regexp_extract(low, "\\.([a-z0-9]+)$", 1))
    text = F.when(F.hex(F.substring(content, 1, 6)) == "574542565454", "vtt")
    return F.coalesce(by_bytes, zipped, text, by_name, F.lit("pdf"))


def keyword_block(text: Column) -> Column:
    """The lines from a [[keywords]] line up to the next numbered marker; null without one."""
    pattern = "(?is)(?:^|\\n)[ \\t]*\\[\\[[ \\t]*keywords[ \\t]*\\]\\][ \\t]*\\n?(.*?)(?=\\n[ \\t]*\\[\\[[ \\t]*[0-9]+[ \\t]*\\]\\]|\\z)"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def deck_text(rows: DataFrame, name: str, tag: str) -> DataFrame:
    """(ord, text): lines of a card deck, in order, for the text writer: a head of directives (ord -5 to -1), then term, translation and tag by tabs,
    examples in italics below."""

    def clean(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\\t", " "), "\\r?\\n", "<br>")

    side = lambda c, e: F.concat(clean(c), F.when(F.coalesce(e, F.lit("")) != "", F.concat(F.lit("<br><i>"), clean(e), F.lit("</i>"))).otherwise(""))
    line = F.concat_ws("\t", side("term", "example"), side("translation", "example_tr"), F.lit(tag))
    head = ("#separator:tab", "#html:true", "#notetype:Basic", f"#deck:{name}", "#tags column:3")
    top = rows.sparkSession.range(len(head)).select((F.col("id") - len(head)).alias("ord"), F.element_at(F.array(*map(F.lit, head)), (F.col("id") + 1).cast("int")).alias("text"))
    return top.unionByName(rows.select(F.col("ord").cast("long").alias("ord"), line.alias("text"))).repartitionByRange("ord").sortWithinPartitions("ord")


def spliced(edits: DataFrame, files: DataFrame) -> DataFrame:
    """(file, text): replacements (file, start, end, value) put into each file's text by their places; files without any stay as they are.

    Places count code points and don't overlap. Time is in proportion to the text.
    """
    own = edits.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "value"))).alias("e"))

    def made(x: Column) -> Column:
        part = lambda a, b: cut(x["parts"], a, b - a)
        before = lambda i: F.when(i > 0, F.get(x["e"], i - 1)["end"]).otherwise(0)
        changed = F.transform(x["e"], lambda e, i: F.concat(part(before(i), e["start"]), e["value"]))
        return F.concat(F.array_join(changed, ""), part(F.element_at(x["e"], -1)["end"], x["n"]))

    new = bound(F.struct(pieces(F.col("text")).alias("parts"), F.length("text").alias("n"), F.col("e").alias("e")), made)
    return files.join(own, "file", "left").select("file", F.when(F.col("e").isNull(), F.col("text")).otherwise(new).alias("text"))


def read_any(files: DataFrame) -> DataFrame:
    """(file, id, target) of texts of any exchange format, by name or by how they begin: XLIFF, JSON, CSV and TSV, else markers."""
    low, head = F.lower("file"), F.regexp_replace("text", "^[\\s\ufeff]+", "")
    kind = (
        F.when(low.rlike("\\.xli?ff?$") | (head.startswith("<") & F.substring(head, 1, 500).contains("xliff")), "xliff")
        .when(low.endswith(".json") | head.rlike("^[{\\[](?!\\[)"), "json").when(low.rlike("\\.[ct]sv$"), "csv").otherwise("markers")
    )
    sorted_ = files.withColumn("kind", kind)
    readers = {"xliff": read_xliff, "json": read_json, "csv": read_csv, "markers": read_markers}
    out = None
    for name, read in readers.items():
        part = read(sorted_.where(F.col("kind") == name).select("file", "text"))
        out = part if out is None else out.unionByName(part)
    return out


def read_markers_inline(files: DataFrame) -> DataFrame:
    """(file, id, target) of marked texts whose markers may stand inside a line.

    A marker has three brackets or more of one kind that close as they open, and may be bold. Inside a line it counts only if
    ids go up. Markdown escapes are undone where a marker is escaped.
    """
    opens, closes = "[［【〔(（<«", "]］】〕)）>»"
    kinds = "|".join(f"\\{o}{{{{{a}}}}}\\s*#?\\s*({_DIGIT}+)\\s*\\{c}{{{{{b}}}}}" for o, c in zip(opens, closes) for a, b in ((2, 2), (2, 1), (1, 2)))
    kinds = kinds.replace("{{", "{").replace("}}", "}")
    marker = f"(?:\\*\\*)?(?:{kinds})(?:\\*\\*)?"
    clean = F.regexp_replace("text", "\\r\\n?", "\n")
    clean = F.when(clean.rlike(f"\\\\\\[\\s*(?:\\\\?\\[)?\\s*{_DIGIT}+\\s*\\\\?\\]"), F.regexp_replace(clean, "\\\\([\\\\`*_{}\\[\\]()#+.!|~<>-])", "$1")).otherwise(clean)
    gaps, hits = F.split("c", marker, -1), F.regexp_extract_all("c", F.lit(marker), F.lit(0))
    rows = files.select("file", clean.alias("c")).select("file", gaps.alias("g"), hits.alias("h"))
    number = lambda x: ascii_digits(F.regexp_replace(x, "[^\\p{Nd}]", "")).try_cast("long")
    item = "struct<id:bigint,target:string>"
    state = F.struct(F.lit(None).cast("long").alias("id"), F.lit("").alias("buf"), F.lit("").alias("line"), F.array().cast(f"array<{item}>").alias("out"))
    tail = lambda line, x: F.when(x.contains("\n"), F.regexp_extract(x, "([^\\n]*)\\z", 1)).otherwise(F.concat(line, x))

    def flushed(s: Column) -> Column:
        keep = s["id"].isNotNull() & (_stripped(s["buf"]) != "")
        return F.when(keep, F.concat(s["out"], F.array(F.struct(s["id"].alias("id"), _stripped(s["buf"]).alias("target"))))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        no = number(x["h"])
        take = (F.trim(s["line"]) == "") | s["id"].isNull() | (no > s["id"])
        new = F.struct(no.alias("id"), x["g"].alias("buf"), tail(F.lit("x"), x["g"]).alias("line"), flushed(s).alias("out"))
        more = F.struct(s["id"].alias("id"), F.concat(s["buf"], x["h"], x["g"]).alias("buf"), tail(F.concat(s["line"], x["h"]), x["g"]).alias("line"), s["out"].alias("out"))
        return F.when(take, new).otherwise(more)

    first = F.struct(F.lit(None).cast("long").alias("id"), F.lit("").alias("buf"), tail(F.lit(""), F.get("g", F.lit(0))).alias("line"), state["out"].alias("out"))
    near = F.arrays_zip(F.col("h").alias("h"), F.slice("g", F.lit(2), F.size("h")).alias("g"))
    got = rows.select("file", F.posexplode(F.aggregate(near, first, step, flushed)).alias("ord", "s")).select("file", "ord", "s.*")
    return got.groupBy("file", "id").agg(F.max_by("target", "ord").alias("target"))


def backup(vocabulary: DataFrame) -> DataFrame:
    """One JSON text per pair of a vocabulary, in an envelope with kind and version."""
    rows = F.array_sort(F.collect_list(F.struct(*sorted(c for c in vocabulary.columns if c != "pair"))))
    own = vocabulary.groupBy("pair").agg(rows.alias("rows"))
    return own.select("pair", F.to_json(F.struct(F.lit("vocabulary").alias("kind"), F.lit(1).alias("version"), "pair", "rows")).alias("text"))


def read_backup(files: DataFrame, schema: str) -> DataFrame:
    """Vocabulary rows of backup texts, given the vocabulary's schema; anything else gives none."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    inner = StructType([f for f in fields if f.name != "pair"]).simpleString()
    parsed = F.from_json("text", f"struct<kind:string,version:int,pair:string,rows:array<{inner}>>")
    good = files.select(parsed.alias("p")).where("p.kind = 'vocabulary' and p.version = 1")
    return good.select("p.pair", F.inline("p.rows")).select(fields.names)
