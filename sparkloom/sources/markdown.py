"""Segments of Markdown texts, in DataFrame functions only.

Every line gets a letter for the kind of block that it may begin or go on with, from its own characters alone. What
depends on the lines around it is then one regular expression over the letters of a text, one letter a line: a match is a block, and
its length the number of lines it has. Lines that are indented by two characters or more have a small letter, as
they may belong to the list item above.

Segments are headings, paragraphs, list items, lines of quotes and cells of tables. Front matter, fenced code, HTML blocks,
definitions of links and rules are blocks without a segment. Null and empty texts have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, with_starts

_MARGIN = "^[ ]{0,3}"
#: Letter and pattern of a line's kind; the first that matches decides.
KINDS = (
    ("B", r"^\s*$"),  # blank
    ("F", _MARGIN + r"`{3,}\s*$"),  # fence without a language: it may open or close code
    ("J", _MARGIN + r"`{3}"),  # fence that can only open
    ("G", _MARGIN + r"~{3,}\s*$"),
    ("K", _MARGIN + r"~{3}"),
    ("D", r"^-{3}\s*$"),  # three hyphens: edge of front matter, rule, or underline
    ("E", r"^[.]{3}\s*$"),
    ("S", _MARGIN + r"-{3,}\s*$"),  # rule or underline
    ("N", _MARGIN + r"-{1,2}$"),  # underline only
    ("U", _MARGIN + r"=+\s*$"),
    ("R", _MARGIN + r"(?:(?:[*]\s*){3,}|(?:_\s*){3,}|(?:-\s*){3,})$"),  # rule only
    ("H", _MARGIN + r"<\w"),  # HTML
    ("L", _MARGIN + r"\[[^\]]+\]:\s"),  # definition of a link
    ("A", _MARGIN + r"#{1,6}(?:\s|$)"),  # heading
    ("M", _MARGIN + r"(?=[^|]*[|])[-:|\s]*-{3}[-:|\s]*$"),  # line below a table's head
    ("O", _MARGIN + r"[|]"),  # row of a table
    ("Q", r"^\s*>"),
    ("I", r"^\s*(?:[0-9]+[.)]|[-+*])\s"),
    ("V", r"[|]"),  # row of a table if the line below a head says so
)
#: Blocks as runs of letters, in the order in which they are tried; any other line is a block of its own.
BLOCKS = "|".join((
    r"\A(?-i:D[^DE]*[DE])",  # front matter
    r"[FJ][^F]*(?:F|\z)", r"[GK][^G]*(?:G|\z)",  # code up to its fence or the end
    r"H[^B]*",
    r"(?:V(?=[MDS])|[MO])[MOV]*",  # tables
    r"(?-i:[Ii][a-hj-z]*)",
    r"[PNUEV][PLREV]*[UDSN]?",  # paragraphs, and headings with a line below them
    r".",
))
_SEGMENT = "struct<tag:string,level:int,text:string>"


def _letter(line: Column) -> Column:
    kind = F.lit("P")
    for letter, pattern in reversed(KINDS):
        kind = F.when(line.rlike(pattern), letter).otherwise(kind)
    return F.when(line.rlike(r"^\s{2,}\S"), F.lower(kind)).otherwise(kind)


def _segments(letters: Column, own: Column) -> Column:
    """What a block of lines ``own`` with these letters is made of."""
    first, head = F.upper(F.left(letters, F.lit(1))), own[0]
    whole = F.array_join(own, "\n")
    made = lambda tag, text, level=F.lit(0): F.struct(F.lit(tag).alias("tag"), level.cast("int").alias("level"), text.alias("text"))
    none = F.array().cast(f"array<{_SEGMENT}>")
    hashes = F.length(F.regexp_extract(head, r"^\s*(#+)", 1))
    title = F.regexp_replace(F.regexp_replace(head, r"^\s*#+", ""), r"\s#+\s*$", "")
    item = F.regexp_replace(whole, r"\A\s*(?:[0-9]+[.)]|[-+*])\s+(?:\[[ xX]\]\s+)?", "")
    rows = F.filter(F.transform(own, lambda r, i: F.struct(r.alias("r"), F.substring(letters, i + 1, F.lit(1)).alias("k"))), lambda x: ~F.lower(x["k"]).isin("m", "d", "s"))
    cells = F.flatten(F.transform(rows, lambda x: F.transform(F.split(x["r"], r"(?<!\\)[|]"), lambda c: made("td", c))))
    lined = (F.length(letters) > 1) & F.upper(F.right(letters, F.lit(1))).isin("U", "D", "S", "N")
    above = F.array_join(F.slice(own, F.lit(1), F.size(own) - 1), "\n")
    level = F.when(F.upper(F.right(letters, F.lit(1))) == "U", 1).otherwise(2)
    table = first.isin("M", "O") | ((first == "V") & F.upper(F.substring(letters, 2, 1)).isin("M", "D", "S"))
    # Blocks that begin with a letter of these and are longer than one line have been taken as front matter or code.
    return (
        F.when(first == "A", F.array(made("h", title, hashes)))
        .when(first == "I", F.array(made("li", item)))
        .when(first == "Q", F.array(made("quote", F.regexp_replace(head, r"^\s*>", ""))))
        .when(table, cells)
        .when(first.isin("P", "N", "U", "E", "V") & lined, F.array(made("h", above, level)))
        .when(first.isin("P", "N", "U", "E", "V"), F.array(made("p", whole)))
        .otherwise(none)
    )


def blocks(text: Column) -> Column:
    """Array of (tag, level, text): tags h, p, li, quote and td; level is that of a heading, else 0."""

    def placed(doc: Column) -> Column:
        runs = F.regexp_extract_all(doc["letters"], F.lit(f"(?i){BLOCKS}"), F.lit(0))
        place = lambda at, run: F.struct(at.alias("at"), run.alias("run"))
        spans = with_starts(runs, lambda run: F.length(run), place, "struct<at:int,run:string>")
        found = F.flatten(F.transform(spans, lambda s: _segments(s["run"], F.slice(doc["lines"], s["at"] + 1, F.length(s["run"])))))
        trimmed = F.transform(found, lambda x: x.withField("text", F.regexp_replace(x["text"], r"^\s+|\s+$", "")))
        return F.filter(trimmed, lambda x: x["text"] != "")

    lettered = lambda lines: F.struct(lines.alias("lines"), F.array_join(F.transform(lines, _letter), "").alias("letters"))
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    return bound(bound(lines, lettered), placed)


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, no, tag, level, text), no from 0."""
    return docs.select("doc_id", F.posexplode(blocks(F.col("text"))).alias("no", "s")).select("doc_id", "no", "s.tag", "s.level", "s.text")
