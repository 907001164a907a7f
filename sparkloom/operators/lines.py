"""Lines of texts: classes, repeats, searching and replacing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import with_starts
from ..functions.text import repeat_key

BREAK = "\\r\\n|\\n|\\r"


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, no, line, start): lines with their place in the text, for breaks of one character."""
    rows = docs.select("doc_id", *keep, F.split("text", BREAK).alias("all"))
    make = lambda at, x: F.struct(at.alias("start"), x.alias("line"))
    sized = with_starts(F.col("all"), lambda x: F.length(x) + 1, make, "struct<start:int,line:string>")
    return rows.select("doc_id", *keep, F.posexplode(sized).alias("no", "l")).select("doc_id", *keep, "no", "l.line", "l.start")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, no, text): runs of lines between blank lines, trimmed."""
    parts = F.transform(F.split("text", "(?:\\r\\n|\\n|\\r)[ \\t]*(?:(?:\\r\\n|\\n|\\r)[ \\t]*)+"), lambda p: F.regexp_replace(p, "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", ""))
    return docs.select("doc_id", F.posexplode(F.filter(parts, lambda p: p != "")).alias("no", "text"))


def band_repeats(docs: DataFrame, share: float = 0.3) -> DataFrame:
    """(source, band, norm, docs, lead): first and last lines that come back in a source's documents.

    The source is the file, its documents are the pages; a line needs a letter and ``share`` of the
    pages, at least two. lead is the first document with it.
    """
    all_ = F.split("text", BREAK)
    ends = F.array(
        F.struct(F.lit("top").alias("band"), all_[0].alias("line")),
        F.struct(F.lit("bottom").alias("band"), F.element_at(all_, -1).alias("line")),
    )
    rows = docs.select("doc_id", "source", F.explode(ends).alias("e")).select("doc_id", "source", "e.band", repeat_key(F.col("e.line")).alias("norm"))
    found = rows.where(F.col("norm").rlike("\\p{L}")).groupBy("source", "band", "norm").agg(F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("lead"))
    pages = docs.groupBy("source").agg(F.greatest(F.lit(2), F.ceil(F.count("*") * share)).alias("need"))
    return found.join(pages, "source").where("docs >= need").select("source", "band", "norm", "docs", "lead")


def repeated_lines(docs: DataFrame, least: int = 2) -> DataFrame:
    """(norm, docs, n, lead): lines with a letter that come back in ``least`` documents."""
    rows = docs.select("doc_id", F.explode(F.split("text", BREAK)).alias("line")).select("doc_id", repeat_key(F.col("line")).alias("norm"))
    per = rows.where(F.col("norm").rlike("\\p{L}")).groupBy("norm", "doc_id").agg(F.count("*").alias("c"))
    return per.groupBy("norm").agg(F.count("*").alias("docs"), F.sum("c").alias("n"), F.min("doc_id").alias("lead")).where(F.col("docs") >= least)


def hidden_ids(groups: DataFrame) -> DataFrame:
    """Members that a repeat hides: for mode 'keep' all, for 'once' all but the lead, else none.

    ``groups(key, id, mode)``.
    """
    lead = groups.groupBy("key").agg(F.min("id").alias("lead"))
    return groups.join(lead, "key").where("mode = 'keep' or (mode = 'once' and id <> lead)").select("id").distinct()


def search_pattern(text: str, case: bool = False, word: bool = False) -> str:
    """A literal as pattern; whole words stand beside no letter, digit or underscore."""
    out = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)
    out = rf"(?<![\p{{L}}\p{{N}}_]){out}(?![\p{{L}}\p{{N}}_])" if word else out
    return out if case else "(?iu)" + out


def matches(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, no, start, length) of all hits, by code points from zero."""
    gaps, hits = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    near = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("g"), hits.alias("h"))
    width = lambda x: F.length(x["g"]) + F.length(x["h"])
    make = lambda at, x: F.struct((at + F.length(x["g"])).alias("start"), F.length(x["h"]).alias("length"))
    placed = with_starts(near, width, make, "struct<start:int,length:int>")
    rows = docs.where(F.col("text").rlike(pattern)).select("doc_id", F.posexplode(placed).alias("no", "m"))
    return rows.select("doc_id", "no", "m.start", "m.length")


def replaced(docs: DataFrame, pattern: str, by: str) -> DataFrame:
    """(doc_id, hits, text) of the documents that the pattern hits."""
    n = F.regexp_count("text", F.lit(pattern))
    return docs.where(F.col("text").rlike(pattern)).select("doc_id", n.alias("hits"), F.regexp_replace("text", pattern, by).alias("text"))


def number_transfer(tr: Column, lead: Column, text: Column) -> Column:
    """A lead's translation for another member: its numbers, in turn, replaced by the member's, if both texts have equally many."""
    a, b = F.regexp_extract_all(lead, F.lit("[0-9]+"), F.lit(0)), F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    hits, gaps = F.regexp_extract_all(tr, F.lit("[0-9]+"), F.lit(0)), F.split(tr, "[0-9]+", -1)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<int>").alias("used"))

    def step(s: Column, d: Column) -> Column:
        free = F.filter(F.transform(a, lambda v, i: F.when((v == d) & ~F.array_contains(s["used"], i), i)), lambda i: i.isNotNull())
        k = F.get(free, F.lit(0))
        return F.struct(
            F.concat(s["out"], F.array(F.coalesce(F.get(b, k), d))).alias("out"),
            F.concat(s["used"], F.filter(F.array(k.cast("int")), lambda i: i.isNotNull())).alias("used"),
        )

    new = F.aggregate(hits, start, step, lambda s: s["out"])
    made = F.array_join(F.flatten(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, d: F.array(g, d))), "")
    return F.when((F.size(a) == F.size(b)) & (a != b), made).otherwise(tr)


def synced(members: DataFrame) -> DataFrame:
    """(id, target) of the members of repeats whose target changes.

    ``members(key, mode, id, text, target)``, the smallest id of a key being its lead. Once: the lead's target with the
    member's own numbers; keep: none; each: as it is.
    """
    lead = members.groupBy("key").agg(F.min_by(F.struct("id", "text", "target"), "id").alias("lead"))
    both = members.join(lead, "key").where("mode <> 'each'")
    old, own = F.coalesce("target", F.lit("")), F.coalesce("lead.target", F.lit(""))
    moved = F.when(F.trim(own) == "", "").otherwise(number_transfer(own, F.col("lead.text"), F.col("text")))
    new = F.when(F.col("mode") == "keep", "").when(F.col("id") == F.col("lead.id"), old).otherwise(moved)
    return both.select("id", new.alias("target"), old.alias("_old")).where("target <> _old").drop("_old")
