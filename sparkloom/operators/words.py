"""Words and word groups of segments.

Everything up to the first grouping runs on arrays inside a row, so a text is never shuffled;
stop words leave before the shuffle, and counts are combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stopwords
from ..functions.arrays import bound
from ..functions.text import CJK, PIECE, WORD, word_form


def is_stop(form: Column) -> Column:
    """Function words, and forms shorter than three characters unless they are CJK."""
    return F.lower(form).isin(stopwords.ALL) | ((F.length(form) < 3) & ~form.rlike(CJK))


def tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, pos, form, key) of words that are not stop words; pos counts all words of the document."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", *keep, F.posexplode(words).alias("pos", "raw"))
    rows = rows.withColumn("form", word_form(F.col("raw"))).where(~is_stop(F.col("form")))
    return rows.select("doc_id", *keep, "pos", "form", F.lower("form").alias("key"))


def frequencies(docs: DataFrame) -> DataFrame:
    return tokens(docs).groupBy("key").agg(F.count("*").alias("n"))


def top_forms(docs: DataFrame) -> DataFrame:
    """(key, n, form): the most frequent spelling of each word, the first seen of equals."""
    forms = tokens(docs).groupBy("key", "form").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "pos")).alias("first"))
    best = F.struct(F.col("c"), (-F.col("first.doc_id")).alias("d"), (-F.col("first.pos")).alias("p"))
    return forms.groupBy("key").agg(F.sum("c").alias("n"), F.max_by("form", best).alias("form"))


def first_seen(docs: DataFrame) -> DataFrame:
    """(key, doc_id, pos) of each word's first occurrence."""
    return tokens(docs).groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("f")).select("key", "f.doc_id", "f.pos")


def passages(docs: DataFrame, least: int = 40) -> DataFrame:
    """(key, doc_id): the document that shows a word, the first with ``least`` characters or else the first."""
    rows = tokens(docs.withColumn("short", F.length("text") < least), "short")
    return rows.groupBy("key").agg(F.min(F.struct("short", "doc_id")).alias("m")).select("key", F.col("m.doc_id").alias("doc_id"))


def unknown(words: DataFrame, known: DataFrame, limit: int = 30) -> DataFrame:
    """The most frequent words that ``known(term)`` doesn't have."""
    terms = known.select(F.lower(F.trim("term")).alias("key")).distinct()
    return words.join(terms, "key", "left_anti").orderBy(F.desc("n"), "key").limit(limit)


def groups(docs: DataFrame, least: int = 2) -> DataFrame:
    """(phrase, size, n): two or three words with only white space between, the outer ones no stop words.

    A pair that occurs no more often than the counted triples around it is left out. Texts are taken apart once: pieces are
    judged one by one, neighbours are put together inside the row, and pairs and triples are counted in one aggregate.
    """
    pieces = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))

    def judged(piece: Column) -> Column:
        form = F.lower(word_form(piece))
        return F.struct(F.when(piece.rlike("^\\p{L}"), form).alias("w"), is_stop(form).alias("s"))

    def near(all_: Column) -> Column:
        after = lambda n: F.slice(all_, F.lit(n), F.size(all_))
        three = F.arrays_zip(all_.alias("a"), after(2).alias("b"), after(3).alias("c"))
        return F.filter(three, lambda x: x["a"]["w"].isNotNull() & ~x["a"]["s"] & x["b"]["w"].isNotNull())

    seen = docs.select(F.explode(bound(F.transform(pieces, judged), near)).alias("x")).select("x.a", "x.b", "x.c")
    a, b, c = (F.col(f"{x}.w") for x in "abc")
    kinds = F.array(F.when(~F.col("b.s"), F.lit(2)), F.when(c.isNotNull() & ~F.col("c.s"), F.lit(3)))
    sized = seen.select(a.alias("a"), b.alias("b"), c.alias("c"), F.explode(kinds).alias("size")).where("size is not null")
    phrase = F.when(F.col("size") == 2, F.concat_ws(" ", "a", "b")).otherwise(F.concat_ws(" ", "a", "b", "c"))
    counted = sized.groupBy(phrase.alias("phrase"), "size").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # A counted triple stands for itself, and for its two pairs as what is inside triples.
    words = F.split("phrase", " ")
    row = lambda p, size, n, inside: F.struct(p.alias("phrase"), F.lit(size).alias("size"), n.alias("n"), inside.alias("inside"))
    n, none = F.col("n"), F.lit(0).cast("long")
    pairs = F.array(row(F.col("phrase"), 3, n, none), row(F.concat_ws(" ", words[0], words[1]), 2, none, n), row(F.concat_ws(" ", words[1], words[2]), 2, none, n))
    rows = counted.select(F.explode(F.when(F.col("size") == 3, pairs).otherwise(F.array(row(F.col("phrase"), 2, n, none)))).alias("r")).select("r.*")
    both = rows.groupBy("phrase", "size").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    return both.where((F.col("n") > 0) & ((F.col("size") == 3) | (F.col("n") > F.col("inside")))).select("phrase", "size", "n")


#: Scripts that decide a language by themselves, in order (fixed values).
SCRIPTS = (
    ("ja", "[\\x{3040}-\\x{30FF}]"), ("ko", "[\\x{AC00}-\\x{D7AF}]"), ("zh", "[\\x{4E00}-\\x{9FFF}]"), ("ar", "[\\x{0600}-\\x{06FF}]"),
    ("he", "[\\x{0590}-\\x{05FF}]"), ("el", "[\\x{0370}-\\x{03FF}]"),
)
#: Letters of one language only, and letters that a longer text of a language has (fixed values).
OWN = {"de": "[ß]", "es": "[ñ¿¡]", "fr": "[èêœ]"}
MARKS = {"de": "[äöüß]", "es": "[ñáéíóú¿¡]", "fr": "[éèêàçù]"}


def language(text: Column) -> Column:
    """Language by script, else by function words and own letters; '' when unsure.

    A hit of a function word counts one, one of an own letter three, at most nine; over 200 characters
    without a language's marks rule it out. Equal scores go to the first in alphabetical order.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("\\p{L}+"), F.lit(0))
    scores = []
    for lang in sorted(stopwords.STOP):
        score = F.size(F.filter(words, _in(lang)))
        if lang in OWN:
            score = score + F.least(F.lit(9), 3 * F.regexp_count(text, F.lit(OWN[lang])))
        if lang in MARKS:
            score = F.when((F.length(text) > 200) & ~text.rlike(MARKS[lang]), 0).otherwise(score)
        scores.append(F.struct(score.cast("int").alias("score"), F.lit(lang).alias("lang")))
    best = F.aggregate(
        F.array(*scores), F.struct(F.lit(1).alias("score"), F.lit("").alias("lang")), lambda a, s: F.when(s["score"] > a["score"], s).otherwise(a)
    )["lang"]
    out = F.when(F.size(words) < 3, "").otherwise(best)
    for lang, letters in reversed(SCRIPTS):
        out = F.when(text.rlike(letters), lang).otherwise(out)
    return out


def _in(lang: str):
    return lambda w: w.isin(stopwords.STOP[lang])
