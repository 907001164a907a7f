"""Formulas among segments, tags of translations, and packed spreadsheet numbers.

A segment is a formula if one of several signs of mathematics is strong enough; some of them count only where
there are hardly any words of prose. Each sign is a predicate over counts that are taken once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound

# Names of mathematical fonts, signs, functions, words of formulas, and two-letter words.
FONTS = "(?i)^(?:cm(?:mi|sy|ex|bsy|mib)\\d|msam|msbm|eufm|eusm|rsfs|stmary|wasy|lmmath|latinmodern-?math|cambria-?math|stix\\w*math|xits|asana|tx(?:mi|sy|ex)|px(?:mi|sy|ex)|mtmi|mtsy|mathematicalpi|mt-?extra|euler|esint|symbol)|math"
SIGNS = "[=≈≠≤≥±∓×÷·⋅√∑∏∫∂∞∝→⇒⇔∇∆Δ^\\x{0370}-\\x{03FF}]"
FUNCTIONS = "sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh log ln lg exp lim max min sup inf det arg mod sgn tr diag grad div rot"
WORDS = "sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh log ln lg exp lim max min sup inf det arg mod div rot grad const dim ker rank sgn tr diag where with für mit wenn if and und or oder"
SHORT = "ab am an as at be by da de do du el en er es et go he if il im in is it ja je la le lo me my no ob of oh ok on or os se si so te to tu um un up us we wo zu и в на не то но он мы вы из за по от до ты я о у с к"

_LETTER, _AFTER, _BEFORE = "\\p{L}", "(?<=[\\p{L}\\p{N})\\]])", "(?=[\\p{L}\\p{N}(\\[√∑∫])"
_FUNCTION = f"(?<!{_LETTER})(?:{'|'.join(FUNCTIONS.split())})(?!{_LETTER})"


def _prose(text: Column, least: int) -> Column:
    """Words of ``least`` letters or more that are neither mathematics nor of mixed alphabets."""
    found = F.regexp_extract_all(text, F.lit(f"{_LETTER}{{{least},}}"), F.lit(0))
    greek = lambda w: w.rlike("[\\x{0370}-\\x{03FF}]")
    other = lambda w: w.rlike("[^\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}]")
    return F.size(F.filter(found, lambda w: ~F.lower(w).isin(WORDS.split()) & ~(greek(w) & other(w))))


def _counts(text: Column, spans: Column) -> Column:
    count = lambda t, pattern: F.regexp_count(t, F.lit(pattern))
    size = lambda s: F.length(F.regexp_replace(s["text"], "\\s", ""))
    full = F.filter(spans, lambda s: size(s) > 0)
    total = lambda keep, n: F.aggregate(F.filter(full, keep), F.lit(0), lambda a, s: a + n(s))
    bare = F.regexp_replace(text, f"(?<!{_LETTER})[\\x{{0370}}-\\x{{03FF}}\\x{{1F00}}-\\x{{1FFF}}]{{3,}}(?!{_LETTER})", " ")
    sizes = F.transform(full, lambda s: s["size"])
    named = F.array_join(F.regexp_extract_all(text, F.lit(_FUNCTION), F.lit(0)), "")
    return F.struct(
        total(lambda s: F.lit(True), size).alias("all"), total(lambda s: s["font"].rlike(FONTS), size).alias("set"), total(lambda s: s["italic"], lambda s: count(s["text"], _LETTER)).alias("italic"),
        F.coalesce(F.array_max(sizes) >= 1.25 * F.array_min(sizes), F.lit(False)).alias("scripts"), _prose(text, 3).alias("words"), _prose(text, 5).alias("long"),
        count(bare, f"{SIGNS}|{_LETTER}(?=[₀-₉⁰-⁹])|{_AFTER}\\s*\\+\\s*{_BEFORE}").alias("strong"),
        count(bare, f"{SIGNS}|{_AFTER}\\s*[+−-]\\s*{_BEFORE}|(?<=[\\p{{L}}\\p{{N}})])\\s*/\\s*(?=[\\p{{L}}\\p{{N}}(])").alias("ops"),
        count(text, "[\\x{FFFD}\\x{E000}-\\x{F8FF}]").alias("unknown"), count(text, f"(?<![\\p{{L}}\\p{{N}}]){_LETTER}(?!{_LETTER})").alias("single"),
        count(text, _LETTER).alias("letters"), F.length(named).alias("named"), text.rlike("\\p{N}").alias("numbers"), text.alias("text"),
    )


def is_formula(text: Column, spans: Column) -> Column:
    """Whether a segment is a formula; ``spans`` is an array of (text, font, size, italic)."""

    def judged(c: Column) -> Column:
        wordless, t = c["words"] == 0, c["text"]
        runs = F.regexp_extract_all(t, F.lit(f"{_LETTER}+"), F.lit(0))
        only_functions = F.forall(runs, lambda w: (F.length(w) == 1) | w.isin(FUNCTIONS.split()))
        pair = F.trim(t).rlike(f"^{_LETTER}\\s?{_LETTER}$") & ~F.lower(F.trim(t)).isin(SHORT.split())
        by_font = (c["all"] > 0) & (c["set"] >= 0.6 * c["all"]) & (c["long"] == 0)
        without_words = wordless & (
            (c["strong"] > 0)
            | ((c["letters"] - c["named"] <= 6) & ((c["set"] > 0) | (c["unknown"] > 0)))
            | (~c["numbers"] & pair)
            | ((c["single"] >= 2) & (c["ops"] > 0) & (c["letters"] <= 4))
            | ((c["letters"] > 0) & F.regexp_replace(t, f"{_LETTER}+", "").rlike("^[\\p{N}\\s().,;:^_]*$") & t.rlike(_FUNCTION) & only_functions)
            | ((c["ops"] >= 2) & c["letters"].between(1, 6))
        )
        alone = (c["letters"] == 1) & ~c["numbers"] & (F.length(F.regexp_replace(t, "[\\s().,;:=+−-]", "")) == 1)
        among_few_words = (c["words"] <= 2) & (
            ((c["words"] <= 1) & ((c["unknown"] >= 2) | ((c["strong"] >= 2) & ((c["single"] >= 2) | (c["unknown"] > 0))) | (c["scripts"] & (c["strong"] > 0))))
            | ((c["single"] >= 3) & (c["strong"] > 0) & (c["letters"] <= 2 * c["single"] + 4))
            | ((c["italic"] > 0) & (c["letters"] <= 2) & wordless & t.rlike("^[\\p{L}\\p{N}\\s]+$"))
        )
        return by_font | without_words | alone | among_few_words

    return bound(_counts(text, spans), judged)


def tags_restored(text: Column, tags: Column) -> Column:
    """A translation with its numbered tags as markup again; ``tags`` is a map from number to (open, close, empty), of which some are null.

    Numbers that the map doesn't have stay as text. A pair that doesn't nest with the others is left out, and empty tags that are missing go to the front.
    """
    mark = "</?[0-9]+/?>"
    piece = "struct<no:int,kind:string,raw:string>"

    def made(x: Column) -> Column:
        def parsed(raw: Column) -> Column:
            no = F.regexp_extract(raw, "([0-9]+)", 1).cast("int")
            kind = F.when(~F.map_contains_key(x["tags"], no), "text").when(raw.endswith("/>"), "empty").when(raw.startswith("</"), "close").otherwise("open")
            return F.struct(no.alias("no"), kind.alias("kind"), raw.alias("raw")).cast(piece)

        def matched(marks: Column) -> Column:
            first = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<int>").alias("kept"))

            def step(s: Column, i: Column) -> Column:
                m, top = F.get(marks, i), F.element_at(F.concat(F.array(F.lit(-1)), s["open"]), -1)
                closes = (m["kind"] == "close") & (top >= 0) & (F.get(marks, top)["no"] == m["no"])
                rest = F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
                return (
                    F.when(m["kind"] == "open", F.struct(F.concat(s["open"], F.array(i)).alias("open"), s["kept"].alias("kept")))
                    .when(closes, F.struct(rest.alias("open"), F.concat(s["kept"], F.array(top, i)).alias("kept"))).otherwise(s)
                )

            places = F.when(F.size(marks) > 0, F.sequence(F.lit(0), F.size(marks) - 1)).otherwise(F.array().cast("array<int>"))
            kept = F.aggregate(places, first, step, lambda s: s["kept"])
            return bound(kept, lambda own: F.transform(marks, lambda m, i: F.coalesce(
                F.when(m["kind"] == "text", m["raw"]).when(m["kind"] == "empty", F.element_at(x["tags"], m["no"])["empty"])
                .when(F.array_contains(own, i), F.when(m["kind"] == "open", F.element_at(x["tags"], m["no"])["open"]).otherwise(F.element_at(x["tags"], m["no"])["close"])), F.lit(""),
            )))

        marks = F.transform(F.regexp_extract_all(x["text"], F.lit(mark), F.lit(0)), parsed)
        used = F.transform(F.filter(marks, lambda m: m["kind"] == "empty"), lambda m: m["no"])
        lost = F.filter(F.array_sort(F.map_entries(x["tags"])), lambda e: e["value"]["empty"].isNotNull() & ~F.array_contains(used, e["key"]))
        front = F.array_join(F.reverse(F.transform(lost, lambda e: e["value"]["empty"])), "")
        gaps = F.transform(F.split(x["text"], mark, -1), lambda g: F.regexp_replace(g, "‹(/?[0-9]+/?)›", "<$1>"))
        return F.concat(front, F.array_join(F.flatten(F.zip_with(gaps, F.concat(bound(marks, matched), F.array(F.lit(""))), lambda g, m: F.array(g, m))), ""))

    return bound(F.struct(text.alias("text"), tags.alias("tags")), made)


def packed_number(rk: Column) -> Column:
    """The value of a spreadsheet's packed number (a 32-bit integer): bit 1 says that the upper 30 bits are an integer, else they are the upper bits of a
    double; bit 0 that the value is a hundred times too large."""
    bits = rk.cast("long").bitwiseAND(0xFFFFFFFC)
    exponent, fraction = F.shiftright(bits, 20).bitwiseAND(0x7FF), bits.bitwiseAND(0xFFFFF) / float(1 << 20)
    size = F.when(exponent == 0, fraction * 2.0**-1022).otherwise((1 + fraction) * F.pow(F.lit(2.0), exponent - 1023))
    real = F.when(F.shiftright(bits, 31) == 1, -size).otherwise(size)
    value = F.when(rk.bitwiseAND(2) != 0, F.shiftright(rk.cast("int"), 2).cast("double")).otherwise(real)
    return F.when(rk.bitwiseAND(1) != 0, value / 100).otherwise(value)
