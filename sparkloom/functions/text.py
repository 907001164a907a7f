"""Text functions. White space is written out as blank, tab, line feed and carriage return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "[ \\t\\n\\r]+"
#: A word: a letter, then letters, marks, apostrophes, soft hyphens and hyphens.
WORD = "\\p{L}[\\p{L}\\p{M}'’\\x{00AD}-]*"
#: Words and the runs between them that are not white space: words are adjacent iff their pieces are.
PIECE = WORD + "|[^\\p{L} \\t\\n\\r]+"
CJK = "[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]"
LETTER = "\\p{L}"
BULLET = "^[ \\t]*(?:[•·◦▪–—*-]|\\d{1,3}[.)])[ \\t]+"
LEADERS = "(?:[.·…_][ \\t]*){4,}"
SECTION = "^\\d+(?:\\.\\d+)*\\.?[ \\t]+"
ADDRESS = "(?:https?://|www\\.)[^ \\t\\n]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+"
ARTICLE = "^(?:der|die|das|den|dem|des|eine?|einen|einem|einer|the|an?|les?|la|une?|el|los|las|unos|unas)[ \\t\\n\\r]+"


def squeezed(text: Column) -> Column:
    """White space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def repeat_key(text: Column) -> Column:
    """Digit runs as '#', white space squeezed: equal for a header on any page."""
    return squeezed(F.regexp_replace(text, "[0-9]+", "#"))


def term_key(term: Column) -> Column:
    """Lower case, without a leading article, punctuation and white space as one blank."""
    bare = F.regexp_replace(F.lower(F.trim(term)), ARTICLE, "")
    return F.trim(F.regexp_replace(bare, "[ \\t\\n\\r.,;:!?\"'()\\[\\]/-]+", " "))


def word_form(token: Column) -> Column:
    """A word without hyphens and apostrophes at its end (it begins with a letter)."""
    return F.rtrim(token, F.lit("-'’\u00ad"))


def hex_colour(value: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(value.bitwiseAND(0xFFFFFF))), 6, "0"))


def ascii_digits(text: Column) -> Column:
    """Arabic, Devanagari, Bengali, Thai and full-width digits as 0 to 9."""
    starts = (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50, 0xFF10)
    return F.translate(text, "".join(chr(s + i) for s in starts for i in range(10)), "0123456789" * len(starts))


def xml_escaped(text: Column) -> Column:
    """XML text: characters that XML forbids left out, then & < > escaped."""
    legal = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    return F.replace(F.replace(F.replace(legal, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def markers_escaped(text: Column) -> Column:
    """Numbered tags <1>, </1>, <1/> in single guillemets, so that they are not taken as markup."""
    return F.regexp_replace(text, "<(/?[0-9]+/?)>", "‹$1›")


def markers_restored(text: Column) -> Column:
    return F.regexp_replace(text, "‹(/?[0-9]+/?)›", "<$1>")


def tags_to_text(text: Column) -> Column:
    """A segment's words: <n/> as blank, other numbered tags left out, white space squeezed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "<[0-9]+/>", " "), "</?[0-9]+>", ""), SPACES, " ")


def markdown_unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\`*_{}\[\]()#+.!<>~|-])", "$1")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./\\]*$", "")


def cell_column(ref: Column) -> Column:
    """Zero-based column number of a cell reference such as AB12."""
    letters = F.split(F.regexp_replace(F.upper(ref), "[^A-Z]", ""), "")
    used = F.filter(letters, lambda c: c != "")
    return F.when(F.size(used) > 0, F.aggregate(used, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1)


def column_name(number: Column) -> Column:
    """Letters of a zero-based column number (up to three)."""
    letter = lambda v: F.char(v + 65)
    low, mid = number % 26, F.floor(number / 26) - 1
    high = F.floor(mid / 26) - 1
    return F.concat(
        F.when(high >= 0, letter(high % 26)).otherwise(""), F.when(mid >= 0, letter(mid % 26)).otherwise(""), letter(low)
    )


def html_to_text(html: Column) -> Column:
    """Plain text of marked-up text: block ends as line feeds, tags out, the common entities decoded, blank lines collapsed."""
    text = F.regexp_replace(html, "\\[sound:[^\\]]*\\]", "")
    text = F.regexp_replace(text, "(?i)<br[^>]*>|</(?:p|div|li|tr|h[1-6])>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    text = F.regexp_replace(text, "[ \\t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, "[ \\t]*\\n[ \\t\\n]*", "\n"), "^[ \\n]+|[ \\n]+$", "")


def rotation(dx: Column, dy: Column) -> Column:
    """0, 90, 180, 270 for a direction vector along an axis, else null."""
    return F.when(dx > 0.99, 0).when(dx < -0.99, 180).when(dy < -0.99, 90).when(dy > 0.99, 270)


def joined_lines(lines: Column) -> Column:
    """Lines as one text; a word cut by a hyphen before a lower-case letter is put together."""

    def step(text: Column, part: Column) -> Column:
        part = F.trim(part)
        glue = text.rlike(r"\p{L}-$") & part.rlike(r"^\p{Ll}")
        return (
            F.when(part == "", text).when(text == "", part)
            .when(glue, F.concat(F.substring(text, F.lit(1), F.length(text) - 1), part))
            .otherwise(F.concat(text, F.lit(" "), part))
        )

    return F.aggregate(lines, F.lit(""), step)


def snippet(text: Column, start: Column, length: Column, span: int = 55) -> Column:
    """About ``span`` characters on each side of a hit (zero-based start), cut at blanks, with ellipses."""
    n = F.length(text)
    a0, b0 = F.greatest(F.lit(0), start - span), F.least(n, start + length + span)
    sp = F.instr(F.substring(text, a0 + 1, n), " ") + a0 - 1
    a = F.when((a0 > 0) & (sp >= a0) & (sp < start), sp + 1).otherwise(a0)
    last = b0 - F.instr(F.reverse(F.substring(text, F.lit(1), b0 + 1)), " ") + 1
    b = F.when((b0 < n) & (last > start + length) & (last <= b0), last).otherwise(b0)
    return F.concat(F.when(a > 0, "…").otherwise(""), F.trim(F.substring(text, a + 1, b - a)), F.when(b < n, "…").otherwise(""))


#: Names of languages and their codes (fixed values).
LANGUAGE_NAMES = {
    "english": "en", "german": "de", "deutsch": "de", "french": "fr", "français": "fr", "spanish": "es", "español": "es", "italian": "it", "italiano": "it", "portuguese": "pt",
    "dutch": "nl", "polish": "pl", "czech": "cs", "swedish": "sv", "turkish": "tr", "russian": "ru", "ukrainian": "uk", "japanese": "ja", "korean": "ko", "chinese": "zh",
}


def language_code(name: Column) -> Column:
    """A code's first two letters, the code of a name that begins with a known one, else its letters, eight at most."""
    n = F.lower(F.trim(name))
    out = F.substring(F.regexp_replace(n, "[^a-z]", ""), 1, 8)
    for known, code in reversed(LANGUAGE_NAMES.items()):
        out = F.when(n.startswith(known), code).otherwise(out)
    return F.when(n.rlike("^[a-z]{2,3}(?:-[a-z]{2,4})?$"), F.substring(n, 1, 2)).otherwise(out)


UNSPACED = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"
GAP = "_____"


def cloze(sentence: Column, word: Column) -> Column:
    """The sentence with a gap for the word: whole words in any case, or else, for words of five letters or more, those with its stem.

    An article before the word and brackets after it don't count; in scripts without spaces it is found anywhere.
    """
    core = F.trim(F.regexp_replace(F.regexp_replace(word, "\\s+\\([^()]*\\)$", ""), "(?i)" + ARTICLE, ""))
    literal = lambda w: F.regexp_replace(w, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")
    whole = F.regexp_replace(sentence, F.concat(F.lit("(?iu)(?<![\\p{L}\\p{M}])"), literal(core), F.lit("(?![\\p{L}\\p{M}])")), F.lit(GAP))
    stem = F.substring(core, F.lit(1), F.greatest(F.lit(4), F.length(core) - 2))
    bent = F.regexp_replace(sentence, F.concat(F.lit("(?iu)(?<![\\p{L}\\p{M}])"), literal(stem), F.lit("[\\p{L}\\p{M}]*")), F.lit(GAP))
    return (
        F.when((core == "") | sentence.isNull(), sentence).when(core.rlike(UNSPACED), F.replace(sentence, core, F.lit(GAP)))
        .when(whole != sentence, whole).when(F.length(core) >= 5, bent).otherwise(sentence)
    )


#: Parts of font names by family (fixed values).
MONO, SANS, SERIF = "mono|courier|consol|menlo|typewriter", "sans|arial|helvet|verdana|calibri|tahoma|roboto|gothic", "serif|times|georgia|garamond|roman|palatino|cambria|book"


def font_family(name: Column, monospaced: Column, serifed: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.rlike(MONO), "monospace").when(low.rlike(SANS), "sans-serif").when(low.rlike(SERIF), "serif")
        .when(monospaced, "monospace").when(serifed, "serif").otherwise("sans-serif")
    )


def prose_words(text: Column, least: int = 3) -> Column:
    """How many words have ``least`` letters or more of one alphabet, Latin or Greek."""
    found = F.regexp_extract_all(text, F.lit(f"\\p{{L}}{{{least},}}"), F.lit(0))
    return F.size(F.filter(found, lambda w: ~(w.rlike("\\p{IsLatin}") & w.rlike("\\p{IsGreek}"))))


def contents_entry(text: Column) -> Column:
    """(title, page) of a contents line: a title with a letter, four leader dots or more, a number in digits or Roman; else null."""
    pattern = "(?i)^(.*?\\S)\\s*(?:(?:[.·⋅_]\\s?|…\\s?){4,}|(?:…\\s?){2,})\\s*(\\d{1,4}|[ivxlcdm]{1,7})\\s*$"
    one = squeezed(text)
    title = F.regexp_extract(one, pattern, 1)
    return F.when(one.rlike(pattern) & title.rlike(LETTER), F.struct(title.alias("title"), F.regexp_extract(one, pattern, 2).alias("page")))


_PLAIN, _RAISED, _LOWERED = "0123456789+-=()", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"


def script_text(text: Column, size: Column, shift: Column, line_size: Column) -> Column:
    """Raised or lowered small text in Unicode signs, if all of its characters have one."""
    able = (size <= 0.85 * line_size) & F.trim(text).rlike("^[0-9+=()\\- ]+$")
    raised, lowered = F.translate(text, _PLAIN, _RAISED), F.translate(text, _PLAIN, _LOWERED)
    return F.when(able & (shift > 0.15 * line_size), raised).when(able & (shift < -0.08 * line_size), lowered).otherwise(text)


def with_language(markup: Column, code: str) -> Column:
    """An XHTML page whose html element names the language."""
    bare = F.regexp_replace(markup, "(?i)(<html\\b[^>]*?)\\s+(?:xml:)?lang\\s*=\\s*(?:\"[^\"]*\"|'[^']*')", "$1")
    bare = F.regexp_replace(bare, "(?i)(<html\\b[^>]*?)\\s+(?:xml:)?lang\\s*=\\s*(?:\"[^\"]*\"|'[^']*')", "$1")
    return F.regexp_replace(bare, "(?i)<html\\b", f'<html lang="{code}" xml:lang="{code}"')


def latin_language(text: Column, words: dict[str, list[str]], share: float = 0.08, ahead: float = 1.4) -> Column:
    """Language of accent-free text of 30 words or more: the best share of function words, at least ``share`` and ``ahead`` times the next; else null."""
    accents, plain = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    found = F.regexp_extract_all(F.translate(F.lower(text), accents, plain), F.lit("[a-z]+"), F.lit(0))
    table = str.maketrans(accents, plain)

    def share_of(lang: str) -> Column:
        own = sorted({w.translate(table) for w in words[lang]})
        return F.size(F.filter(found, lambda w: w.isin(own))) / F.size(found)

    scored = F.array_sort(F.array(*(F.struct((-share_of(k)).alias("s"), F.lit(k).alias("lang")) for k in sorted(words))))
    best, second = -scored[0]["s"], -scored[1]["s"]
    return F.when((F.size(found) >= 30) & (best >= share) & (best >= second * ahead), scored[0]["lang"])


#: Named characters (fixed values).
ENTITIES = {"nbsp": "\u00a0", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def entities_decoded(text: Column) -> Column:
    """Numeric and common named characters; numbers that XML doesn't allow are left out, unknown names stay."""
    parts, codes = F.split(text, "(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});", -1), F.regexp_extract_all(text, F.lit("(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(1))

    def sign(c: Column) -> Column:
        n = F.when(F.lower(c).startswith("x"), F.conv(F.substring(c, 2, 6), 16, 10)).otherwise(c).cast("int")
        legal = n.isin(9, 10, 13) | n.between(32, 0xD7FF) | n.between(0xE000, 0xFFFD) | n.between(0x10000, 0x10FFFF)
        # A code point as four bytes of UTF-32.
        return F.when(legal, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("")

    done = F.array_join(F.flatten(F.zip_with(parts, F.concat(F.transform(codes, sign), F.array(F.lit(""))), lambda p, s: F.array(p, s))), "")
    for name, char in ENTITIES.items():
        done = F.replace(done, F.lit(f"&{name};"), F.lit(char))
    return F.replace(done, F.lit("&amp;"), F.lit("&"))


def resolved_path(base: Column, href: Column) -> Column:
    """A link inside a package as a path from its root; what goes above the root is cut off."""
    folder = F.regexp_replace(base, "[^/]*$", "")
    parts = F.split(F.concat(folder, F.try_url_decode(F.replace(F.regexp_replace(href, "#.*$", ""), F.lit("+"), F.lit("%2B")))), "/")
    step = lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(p.isin("", "."), a).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def latex_cleaned(text: Column) -> Column:
    """A formula without code fences, display brackets, dollar signs and one-line environments around it."""
    out = F.trim(text)
    for pattern in (
        "(?i)^```[a-z]*\\s*|\\s*```$", "^\\\\\\[\\s*|\\s*\\\\\\]$", "^\\\\\\(\\s*|\\s*\\\\\\)$", "^\\$\\$?\\s*|\\s*\\$\\$?$",
        "^\\\\begin\\{(?:equation|displaymath|align)\\*?\\}\\s*|\\s*\\\\end\\{(?:equation|displaymath|align)\\*?\\}$",
    ):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(out)


def script_json(value: Column) -> Column:
    """JSON text that may stand inside a script element."""
    for sign, code in (("<", "\\u003c"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        value = F.replace(value, F.lit(sign), F.lit(code))
    return value


#: Windows-1252 differs from ISO-8859-1 in these characters.
_WESTERN = tuple("".join(x) for x in zip(*((chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))))


def decoded(content: Column) -> Column:
    """Text of a file: by its byte order mark, else UTF-8, else Windows-1252."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, F.lit(n), F.length(content))
    return (
        F.when(head == "EFBBBF", rest(4).cast("string")).when(head.startswith("FFFE"), F.decode(rest(3), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(rest(3), "UTF-16BE")).when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(F.translate(F.decode(content, "ISO-8859-1"), *_WESTERN))
    )
