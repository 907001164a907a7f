"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find e-mail addresses, IPv4 addresses, card and phone numbers. They are the seeds:
the words beside them are lexical patterns, as are those beside any other token that looks like
an identifier (six characters or more with four digits or more). Patterns and instances are a
bipartite graph. In each round a pattern's confidence is the share of its instances that are
believed, and an instance's belief the noisy-or of its patterns; seeds are always believed.
A pattern needs some believed instances, seeds at first and found ones in later rounds.
Instances of high belief that stand beside a pattern of high confidence are added, as kind ``id``.

Positions count code points; ends are exclusive. The regular expressions below match what the
plain forms in their comments match, with possessive repeats and a look-behind that spare
the retries inside one run of characters, so that time stays in proportion to the text.

Defined results: null and empty texts have no spans; every input row is returned; repeated rows are
returned each, and are counted once as instances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, cut, pieces, running, with_starts
from .storage import staged

KINDS = ("email", "ip", "card", "phone", "id")
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+ of at least 12 digits
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
# \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What stands for a base span's characters, the first and the others, and for these two signs in a text.
FIRST, MORE, OTHER = "\ue001", "\ue000", "\ue002"
# a run of other characters than white space with a digit or a base span
TOKEN = rf"(?<!\S)[^\s0-9{FIRST}]*+[0-9{FIRST}]\S*+"

#: Rounds over the graph; believed instances that a pattern needs; least confidence of a pattern and belief in an instance.
ROUNDS, SUPPORT, CONFIDENCE, BELIEF = 3, 3, 0.8, 0.9


def _located(text: Column, pattern: str, possible: Column) -> Column:
    """All matches as array of (start, end, hit, before, after): before and after are the texts up to the next hits."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    row = "struct<start:int,end:int,hit:string,before:string,after:string>"

    def near(both: Column) -> Column:
        n = F.size(both["hits"])
        return F.arrays_zip(
            F.slice(both["gaps"], F.lit(1), n).alias("before"), both["hits"].alias("hit"), F.slice(both["gaps"], F.lit(2), n).alias("after")
        )

    def make(at: Column, x: Column) -> Column:
        start = at + F.length(x["before"])
        return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))

    items = bound(F.struct(hits.alias("hits"), gaps.alias("gaps")), near)
    placed = with_starts(items, lambda x: F.length(x["before"]) + F.length(x["hit"]), make, row)
    return F.when(possible, placed).otherwise(F.array().cast(f"array<{row}>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
    ))
    return F.aggregate(F.filter(d, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def _ok(kind: str):
    def test(x: Column) -> Column:
        n = F.length(_digits(x["hit"]))
        if kind == "ip":
            bare = F.transform(F.split(x["hit"], r"\."), lambda p: F.ltrim(p, F.lit("0")))
            return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).try_cast("int"), F.lit(0)) <= 255))
        if kind == "card":
            return F.when(n.between(12, 19), _luhn(_digits(x["hit"]))).otherwise(False)
        return n.between(9, 15) if kind == "phone" else F.lit(True)

    return test


def _span(no: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("kind"), x["end"].alias("end"), x["hit"].alias("hit"))


def base_spans(text: Column) -> Column:
    """The base kinds' spans as array of (start, kind number, end, hit), in that order."""
    found = []
    for no, (kind, pattern, possible) in enumerate(
        (("email", EMAIL, text.contains("@")), ("ip", IP, text.contains(".")), ("card", CARD, F.lit(True)), ("phone", PHONE, text.contains("+")))
    ):
        good = F.filter(_located(text, pattern, possible), _ok(kind))
        found.append(F.transform(good, _span(no)))
    return F.array_sort(F.concat(*found))


_BESIDE = "struct<at:int,start:int,kind:int,end:int,hit:string>"


def _beside(spans: Column) -> Column:
    """Spans in order, each with the greatest end of those before as ``at``: it is a span's own if it starts there or later."""
    make = lambda at, x: F.struct(at.alias("at"), x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["hit"].alias("hit"))
    return running(spans, lambda x: x["end"], F.greatest, make, _BESIDE)


def _replaced(text: Column, spans: Column, put, plain=lambda gap: gap) -> Column:
    """The text with ``put(span)`` in place of each span of ``_beside`` and ``plain(gap)`` between them, in time proportional to the text."""

    def made(x: Column) -> Column:
        gap = lambda s: plain(cut(x["parts"], s["at"], s["start"] - s["at"]))
        pieces_ = F.transform(x["spans"], lambda s: F.concat(F.when(s["start"] > s["at"], gap(s)).otherwise(""), put(s)))
        return bound(F.array_max(F.transform(x["spans"], lambda s: s["end"])), lambda end: F.concat(F.array_join(pieces_, ""), plain(cut(x["parts"], end, x["n"] - end))))

    return bound(F.struct(pieces(text).alias("parts"), F.length(text).alias("n"), spans.alias("spans")), made)


def _marked(text: Column, spans: Column) -> Column:
    """The text with FIRST and MORE in place of the characters of base spans."""
    plain = lambda t: F.when(t.rlike(f"[{FIRST}{MORE}]"), F.translate(t, FIRST + MORE, OTHER * 2)).otherwise(t)
    more = lambda n: F.repeat(F.lit(MORE), F.greatest(n, F.lit(0)))
    put = lambda s: F.when(s["start"] >= s["at"], F.concat(F.lit(FIRST), more(s["end"] - s["start"] - 1))).otherwise(more(s["end"] - s["at"]))
    return F.when(F.size(spans) == 0, plain(text)).otherwise(_replaced(text, spans, put, plain))


def _candidates(text: Column, base: Column) -> Column:
    """Tokens that look like identifiers or have a base span: (start, end, instance, left, right, seed); the instance of a seed is its first span."""
    word = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}=:#]", ""))
    spans_in = lambda hit: F.regexp_count(hit, F.lit(FIRST))

    def shape(before: Column, x: Column) -> Column:
        skip = F.length(F.regexp_extract(x["hit"], r"^([^\p{L}\p{N}+]*+)", 1))
        core = F.regexp_replace(F.substring(x["hit"], skip + 1, F.length(x["hit"])), r"[^\p{L}\p{N}]++$", "")
        start = x["start"] + skip
        return F.struct(
            start.alias("start"),
            (start + F.length(core)).alias("end"),
            core.alias("core"),
            word(F.reverse(F.regexp_extract(F.reverse(x["before"]), r"^\s*(\S++)", 1))).alias("left"),
            word(F.regexp_extract(x["after"], r"^\s*(\S++)", 1)).alias("right"),
            x["hit"].contains(FIRST).alias("seed"),
            before.alias("no"),
        )

    def found(x: Column) -> Column:
        row = "struct<start:int,end:int,core:string,left:string,right:string,seed:boolean,no:int>"
        tokens = running(_located(_marked(text, x["spans"]), TOKEN, F.lit(True)), lambda t: spans_in(t["hit"]), lambda a, n: a + n, shape, row)
        good = F.filter(tokens, lambda t: t["seed"] | ((F.length(t["core"]) >= 6) & (F.length(_digits(t["core"])) >= 4)))
        seeds = F.transform(F.filter(x["spans"], lambda s: s["start"] >= s["at"]), lambda s: s["hit"])
        return bound(seeds, lambda own: F.transform(good, lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), F.when(t["seed"], F.get(own, t["no"])).otherwise(t["core"]).alias("instance"),
            t["left"].alias("left"), t["right"].alias("right"), t["seed"].alias("seed"),
        )))

    return bound(F.struct(_beside(base).alias("spans")), found)


def _scored(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confidence of patterns and belief in instances after all rounds over (pattern, instance, seed)."""
    belief = staged(graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("belief")), "belief")
    pattern = None
    for _ in range(ROUNDS):
        # Written first, so that the joins have exchanges of their own, which Spark can split at a pattern beside very many instances.
        pattern = staged(
            graph.join(belief, "instance")
            .groupBy("pattern")
            .agg(F.sum("belief").alias("sum"), F.count("*").alias("n"), F.sum((F.col("belief") >= BELIEF).cast("int")).alias("support"))
            .where(F.col("support") >= SUPPORT)
            .select("pattern", (F.col("sum") / F.col("n")).alias("confidence")),
            "patterns",
        )
        doubt = F.exp(F.sum(F.log(1 - F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999)))))
        belief = staged(
            graph.join(pattern, "pattern", "left")
            .groupBy("instance")
            .agg(F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("belief")),
            "belief",
        )
    return pattern, belief


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row table, added table): base spans of every row, and spans added by context.

    Row table: doc_id, key (a hash of the text), base. Added table: doc_id, key, added; it holds
    rows with added spans only.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("text"))
    src = src.withColumn("base", base_spans(F.col("text")))
    bare = F.transform("base", lambda s: s.dropFields("hit"))
    src = src.select("doc_id", "key", bare.alias("base"), _candidates(F.col("text"), F.col("base")).alias("tokens"))
    rows = staged(src, "spans")
    seen = rows.where(F.size("tokens") > 0).select("doc_id", "key", F.inline("tokens"))
    beside = F.filter(
        F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right")), lambda p: F.length(p) > 2
    )
    graph = staged(
        seen.select(F.explode(beside).alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")),
        "graph",
    )
    pattern, belief = _scored(graph)
    pattern = pattern.where(F.col("confidence") >= CONFIDENCE).select("pattern")
    belief = belief.where(F.col("belief") >= BELIEF).select("instance")
    added = (
        seen.where(~F.col("seed"))
        .select("doc_id", "key", "start", "end", "instance", F.explode(beside).alias("pattern"))
        .join(pattern, "pattern")
        .join(belief, "instance")
        .groupBy("doc_id", "key")
        .agg(F.array_sort(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end"))).alias("added"))
    )
    return rows.select("doc_id", "key", "base"), added


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    rows, added = find(docs)
    extra = added.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "added")
    both = rows.join(extra, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    count = lambda no: F.size(F.filter("base", lambda s: s["kind"] == no)).cast("long")
    return both.select(
        "doc_id",
        *(count(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS[:4])),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, and n_chars, if there, recounted.

    Overlapping spans are replaced as one, by the kind of the first.
    """
    rows, added = find(docs)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = rows.where(F.size("base") > 0).select("doc_id", "key", "base").distinct()
    spans = spans.join(added, ["doc_id", "key"], "full_outer").select(
        F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.array_sort(F.concat(F.coalesce("base", none), F.coalesce("added", none))).alias("_spans")
    )
    names = F.array(*map(F.lit, KINDS))
    text = F.col("text").cast("string")
    put = lambda s: F.when(s["start"] >= s["at"], F.concat(F.lit("["), F.upper(F.get(names, s["kind"])), F.lit("]"))).otherwise("")
    hits = F.transform("_spans", lambda s: s.withField("hit", F.lit(None).cast("string")))
    new = _replaced(text, _beside(hits), put)
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce(text, F.lit(""))))
    both = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    out = both.withColumn("text", F.when(F.col("_spans").isNull(), text).otherwise(new))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
