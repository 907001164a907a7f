"""Reconciling answers with segments by id, and numbering segments across files.

Where an id may come twice, the later one wins; tables carry an ``ord`` for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def matched(known: DataFrame, parsed: DataFrame) -> DataFrame:
    """(id, state) with state matched, unknown (not a known id) or missing (no answer), from one full join of id columns."""
    a = known.select("id", F.lit(True).alias("k")).distinct()
    b = parsed.select("id", F.lit(True).alias("p")).distinct()
    state = F.when(F.col("k").isNull(), "unknown").when(F.col("p").isNull(), "missing").otherwise("matched")
    return a.join(b, "id", "full_outer").select("id", state.alias("state"))


def import_counts(known: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: matched, unknown and missing, the last as a difference of counts."""
    state = matched(known, parsed)
    return state.agg(
        F.count_if(F.col("state") == "matched").alias("matched"),
        F.count_if(F.col("state") == "unknown").alias("unknown"),
        F.count_if(F.col("state") == "missing").alias("missing"),
    )


def merged(current: DataFrame, parsed: DataFrame, overwrite: bool = False) -> DataFrame:
    """(id, target, changed): current targets with parsed ones put in where blank, or everywhere with ``overwrite``.

    Parsed ids that are not current are left out.
    """
    blank = F.coalesce(F.trim("target"), F.lit("")) == ""
    new = F.col("new")
    take = new.isNotNull() & (blank | F.lit(overwrite))
    both = current.join(parsed.select("id", F.col("target").alias("new")), "id", "left")
    return both.select("id", F.when(take, new).otherwise(F.col("target")).alias("target"), F.coalesce(take & ~F.col("target").eqNullSafe(new), F.lit(False)).alias("changed"))


def build_stats(segments: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: replaced, untranslated, shrunk (scale under 0.98) and pages with a replacement.

    ``segments(id, page)``, ``targets(id, target, scale)``; a blank target is none.
    """
    done = F.coalesce(F.trim("target"), F.lit("")) != ""
    both = segments.join(targets, "id", "left")
    return both.agg(
        F.count_if(done).alias("replaced"),
        F.count_if(~done).alias("untranslated"),
        F.count_if(done & (F.col("scale") < 0.98)).alias("shrunk"),
        F.count_distinct(F.when(done, F.col("page"))).alias("pages"),
    )


def progress(segments: DataFrame, targets: DataFrame, *by: str) -> DataFrame:
    """total and done of the segments that are not skipped, by the given columns."""
    done = F.coalesce(F.trim("target"), F.lit("")) != ""
    return segments.where(~F.col("skip")).join(targets, "id", "left").groupBy(*by).agg(F.count("*").alias("total"), F.count_if(done).alias("done"))


def parts(segments: DataFrame, size: int = 1000, *by: str) -> DataFrame:
    """Adds part, from 1: ids in steps of ``size`` (20 at least); empty steps have no number."""
    bucket = F.floor((F.col("id") - 1) / max(size, 20))
    return segments.withColumn("part", F.dense_rank().over(Window.partitionBy(*by).orderBy(bucket)).cast("long"))


#: Numbers of files or ids that one task puts in order.
STEP = 1 << 16


def _slot(number: Column) -> Column:
    return F.floor(number / STEP).cast("long")


def offsets(files: DataFrame) -> DataFrame:
    """Adds offset, the sum of max_id of the files before by ord, a whole number; one row per file.

    Sums run inside slots of ``STEP`` numbers, whose totals are summed first: the window without a key sees one row per slot.
    """
    rows = files.withColumn("_slot", _slot(F.col("ord")))
    totals = rows.groupBy("_slot").agg(F.sum("max_id").alias("_total"))
    before = totals.select("_slot", F.coalesce(F.sum("_total").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum("max_id").over(Window.partitionBy("_slot").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(before, "_slot").withColumn("offset", F.col("_base") + F.col("_own")).drop("_slot", "_base", "_own")


def to_file(ids: DataFrame, files: DataFrame) -> DataFrame:
    """(gid, file_id, id) of each distinct global id: the file whose range holds it and the id in it; null if none does.

    Ids and the starts of files are put in order in one column, and each id takes the last file that starts before it. This runs inside slots
    of ``STEP`` ids; the file that is open at a slot's start comes from a window that sees one row per slot.
    """
    own = F.struct((F.col("offset") + 1).alias("first"), (F.col("offset") + F.col("max_id")).alias("last"), "file_id")
    starts = offsets(files).where("max_id > 0").select(own.alias("f")).select(_slot(F.col("f.first")).alias("slot"), F.col("f.first").cast("long").alias("at"), F.lit(0).alias("o"), "f")
    wanted = ids.select(F.col("gid").cast("long").alias("at")).distinct().select(_slot(F.col("at")).alias("slot"), "at", F.lit(1).alias("o"))
    both = starts.unionByName(wanted, allowMissingColumns=True)
    open_ = F.last("m", ignorenulls=True).over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = both.groupBy("slot").agg(F.max("f").alias("m")).select("slot", open_.alias("open"))
    last = F.last("f", ignorenulls=True).over(Window.partitionBy("slot").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("f", last).where("o = 1").join(slots, "slot").select("at", F.coalesce("f", "open").alias("f"))
    holds = F.col("at") <= F.col("f.last")
    return found.select(F.col("at").alias("gid"), F.when(holds, F.col("f.file_id")).alias("file_id"), F.when(holds, F.col("at") - F.col("f.first") + 1).alias("id"))


def by_occurrence(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """(id, old_id): the k-th new row of a key takes from the k-th old row of that key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    a = old.select(key, F.col("id").alias("old_id"), nth.alias("k"))
    return new.select(key, "id", nth.alias("k")).join(a, [key, "k"]).select("id", "old_id")


def three_way(base: DataFrame, incoming: DataFrame, current: DataFrame) -> DataFrame:
    """(id, target, changed): current, with the keys that incoming has changed from base; '' and absence are equal."""
    side = lambda df, name: df.select("id", F.col("target").alias(name))
    all_ = side(base, "b").join(side(incoming, "i"), "id", "full_outer").join(side(current, "c"), "id", "full_outer")
    b, i, c = (F.coalesce(x, F.lit("")) for x in ("b", "i", "c"))
    take = (i != b) & (c != i)
    out = all_.select("id", F.when(take, i).otherwise(c).alias("target"), take.alias("changed"))
    return out.where("target <> '' or changed")


def bookmark_targets(marks: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, target): bookmarks take the target of the segment with their text, or with their text without section numbers.

    A heading goes before a contents line (one with leader dots), then the smaller id.
    """

    def strip(x: Column) -> Column:
        one = F.trim(F.regexp_replace(x, "[ \\t\\n\\r\\x{00A0}]+", " "))
        return F.trim(F.regexp_replace(one, "[ ]*(?:[.·…_][ ]*){3,}[^ ]*[ ]*$", ""))

    number = lambda x: F.regexp_extract(strip(x), "^([0-9]+(?:\\.[0-9]+)*\\.?[ ]+)", 1)
    key = lambda x: F.lower(strip(x))
    bare = lambda x: F.substring(key(x), F.length(number(x)) + 1, F.length(x))
    t, toc = F.col("text"), F.col("text").rlike("(?:[.·…_][ ]*){3,}")
    have = segments.where("trim(target) <> ''").select(key(t).alias("key"), bare(t).alias("bare"), F.struct(toc.alias("toc"), "id", F.trim("target").alias("target")).alias("v"))
    exact = have.where("key <> ''").groupBy("key").agg(F.min("v").alias("e"))
    loose = have.where("bare <> ''").groupBy("bare").agg(F.min("v").alias("l"))
    both = marks.withColumn("key", key(t)).withColumn("bare", bare(t)).join(exact, "key", "left").join(loose, "bare", "left")
    tail = strip(F.col("l.target"))
    target = F.when(F.col("e").isNotNull(), strip(F.col("e.target"))).when(
        F.col("l").isNotNull(), F.concat(number(t), F.substring(tail, F.length(number(F.col("l.target"))) + 1, F.length(tail)))
    )
    return both.select("id", target.alias("target"))


def renumbered(rows: DataFrame, *order: str) -> DataFrame:
    """(old_id, id): ids 1..n in the given order, counted in ranges, so that no task sorts all rows."""
    dealt = rows.select(F.col("id").alias("old_id"), *order).repartitionByRange(*order, "old_id").sortWithinPartitions(*order, "old_id")
    part = dealt.withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id())
    local = F.row_number().over(Window.partitionBy("p").orderBy("m"))
    numbered = part.withColumn("n", local)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    base = numbered.groupBy("p").agg(F.count("*").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0)))
    return numbered.join(base, "p").select("old_id", (F.col("base") + F.col("n")).alias("id"))


def id_ranges(rows: DataFrame, key: str) -> DataFrame:
    """(key, ranges): distinct numbers as '1-3,5'."""
    n = rows.select(key, "n").distinct().withColumn("g", F.col("n") - F.row_number().over(Window.partitionBy(key).orderBy("n")))
    runs = n.groupBy(key, "g").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    said = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    made = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a", said.alias("s")))).alias("all"))
    return made.select(key, F.array_join(F.transform("all", lambda x: x["s"]), ",").alias("ranges"))


def page_ranges(text: Column, pages: Column) -> Column:
    """Pages of a list such as '1-3,7, -5, 9-': sorted, distinct and zero-based; null if any part is wrong or none is there."""
    parts_ = F.filter(F.split(text, "[,; \\t]+"), lambda p: p != "")
    whole = "^([0-9]{0,9})(?:([-–])([0-9]{0,9}))?$"

    def span(p: Column) -> Column:
        a, dash, b = (F.regexp_extract(p, whole, i) for i in (1, 2, 3))
        lo = F.coalesce(a.try_cast("int"), F.lit(1))
        hi = F.when(dash == "", lo).otherwise(F.coalesce(b.try_cast("int"), pages.cast("int")))
        ok = p.rlike(whole) & ((a != "") | (b != "")) & (lo >= 1) & (hi <= pages) & (lo <= hi)
        return F.when(ok, F.sequence(F.least(lo, hi), F.greatest(lo, hi)))

    spans = F.transform(parts_, span)
    good = (F.size(parts_) > 0) & F.forall(spans, lambda s: s.isNotNull())
    return F.when(good, F.transform(F.array_sort(F.array_distinct(F.flatten(spans))), lambda v: v - 1))


def marker_issues(source: Column, target: Column) -> Column:
    """(missing, broken) counts of numbered tags: in the source but not in the target; unknown, or not opened before it is closed or never
    closed, in the target."""
    tag = F.lit("</?[0-9]+/?>")
    a, b = F.array_distinct(F.regexp_extract_all(source, tag, F.lit(0))), F.regexp_extract_all(target, tag, F.lit(0))
    opens = F.array_distinct(F.filter(b, lambda t: t.rlike("^<[0-9]+>$")))
    closes = F.array_distinct(F.filter(b, lambda t: t.startswith("</")))
    end = lambda t: F.replace(t, F.lit("<"), F.lit("</"))
    # The last closing tag must come after the first opening one.
    last = lambda t: F.size(b) + 1 - F.array_position(F.reverse(b), t)
    unpaired = F.filter(opens, lambda t: ~F.array_contains(b, end(t)) | (F.array_position(b, t) > last(end(t))))
    lone = F.size(unpaired) + F.size(F.filter(closes, lambda t: ~F.array_contains(b, F.replace(t, F.lit("/"), F.lit("")))))
    return F.struct(F.size(F.array_except(a, b)).alias("missing"), (F.size(F.array_except(b, a)) + lone).alias("broken"))


def overridden(rows: DataFrame, overrides: DataFrame, *columns: str) -> DataFrame:
    """Rows with a user's values (by id) in place of detected ones where they are not null."""
    named = overrides.select("id", *(F.col(c).alias(f"_{c}") for c in columns))
    both = rows.join(named, "id", "left")
    return both.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def kinds(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """skip and formula as a user has chosen (kind 'formula' or 'text' by id), else as detected."""
    both = segments.join(chosen.select("id", "kind"), "id", "left")
    pick = lambda c: F.when(F.col("kind") == "formula", True).when(F.col("kind") == "text", False).otherwise(F.col(c))
    return both.withColumns({"skip": pick("skip"), "formula": pick("formula")}).drop("kind")


def unread_formulas(groups: DataFrame, latex: DataFrame) -> DataFrame:
    """Leads of formula groups without LaTeX."""
    return groups.select(F.col("lead").alias("id")).distinct().join(latex.where("trim(latex) <> ''").select("id"), "id", "left_anti")


def done_count(segments: DataFrame, targets: DataFrame, kept: DataFrame, *by: str) -> DataFrame:
    """Segments with a target or kept as they are, by the given columns."""
    both = segments.join(targets.select("id", "target"), "id", "left").join(kept.select("id", F.lit(True).alias("_k")).distinct(), "id", "left")
    return both.groupBy(*by).agg(F.count_if(F.coalesce("_k", F.lit(False)) | (F.coalesce(F.trim("target"), F.lit("")) != "")).alias("done"))


#: Levels of an outline, the first being 0, and entries of a history that are kept (fixed values).
DEPTH, HISTORY = 32, 300


def outline(items: DataFrame) -> DataFrame:
    """(doc_id, id, i, depth) of an outline's items in reading order: a parent before its children, these by ``ord``.

    ``items(doc_id, id, parent, ord)``; a null parent is the top. Paths are doubled in each round, so that the levels of
    an outline take few joins; items below level ``DEPTH`` or above no top are left out.
    """
    step = F.struct("ord", "id")
    paths = items.select("doc_id", "id", F.col("parent").alias("up"), F.array(step).alias("path"))
    for _ in range(DEPTH.bit_length()):
        above = paths.select("doc_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        both = paths.join(above, ["doc_id", "up"], "left")
        paths = both.select("doc_id", "id", F.when(F.col("_path").isNull(), F.col("up")).otherwise(F.col("_up")).alias("up"), F.concat(F.coalesce("_path", F.array().cast(paths.schema["path"].dataType)), "path").alias("path"))
    whole = paths.where(F.col("up").isNull() & (F.size("path") <= DEPTH + 1))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    return whole.select("doc_id", "id", place.alias("i"), (F.size("path") - 1).alias("depth"))


def undone(targets: DataFrame, log: DataFrame, steps: Column, *by: str) -> DataFrame:
    """(by..., id, target) once the last ``steps`` entries of each history are undone; blank targets are left out.

    ``log`` has by..., ord (the entry), id and before; of a history the last ``HISTORY`` entries are kept. What an id was before the first
    undone entry that changed it is what it is again.
    """
    entries = log.select(*by, "ord").distinct().withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ord"))))
    gone = entries.where((F.col("back") <= F.least(steps, F.lit(HISTORY)))).drop("back")
    was = log.join(gone, [*by, "ord"]).groupBy(*by, "id").agg(F.min_by(F.struct("before"), "ord").alias("was"))
    both = targets.join(was, [*by, "id"], "full_outer")
    now = F.when(F.col("was").isNotNull(), F.col("was.before")).otherwise(F.col("target"))
    return both.select(*by, "id", now.alias("target")).where(F.coalesce(F.trim("target"), F.lit("")) != "")


#: Characters of a segment that are looked for; length under which a text is short, and how far ahead one may be found (fixed values).
PROBE, SHORT_TEXT, FAR = 48, 8, 4000


def match_key(text: Column) -> Column:
    """A text as it is compared: lower case, without numbered tags, white space and soft hyphens."""
    bare = F.regexp_replace(F.regexp_replace(text, "</?[0-9]+/?>", ""), "‹(/?[0-9]+/?)›", "<$1>")
    return F.lower(F.regexp_replace(bare, "[\\s\\p{Z}\\x{00AD}]", ""))


def places(text: str, keys: list[str]) -> list[tuple[int, int]]:
    """(number, start) of the keys that are found in turn, each after the end of the last one found.

    A place is not taken if a short key has it far ahead, or if the key that follows is found before it: then it is another one's.
    """
    out, at = [], 0
    for i, key in enumerate(keys):
        start = text.find(key[:PROBE], at)
        if start < 0 or (len(key) < SHORT_TEXT and start - at > FAR):
            continue
        if i + 1 < len(keys) and start > at and 0 <= text.find(keys[i + 1][:PROBE], at, start + len(keys[i + 1][:PROBE]) - 1) < start:
            continue
        out.append((i, start))
        at = min(start + len(key), len(text))
    return out


def laid_out(books: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, id, start, length): where a book's segments stand in its text, both as ``match_key`` sees them.

    ``books(doc_id, text)``, ``segments(doc_id, ord, id, text, hidden)``. Each place depends on those before it, so a book is worked on as one row;
    hidden and blank segments have no place.
    """
    key = match_key(F.col("text"))
    own = segments.where(~F.col("hidden")).select("doc_id", "ord", "id", key.alias("key")).where("key <> ''")
    own = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "key"))).alias("own"))
    rows = books.select("doc_id", key.alias("text")).join(own, "doc_id").select("doc_id", "text", F.col("own.id").alias("ids"), F.col("own.key").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, ids, keys in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ids", "keys"))):
                out += [(doc, ids[i], start, len(keys[i])) for i, start in places(text or "", keys)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "id", "start", "length"])

    return rows.select(F.col("doc_id").cast("long"), "text", F.col("ids").cast("array<long>").alias("ids"), "keys").mapInArrow(run, "doc_id long, id long, start long, length long")
