"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A document is the multiset of its five-word shingles, a shingle's weight being its count.
Similarity is the probability Jaccard
``J_P(x, y) = sum_d 1 / sum_e max(x_e / x_d, y_e / y_d)``; with equal weights it is the plain
Jaccard similarity. Each shingle is a Poisson process with its weight as rate; each arrival
falls into one of ``bands * rows`` registers, which keep the earliest. A document stops as
soon as no shingle can arrive before the latest of its registers. Registers are banded. A document is
compared exactly with the first of all documents that it shares a bucket with, which gives a forest; then with the first of each
bucket where both are still in different components. Where that leaves several components in a bucket,
all pairs across components are compared: one by one in small buckets, by matrix products over blocks in large ones.

With 24 bands of 4 rows a pair of similarity 0.8 is missed with probability 3e-6.

Defined results: null and empty texts have no shingles and link with nothing; texts of one
to four words are one shingle; texts with the same weighted shingles (copies among them) are one
class and are compared once; rows with a null doc_id link with nothing and are kept. Rows that share a
doc_id are documents of their own, each with its own class and group; of the rows of a group exactly one is kept, that of the smallest
doc_id (then of the smallest hash of its text; of equal rows any one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, extended
from .shingles import mix, weighted_shingles
from .storage import discard, staged

BANDS, ROWS, K, THRESHOLD = 24, 4, 5, 0.8
#: Characters whose shingles are in memory at a time.
SLICE = 600_000
#: Rows up to which a bucket's pairs are compared one by one; documents and bytes of shingles on a side of a block in larger ones.
SMALL, BLOCK, BYTES = 12, 1024, 8_000_000

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def slices(texts: list | pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about ``limit`` characters (bytes, for an Arrow array)."""
    sizes = pc.binary_length(texts).to_pylist() if isinstance(texts, pa.Array) else [len(t or "") for t in texts]
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += n or 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def probminhash(h: np.ndarray, w: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Registers (docs x m) of 64 bits: the earliest arrival's time above the shingle's 32 bits."""
    regs = np.full(docs * m, _EMPTY, np.uint64)
    seed, ident = mix(h), mix(h ^ np.uint64(0x5BD1E995)) & np.uint64(0xFFFFFFFF)
    rate, time, drawn = w.astype(np.float64), np.zeros(len(h)), np.uint64(0)
    base = doc.astype(np.int64) * m
    while len(h):
        block = max(1, min(32, 40_000 // len(h)))
        nth = drawn + np.arange(1, block + 1, dtype=np.uint64)
        r = mix(seed[:, None] + nth[None, :] * np.uint64(0x9E3779B97F4A7C15))
        u = ((r >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
        t = time[:, None] + np.cumsum(-np.log(u), axis=1) / rate[:, None]
        reg = (mix(r + np.uint64(1)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        key = (t.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | ident[:, None]
        np.minimum.at(regs, (base[:, None] + reg.astype(np.int64)).ravel(), key.ravel())
        time, drawn = t[:, -1], drawn + np.uint64(block)
        late = regs.reshape(docs, m).max(axis=1)
        limit = np.where(late == _EMPTY, np.inf, (late >> np.uint64(32)).astype(np.uint32).view(np.float32))
        go = time <= limit[doc]
        h, seed, ident, rate, time, doc, base = (a[go] for a in (h, seed, ident, rate, time, doc, base))
    return regs.reshape(docs, m)


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket for each document and band; buckets of different bands differ."""
    ident = (regs & np.uint64(0xFFFFFFFF)).reshape(len(regs), bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), ident.shape[:2]).copy()
    for i in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ident[:, :, i])
    return out


def probability_jaccard(h1, w1, h2, w2) -> float:
    """J_P of two documents, given as sorted distinct hashes and their weights (None: all 1)."""
    common, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if w1 is None and w2 is None:
        return len(common) / (len(h1) + len(h2) - len(common))
    w1 = np.ones(len(h1)) if w1 is None else w1.astype(np.float64)
    w2 = np.ones(len(h2)) if w2 is None else w2.astype(np.float64)
    x, y = w1[i], w2[j]
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    below = np.concatenate(([0.0], np.cumsum(x)))[upto] + (w1.sum() - x.sum())
    above = w2.sum() - np.concatenate(([0.0], np.cumsum(y)))[upto]
    return float((1.0 / (below / x + above / y)).sum())


def signatures(docs: DataFrame, k: int = K, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, h, k1, k2, bands): hash of the text, a 128-bit key of the weighted shingles and the buckets; bands null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.columns
            for a, b in slices(texts):
                h, w, doc = weighted_shingles(texts.slice(a, b - a).to_pylist(), k)
                n = b - a
                keys = band_keys(probminhash(h, w, doc, n, bands * rows), bands, rows)
                mark = []
                for salt in (0x2545F491, 0x6C8E9CF5):
                    s = np.zeros(n, np.uint64)
                    np.add.at(s, doc, mix(mix(h ^ np.uint64(salt)) + w.astype(np.uint64)))
                    mark.append(s.view(np.int64))
                have = np.zeros(n, bool)
                have[doc] = True
                flat = pa.array(keys.view(np.int64).ravel()[np.repeat(have, bands)])
                offsets = np.concatenate(([0], np.cumsum(have * bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~have))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, n), hashes.slice(a, n), pa.array(mark[0]), pa.array(mark[1]), lists],
                    names=["doc_id", "h", "k1", "k2", "bands"],
                )

    return _keyed(docs).mapInArrow(run, "doc_id long, h long, k1 long, k2 long, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): rows equal in doc_id and h are equal in their text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, h, w, bytes): distinct shingle hashes, sorted, and weights unless all are 1, as bytes, and the number of both's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                h, w, doc = weighted_shingles(texts.slice(a, b - a).to_pylist(), k)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                hs, ws = [], []
                for s, e in zip(cut[:-1], cut[1:]):
                    hs.append(h[s:e].tobytes())
                    ws.append(None if (w[s:e] == 1).all() else w[s:e].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(hs, pa.binary()), pa.array(ws, pa.binary()), pa.array([len(x) + len(y or b"") for x, y in zip(hs, ws)], pa.int64())],
                    names=["node", "h", "w", "bytes"],
                )

    return docs.mapInArrow(run, "node long, h binary, w binary, bytes long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs(a, b)`` with similarity of the threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in zip(*(batch.column(c) for c in ("h1", "w1", "h2", "w2"))):
                h1, w1, h2, w2 = (np.frombuffer(x.as_buffer(), kind) if x.is_valid else None for x, kind in zip(row, (np.uint64, np.uint32) * 2))
                keep.append(probability_jaccard(h1, w1, h2, w2) >= threshold - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(name: str, n: int) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("h").alias(f"h{n}"), F.col("w").alias(f"w{n}"))

    both = pairs.join(side("b", 2), "b").join(side("a", 1), "a")
    return both.select("a", "b", "h1", "w1", "h2", "w2").mapInArrow(run, "a long, b long")


def _mixed(crowd: DataFrame, comp: DataFrame) -> DataFrame:
    """(bucket, rep, lead, component, n) of the buckets with more than one component; n counts a bucket's rows."""
    placed = crowd.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "lead", F.coalesce("component", "rep").alias("component"))
    many = placed.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n")).where("c0 < c1")
    return placed.join(staged(many.select("bucket", "n"), "mixed-buckets"), "bucket")


def _block_links(mixed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links that join the components of large buckets, as (a, b).

    Components that share a large bucket are a cluster. The documents outside its largest
    component are compared with all of it, in blocks of about ``BLOCK`` by ``BLOCK`` documents, fewer
    if their shingles take more than ``BYTES``; each block returns only links which join two components.
    """
    ends = staged(mixed.groupBy("bucket").agg(F.min("component").alias("a")), "bucket-ends")
    cluster = connected_components(mixed.join(ends, "bucket").select("a", F.col("component").alias("b")).distinct())
    rows = mixed.select("rep", "component").distinct().join(cluster.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "component")
    rows = staged(rows.join(sets.select(F.col("node").alias("rep"), "bytes"), "rep"), "clustered")
    sizes = rows.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    cores = sizes.groupBy("cluster").agg(F.max(F.struct("n", "component", "bytes")).alias("m"), F.sum("n").alias("all"), F.sum("bytes").alias("bytes"))

    def blocks(n: str, size: str) -> Column:
        return F.ceil(F.greatest(F.expr(n) / BLOCK, F.expr(size) / BYTES)).cast("int")

    cores = cores.select(
        "cluster", F.col("m.component").alias("core"), blocks("`all` - m.n", "bytes - m.bytes").alias("asked"), blocks("`all`", "bytes").alias("held")
    )
    dealt = rows.drop("bytes").join(staged(cores, "cluster-cores"), "cluster").withColumn("deal", F.xxhash64("rep"))
    queries = dealt.where("component <> core").select("cluster", F.pmod("deal", "asked").alias("i"), F.explode(F.sequence(F.lit(0), F.col("held") - 1)).alias("j"), "rep", "component", F.lit(True).alias("query"))
    held = dealt.select("cluster", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("i"), F.pmod("deal", "held").alias("j"), "rep", "component", F.lit(False).alias("query"))
    both = queries.select(*held.columns).unionByName(held).join(sets.select(F.col("node").alias("rep"), "h", "w"), "rep")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(rows, threshold), columns=["a", "b"], dtype=np.int64)

    return both.groupBy("cluster", "i", "j").applyInPandas(run, "a long, b long")


def block_links(rows: pd.DataFrame, threshold: float) -> list[tuple[int, int]]:
    """Links between queries and held documents that join two components.

    For shared shingles S, J_P is at most the weight of S in either document, as a share of its own; products of
    matrices find the pairs that may reach the threshold, which are then computed exactly unless
    their components have been joined.
    """
    held = rows[~rows["query"]].drop_duplicates("rep")
    asked = rows[rows["query"]].drop_duplicates("rep")
    if not len(held) or not len(asked):
        return []

    def unpack(side: pd.DataFrame):
        hs = [np.frombuffer(x, np.uint64) for x in side["h"]]
        ws = [None if x is None else np.frombuffer(x, np.uint32) for x in side["w"]]
        flat = np.concatenate(hs)
        share = np.concatenate([np.full(len(h), 1 / len(h)) if w is None else w / w.sum() for h, w in zip(hs, ws)]).astype(np.float32)
        doc = np.repeat(np.arange(len(hs)), [len(h) for h in hs])
        order = np.argsort(flat, kind="stable")
        return hs, ws, flat[order], share[order], doc[order]

    h2, w2, flat2, share2, doc2 = unpack(held)
    ids1, ids2 = asked["rep"].to_numpy(), held["rep"].to_numpy()
    names = {c: i for i, c in enumerate(pd.concat((asked["component"], held["component"])).unique())}
    up = list(range(len(names)))

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    c1, c2 = asked["component"].map(names).to_numpy(), held["component"].map(names).to_numpy()
    width = max(256, 8_000_000 // len(held))
    out = []
    for at in range(0, len(asked), 64):
        part = asked.iloc[at : at + 64]
        h1, w1, flat1, share1, doc1 = unpack(part)
        vocabulary = np.unique(flat1)
        mass1, mass2 = np.zeros((len(part), len(held)), np.float32), np.zeros((len(part), len(held)), np.float32)
        for v in range(0, len(vocabulary), width):
            some = vocabulary[v : v + width]
            sides = []
            for flat, share, doc, n in ((flat1, share1, doc1, len(part)), (flat2, share2, doc2, len(held))):
                lo, hi = np.searchsorted(flat, some[0], "left"), np.searchsorted(flat, some[-1], "right")
                col = np.minimum(np.searchsorted(some, flat[lo:hi]), len(some) - 1)
                hit = some[col] == flat[lo:hi]
                has, mass = np.zeros((n, len(some)), np.float32), np.zeros((n, len(some)), np.float32)
                has[doc[lo:hi][hit], col[hit]] = 1
                mass[doc[lo:hi][hit], col[hit]] = share[lo:hi][hit]
                sides.append((has, mass))
            (a1, m1), (a2, m2) = sides
            mass1 += m1 @ a2.T
            mass2 += a1 @ m2.T
        may = np.minimum(mass1, mass2) >= threshold - 1e-3
        for i in range(len(part)):
            own = c1[at + i]
            near = np.flatnonzero(may[i])
            for j in near[np.argsort(-np.minimum(mass1[i, near], mass2[i, near]), kind="stable")]:
                a, b = top(own), top(c2[j])
                if a != b and probability_jaccard(h1[i], w1[i], h2[j], w2[j]) >= threshold - 1e-9:
                    up[max(a, b)] = min(a, b)
                    out.append((int(ids1[at + i]), int(ids2[j])))
    return out


def grouped(docs: DataFrame, k: int = K, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: (doc_id, h, class_id, group_id, kept), h being a hash of the text."""
    # Numbers that are written stand for the rows from here on.
    sig = staged(signatures(docs, k, bands, rows).withColumn("no", F.monotonically_increasing_id()), "signatures")
    able = sig.where("doc_id is not null and bands is not null")
    # A sum that is written first joins by an exchange of its own, which Spark can split where one key has very many rows.
    heads = staged(able.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "h", "no")).alias("head")), "class-heads")
    first = F.col("no") == F.col("head.no")
    member = able.join(heads, ["k1", "k2"]).select(
        "doc_id", "h", "no", F.col("head.no").alias("node"), F.col("head.doc_id").alias("class_id"), F.when(first, F.col("bands")).alias("bands"),
        (~first & (F.col("doc_id") == F.col("head.doc_id")) & (F.col("h") == F.col("head.h"))).alias("again"),
    )
    member = staged(member, "classes")
    head = member.where("bands is not null")
    row = head.select("node", F.explode("bands").alias("bucket"))
    ends = staged(row.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last"), "bucket-ends")
    crowd = staged(row.join(ends.select("bucket", "lead"), "bucket").select("bucket", F.col("node").alias("rep"), "lead"), "buckets")
    nodes = head.select("doc_id", "h", "node").join(crowd.select(F.col("rep").alias("node")).distinct(), "node", "left_semi")
    sets = _shingle_sets(_keyed(docs).join(nodes, ["doc_id", "h"]).select("node", "text"), k)
    # Rows repeated with their doc_id can't be told apart in ``docs``.
    sets = staged(sets if member.where("again").isEmpty() else sets.dropDuplicates(["node"]), "shingles")

    # One link for each document, to an earlier one: a forest.
    led = crowd.where("rep > lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    links = _verified(led.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, threshold)
    comp = connected_components(links)
    # The first of each other bucket, where that joins two components.
    other = comp.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    own = comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    apart = led.join(own, "b", "left").join(other, "a", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").distinct()
    comp = extended(comp, staged(_verified(apart, sets, threshold), "links"))

    # Buckets whose members are still in different components: small ones pair by pair, large ones in blocks.
    left = staged(_mixed(crowd, comp), "mixed")
    if not left.isEmpty():
        small = left.where(F.col("n") <= SMALL).select("bucket", "rep", "component")
        other = small.select("bucket", F.col("rep").alias("a"), F.col("component").alias("c"))
        more = other.join(small, "bucket").where("a < rep and c <> component").select("a", F.col("rep").alias("b")).distinct()
        comp = extended(comp, staged(_verified(more, sets, threshold), "links"))
        large = left.where(F.col("n") > SMALL).select("bucket", "rep", "lead")
        if not large.isEmpty():
            comp = extended(comp, staged(_block_links(staged(_mixed(large, comp), "mixed"), sets, threshold), "links"))

    # The first row of each group of several classes, then the group of each class.
    firsts = comp.join(head.select("node", "doc_id", "h"), "node").groupBy("component").agg(F.min(F.struct("doc_id", "h", "node")).alias("first"))
    named = staged(comp.join(staged(firsts, "group-heads"), "component").select("node", "first"), "groups")
    for spent in (ends, crowd, sets, left, comp):
        discard(spent)
    linked = member.join(named, "node", "left").select(
        "doc_id", "h", "class_id", F.coalesce("first.doc_id", "class_id").alias("group_id"), (F.col("no") == F.coalesce("first.node", "node")).alias("kept")
    )
    alone = sig.where("doc_id is null or bands is null").select(
        "doc_id", "h", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(True).alias("kept")
    )
    return linked.unionByName(alone)


def near_duplicates(
    docs: DataFrame, k: int = K, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, class_id, group_id, kept).

    class_id is the smallest doc_id with the same weighted shingles, group_id the smallest doc_id
    reachable by links of at least ``threshold``; of the rows of a group one is kept.
    """
    return grouped(docs, k, bands, rows, threshold).select("doc_id", "class_id", "group_id", "kept")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: one of each group, all without shingles or doc_id.

    Of rows equal in doc_id and text, but not in other columns, any one is kept.
    """
    found = grouped(docs, **options).where("doc_id is not null")
    # Rows are known by doc_id and text. Some of those with the same may stay: all have no shingles, or one is kept.
    spare = found.groupBy("doc_id", "h").agg(F.count_if("kept").alias("stay"), F.count("*").alias("n")).where("stay < n")
    spare = staged(spare.select("doc_id", "h", "stay"), "spare-rows")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"),
    )
    out = rows.join(spare, ["doc_id", "h"], "left_anti").select("row.*")
    again = spare.where("stay > 0")
    if not again.isEmpty():
        out = out.union(rows.join(again, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).select("row.*"))
    return out
