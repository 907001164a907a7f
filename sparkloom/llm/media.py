"""Media columns in a chunk store: content-defined chunks, deduplicated by their digests.

A payload (the text's UTF-8 bytes, filled with bytes 255 to a positive multiple of 576) is cut where
a rolling gear hash of the last 32 bytes has eleven zero bits, so that an insertion moves no
later cut. Chunks are named by SHA-256. Joins on digests tell which payloads are copies and which chunks
occur in several payloads; each of those is stored once, in its own row. A payload is stored once as a recipe
(the ordered list of chunk digests and lengths) with its other chunks as one compressed body. Reading joins the
shared chunks to the recipes, puts the chunks in order and verifies every digest and the payload's.

The stored form that media_bytes and media_sha256 describe is all that a payload takes in the store, as read back: its
recipe, its own body and the bodies of the shared chunks in the recipe's order, compressed as they are stored.

Copies and shared chunks are marked by a table of exceptions, (doc_id, text hash) -> role. Up to
``BROADCAST_ENTRIES`` rows and chunk numbers of it are broadcast, so that texts are not shuffled; beyond it the join shuffles.

Defined results: a null or empty text is a payload of 576 fill bytes; every input row is returned, repeated
rows and null doc_ids too.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import slices
from .shingles import mix
from .storage import staged

UNIT, FILL = 576, b"\xff"
#: Least and greatest chunk length; zero bits that make a cut, for 2 KiB between cuts on average.
LEAST, MOST, BITS = 512, 16384, 11
WINDOW = 32
#: Rows and chunk numbers, of 40 bytes at most, in a broadcast.
BROADCAST_ENTRIES = 1_000_000
MAGIC = b"CDR2"
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + FILL * ((-len(raw)) % UNIT if raw else UNIT)


def cut_points(payloads: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each payload."""
    buf = np.frombuffer(b"".join(payloads), np.uint8)
    h = _GEAR[buf]
    step = 1
    while step < WINDOW:  # the hash of 2n bytes from those of n bytes
        up = h.copy()
        up[step:] += h[:-step] << np.uint32(step)
        h, step = up, step * 2
    marks = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1
    out, base = [], 0
    for p in payloads:
        ends, at, n = [], 0, len(p)
        # Least chunk length exceeds the window, so no hash used here has seen the payload before.
        lo = np.searchsorted(marks, base)
        near = marks[lo : np.searchsorted(marks, base + n)] - base
        i = 0
        while n - at > LEAST:
            i += int(np.searchsorted(near[i:], at + LEAST))
            end = min(int(near[i]) if i < len(near) else n, at + MOST, n)
            ends.append(end)
            at = end
        if at < n:
            ends.append(n)
        out.append(ends)
        base += n
    return out


def chunks(payload: bytes, ends: list[int]) -> list[bytes]:
    return [payload[a:b] for a, b in zip([0, *ends[:-1]], ends)]


_HEAD, _ENTRY = struct.Struct("<4sIQ"), struct.Struct("<I?32s")


def recipe(lengths: list[int], elsewhere: list[bool], digests: list[bytes]) -> bytes:
    """The chunks of a payload in order: length, whether it is stored in a row of its own, digest."""
    return _HEAD.pack(MAGIC, len(digests), sum(lengths)) + b"".join(map(_ENTRY.pack, lengths, elsewhere, digests))


def read_recipe(raw: bytes) -> list[tuple[int, bool, bytes]]:
    magic, n, size = _HEAD.unpack_from(raw)
    entries = list(_ENTRY.iter_unpack(raw[_HEAD.size :]))
    if magic != MAGIC or len(entries) != n or sum(e[0] for e in entries) != size:
        raise ValueError("not a recipe")
    return entries


def feature(samples: bytes) -> str:
    """Mean, deviation, mean crossings and entropy (bits) of the 8-bit samples."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256) / len(x)
    mean = float(n @ np.arange(256))
    dev = float(np.sqrt(max(n @ (np.arange(256) - mean) ** 2, 0)))
    above = x > mean
    p = n[n > 0]
    return f"{mean:.4f};{dev:.4f};{int((above[1:] != above[:-1]).sum())};{abs(float(-(p * np.log2(p)).sum())):.4f}"


_KEY = ["k", "h"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    # Rows with the same k and h have the same text, and so the same role, whichever of them have no doc_id.
    return docs.select(F.coalesce(doc, F.lit(-(1 << 63)).cast("long")).alias("k"), F.xxhash64(text).alias("h"), doc.isNull().alias("no_id"), text.alias("text"))


def _index(keyed: DataFrame) -> DataFrame:
    """(k, h, no_id, sha, n_bytes, digests) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                both = [payload(t) for t in texts[a:b]]
                raw = [p for _, p in both]
                digests = [[hashlib.sha256(c).digest() for c in chunks(p, e)] for p, e in zip(raw, cut_points(raw))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("k", "h", "no_id")), pa.array([hashlib.sha256(p).digest() for p in raw], pa.binary()),
                     pa.array([n for n, _ in both], pa.int64()), pa.array(digests, pa.list_(pa.binary()))],
                    names=["k", "h", "no_id", "sha", "n_bytes", "digests"],
                )

    return keyed.mapInArrow(run, "k long, h long, no_id boolean, sha binary, n_bytes long, digests array<binary>")


def _exceptions(index: DataFrame) -> DataFrame:
    """(k, h, owner, shared): rows that are copies (owner false) or have chunks that other payloads have too.

    shared: (chunk number, whether this row stores it).
    """
    owner = index.groupBy("sha").agg(F.min("k").alias("owner_k"), F.count("*").alias("n"))
    # Sums that are written first join by an exchange of their own, which Spark can split where one key has very many rows.
    several = staged(owner.where("n > 1").select("sha", "owner_k"), "media-copies")
    roles = index.select("k", "h", "sha").join(several, "sha", "left").withColumn("owner", F.coalesce(F.col("k") == F.col("owner_k"), F.lit(True)))
    roles = roles.select("k", "h", "owner")
    copies = roles.where("not owner").select("k", "h").distinct()
    lists = index.select("k", "h", F.posexplode("digests").alias("no", "digest"))
    held = lists.join(copies, _KEY, "left_anti")
    common = held.groupBy("digest").agg(F.min("k").alias("keeper"), F.max("k").alias("other")).where("keeper < other")
    common = staged(common.select("digest", "keeper"), "media-common")
    shared = (
        held.join(common, "digest")
        .select("k", "h", F.struct("no", (F.col("k") == F.col("keeper")).alias("mine")).alias("s"))
        .groupBy("k", "h")
        .agg(F.array_sort(F.collect_set("s")).alias("shared"))
        .select("k", "h", F.lit(True).alias("owner"), "shared")
    )
    none = F.array().cast("array<struct<no:int,mine:boolean>>")
    return shared.unionByName(copies.select("k", "h", F.lit(False).alias("owner"), none.alias("shared")))


def _stored(keyed: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Rows of the store: kind 'payload' (name: its digest, recipe, elsewhere: digests of the chunks stored in rows of their own,
    body: the other chunks) and kind 'chunk' (name: its digest, body)."""
    entries = exceptions.agg(F.sum(1 + F.size("shared"))).first()[0] or 0
    if entries <= BROADCAST_ENTRIES:
        exceptions = F.broadcast(exceptions)
    rows = keyed.join(exceptions, _KEY, "left").where(F.coalesce("owner", F.lit(True)))
    schema = "kind string, name binary, recipe binary, elsewhere array<binary>, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=6)
        types = [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary()]
        for batch in batches:
            texts, marks = batch.column("text").to_pylist(), batch.column("shared").to_pylist()
            for a, b in slices(texts):
                raw = [payload(t)[1] for t in texts[a:b]]
                out: list[tuple] = []
                for p, ends, shared in zip(raw, cut_points(raw), marks[a:b]):
                    parts = chunks(p, ends)
                    digests = [hashlib.sha256(c).digest() for c in parts]
                    away = {s["no"]: s["mine"] for s in shared or ()}
                    done = set()
                    for no, mine in away.items():
                        if mine and digests[no] not in done:
                            done.add(digests[no])
                            out.append(("chunk", digests[no], None, None, z.compress(parts[no])))
                    body = b"".join(c for no, c in enumerate(parts) if no not in away)
                    made = recipe(list(map(len, parts)), [no in away for no in range(len(parts))], digests)
                    out.append(("payload", hashlib.sha256(p).digest(), made, sorted({digests[no] for no in away}), z.compress(body)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in schema.split(", ")])

    return rows.select("text", "shared").mapInArrow(run, schema)


_MEDIA = "sha binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"


def _read(rows: DataFrame) -> DataFrame:
    """Payloads rebuilt from rows (name, recipe, body, parts), verified and described."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                stored = {x["name"]: x["body"] for x in row["parts"] or ()}
                media, size = hashlib.sha256(row["recipe"] + row["body"]), len(row["recipe"]) + len(row["body"])
                body, at, parts = z.decompress(row["body"]), 0, []
                for n, elsewhere, digest in read_recipe(row["recipe"]):
                    if elsewhere:
                        media.update(stored[digest])
                        size += len(stored[digest])
                        parts.append(z.decompress(stored[digest]))
                    else:
                        parts.append(body[at : at + n])
                        at += n
                    if hashlib.sha256(parts[-1]).digest() != digest:
                        raise ValueError("a chunk is not what its digest says")
                whole = b"".join(parts)
                if hashlib.sha256(whole).digest() != row["name"]:
                    raise ValueError("a payload is not what its digest says")
                out.append((row["name"], len(whole), row["name"].hex(), zlib.crc32(whole[-32:]), size, media.hexdigest(), feature(whole), len(parts)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in _MEDIA.split(", ")])

    return rows.mapInArrow(run, _MEDIA)


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, store): the rows' payload digests, and the chunk store written to the shared folder."""
    keyed = _keyed(docs)
    index = staged(_index(keyed), "media-index")
    return index, staged(_stored(keyed, staged(_exceptions(index), "media-shared")), "media-store")


def load(chunk_store: DataFrame) -> DataFrame:
    """Every payload of a store, read back: a row for each."""
    whole = chunk_store.where("kind = 'payload'").select("name", "recipe", "elsewhere", "body")
    alone = whole.where(F.size("elsewhere") == 0).withColumn("parts", F.lit(None).cast("array<struct<name:binary,body:binary>>"))
    linked = whole.where(F.size("elsewhere") > 0)
    single = chunk_store.where("kind = 'chunk'").select(F.col("name").alias("chunk"), F.col("body").alias("chunk_body"))
    wanted = linked.select("name", F.explode("elsewhere").alias("chunk")).distinct()
    parts = wanted.join(single, "chunk").groupBy("name").agg(F.collect_list(F.struct(F.col("chunk").alias("name"), F.col("chunk_body").alias("body"))).alias("parts"))
    return _read(alone.unionByName(linked.join(parts, "name")))


def round_trip(docs: DataFrame) -> DataFrame:
    """One row per document, described from the bytes read back."""
    index, chunk_store = store(docs)
    media = staged(load(chunk_store).dropDuplicates(["sha"]), "media")
    rows = index.select("k", "no_id", "sha", "n_bytes").join(media, "sha")
    return rows.select(F.when(~F.col("no_id"), F.col("k")).alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")
