"""Token files: ids in canonical length-limited Huffman codes made from global counts.

A file is a table of independent blocks. A block holds whole documents in ascending doc_id order,
their token counts, the code stream (most significant bit first) and the bit offset of every
``STEP``-th token. Decoding reads 16 bits at a time from a table and runs all checkpoints of a block in
lockstep. Code lengths are at most 16 bits, found by package-merge from the counts of all ids;
the codes follow from the lengths alone, which every block carries compressed.

Writing order: rows are range-partitioned by doc_id, so partition and block numbers are in file order.

Defined results: a null or empty text has the end id only; repeated rows are written each; a null doc_id comes first;
an empty table gives no blocks. Equal doc_ids are ordered by the checksum of their ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .minhash import slices
from .storage import staged
from .tokens import encoder

MAX_BITS = 16
#: Tokens between checkpoints, and tokens that a block holds at least before it is closed.
STEP, BLOCK = 256, 1 << 19
MAGIC = b"HTB1"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for symbols with counts above 0 (package-merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.int64)
    n = len(order)
    # A level is a sorted list of coins and packages of two of the level below; only which are packages matters later.
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate((weight, packages))
        rank = np.argsort(both, kind="stable")
        levels.append(rank >= n)
        merged = both[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for is_package in reversed(levels):
        chosen = is_package[:take]
        coins = int((~chosen).sum())
        length[:coins] += 1
        take = 2 * int(chosen.sum())
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the symbols, and for each 16-bit window the symbol and the length of the code at its head."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    first = np.cumsum(span) - span
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = first >> (MAX_BITS - lengths[order].astype(np.int64))
    symbol = np.zeros(1 << MAX_BITS, np.uint32)
    size = np.ones(1 << MAX_BITS, np.uint8)
    total = int(span.sum())
    symbol[:total] = np.repeat(order, span)
    size[:total] = np.repeat(lengths[order], span)
    return codes, symbol, size


def encode_block(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """A block of documents whose ids follow each other; ``sizes`` are their token counts."""
    n = lengths[ids].astype(np.int64)
    if not n.all():
        raise ValueError("an id without a code")
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 32 + 2, np.uint64)
    for a in range(0, len(ids), 1 << 18):
        k, at = n[a : a + (1 << 18)], (ends - n)[a : a + (1 << 18)]
        # Each code in the upper and lower half of 64 bits that start at a multiple of 32. No code is longer
        # than 16 bits, so every 32 bits hold the start of one, and codes of a word are neighbours.
        bits = codes[ids[a : a + (1 << 18)]].astype(np.uint64) << (64 - k - (at & 31)).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] += np.add.reduceat(bits >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(bits & np.uint64(0xFFFFFFFF), first)
    code = words.astype(">u4").tobytes()[: -(-total // 8)]
    marks = (ends - n)[::STEP].astype("<u8").tobytes()
    table = zlib.compress(lengths.tobytes(), 6)
    head = struct.pack("<4sIIQQ", MAGIC, len(table), len(sizes), len(ids), len(code))
    return head + table + sizes.astype("<u8").tobytes() + marks + code


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of a block."""
    magic, table, docs, n, length = struct.unpack_from("<4sIIQQ", block)
    if magic != MAGIC:
        raise ValueError("not a block")
    at = struct.calcsize("<4sIIQQ")
    lengths = np.frombuffer(zlib.decompress(block[at : at + table]), np.uint8)
    at += table
    sizes = np.frombuffer(block, "<u8", docs, at).astype(np.int64)
    at += 8 * docs
    marks = np.frombuffer(block, "<u8", -(-n // STEP), at).astype(np.int64)
    at += 8 * len(marks)
    _, symbol, size = canonical(lengths)
    raw = np.concatenate((np.frombuffer(block, np.uint8, length, at), np.zeros(4, np.uint8))).astype(np.uint32)
    word = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    out = np.zeros((len(marks), STEP), np.uint32)
    where = marks.copy()
    tail = n - (len(marks) - 1) * STEP
    for i in range(STEP if len(marks) else 0):
        lanes = len(marks) if i < tail else len(marks) - 1
        if not lanes:
            break
        p = where[:lanes]
        window = (word[p >> 3] >> (8 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[:lanes, i] = symbol[window]
        where[:lanes] = p + size[window]
    return out.ravel()[:n], sizes


def tokenised(docs: DataFrame, path: str, end: int = 2, splits: str = "word") -> DataFrame:
    """Rows of kind 'doc': (doc_id, ids, crc), ids as little-endian unsigned integers of 16 bits, or 32 where the
    vocabulary asks for it, the end id last, and crc the checksum of their 32-bit form. And a row of
    kind 'counts' from each task: ids holds the ids it has seen and how often, as 64-bit integers.
    """
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, splits)
        kind = id_type(enc.lib.get_vocab_size())
        total = np.zeros(max(enc.lib.get_vocab_size(), end + 1), np.int64)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                ids = [x + tail for x in enc.encode(texts.slice(a, b - a).to_pylist())]
                flat = np.frombuffer(b"".join(ids), "<u4")
                total += np.bincount(flat, minlength=len(total))
                ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // (4 // kind.itemsize)
                stored = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(ids), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(flat.astype(kind))]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["doc"] * (b - a)), batch.column(0).slice(a, b - a), stored, pa.array(list(map(zlib.crc32, ids)), pa.int64())],
                    names=["kind", "doc_id", "ids", "crc"],
                )
        used = np.flatnonzero(total)
        row = [["counts"], [None], [np.stack((used, total[used])).astype("<i8").tobytes()], [None]]
        types = [pa.string(), pa.int64(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=["kind", "doc_id", "ids", "crc"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "kind string, doc_id long, ids binary, crc long")


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs; as many numbers as the vocabulary has ids reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for row in batch.column("ids"):
                for i, n in np.frombuffer(row.as_buffer(), "<i8").reshape(2, -1).T.tolist():
                    total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["id", "n"])

    rows = tokens.where("kind = 'counts'").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(max(rows.column("id").to_pylist(), default=-1)) + 1, np.int64)
    out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return out


def write(tokens: DataFrame, partitions: int, vocabulary: int, limit: int = MAX_BITS) -> DataFrame:
    """Blocks (part, block, docs, n_tokens, data) of what ``tokenised`` returns, staged in the shared folder."""
    lengths = code_lengths(id_counts(tokens), limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        codes, kind = canonical(lengths)[0], id_type(vocabulary)
        docs: list = []
        ids: list = []
        held = 0

        def close() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // kind.itemsize
            data = encode_block(np.frombuffer(b"".join(ids), kind), sizes, codes, lengths)
            row = [[part], [no], [docs], [int(sizes.sum())], [data]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=["part", "block", "docs", "n_tokens", "data"])

        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc)
                ids.append(x)
                held += len(x) // kind.itemsize
                if held >= BLOCK:
                    yield close()
                    docs, ids, held, no = [], [], 0, no + 1
        if docs:
            yield close()

    dealt = tokens.where("kind = 'doc'").select("doc_id", "ids", "crc").repartitionByRange(partitions, "doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    return staged(dealt.mapInArrow(run, "part int, block int, docs array<long>, n_tokens long, data binary"), "token-files")


def read(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the blocks."""
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each partition of the files.
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = Window.partitionBy("part").orderBy("block")
    starts = blocks.select("part", "block", "n_tokens").withColumn("block_start", F.sum("n_tokens").over(within) - F.col("n_tokens"))
    placed = starts.join(base, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column("docs")[i].as_py()
                ids, sizes = decode_block(batch.column("data")[i].as_py())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("part")[i].as_py()] * n, pa.int32()), pa.array([batch.column("block")[i].as_py()] * n, pa.int32()),
                     pa.array(docs, pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=["part", "block", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    got = blocks.select("part", "block", "docs", "data").mapInArrow(run, "part int, block int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return got.join(placed, ["part", "block"]).select("doc_id", (F.col("start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, path: str, end: int = 2, partitions: int | None = None) -> DataFrame:
    """Writes all documents' ids to blocks and returns the blocks."""
    from tokenizers import Tokenizer

    tokens = staged(tokenised(docs, path, end), "token-ids", "kind")
    n = partitions or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return write(tokens, n, Tokenizer.from_file(path).get_vocab_size())
