"""Packing of tokenised documents into sequences by vector best-fit.

A bin has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths, the work of attention that stays inside each piece). Pieces are taken longest first; among
the open bins that keep every capacity, the one is chosen whose residual vector, in shares of the
capacities, has the smallest weighted norm after the piece is placed (``norm``), or the largest weighted
dot-product with the piece (``dot``). Ties go to the oldest bin.

Pieces that fill a sequence by themselves get one where they are, without a shuffle; every document has one other piece at
most. Those are dealt by a hash to groups of about ``group`` pieces, each packed by one task,
so no group grows with the number or the length of documents; at the default size less than one bin in a thousand is wasted by it.

Defined results: a null or empty text has the end id only and is one piece; repeated rows are packed each;
a null doc_id is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import slices
from .storage import staged
from .tokens import encoder

TOKENS = 1024
DOCUMENTS = 1024
ATTENTION = TOKENS * TOKENS
WEIGHTS = (1.0, 0.01, 0.01)
GROUP = 8192
#: Pieces that a worker remembers during a task, and after it; fewer than the tokenizer's own bound, as other stages may share the worker.
REMEMBERED, KEPT = 600_000, 600_000


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all of ``size``, but the first may be shorter."""
    first = n % size or size
    return [(0, min(n, first)), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, path: str, end: int = 2, size: int = TOKENS, splits: str = "byte", with_ids: bool = False, remembered: int = REMEMBERED, kept: int = KEPT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and ids (little-endian unsigned 32 bits) if asked for."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, splits, remembered)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts):
                rows = []
                for key, ids in zip(keys[a:b], enc.encode(texts.slice(a, b - a).to_pylist())):
                    ids += tail
                    for no, (start, length) in enumerate(cut(len(ids) // 4, size)):
                        part = ids[4 * start : 4 * (start + length)]
                        rows.append((key, no, start, length, zlib.crc32(part), part)[: 5 + with_ids])
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in schema.split(", ")]
                )
        enc.trim(kept)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_fit(size: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """Bin of each item; ``size`` is items x dimensions, taken in the given order, ``capacity`` one bin's."""
    w = weights / capacity**2
    # A row for each capacity, a column for each open bin, oldest first.
    left = np.zeros((len(capacity), 64))
    number = np.zeros(64, np.int64)
    open_, bins = 0, 0
    out = np.empty(len(size), np.int64)
    for i, item in enumerate(size):
        now = left[:, :open_]
        able = now[0] >= item[0]
        for d in range(1, len(capacity)):
            able &= now[d] >= item[d]
        fits = np.flatnonzero(able)
        if len(fits):
            r = now[:, fits]
            if rule == "norm":
                r = r - item[:, None]
                score = w @ (r * r)
            else:
                score = -(w * item) @ r
            at = fits[np.argmin(score)]
        else:
            if open_ == left.shape[1]:
                left, number = np.concatenate((left, np.zeros_like(left)), axis=1), np.concatenate((number, np.zeros_like(number)))
            at = open_
            left[:, at], number[at] = capacity, bins
            open_, bins = open_ + 1, bins + 1
        out[i] = number[at]
        left[:, at] -= item
        if (left[:, at] < 1).any():
            # Full: no piece has less than one token, document and unit of cost.
            left[:, at : open_ - 1], number[at : open_ - 1] = left[:, at + 1 : open_].copy(), number[at + 1 : open_].copy()
            open_ -= 1
    return out


def pack(
    parts: DataFrame,
    groups: int,
    tokens: int = TOKENS,
    documents: int = DOCUMENTS,
    attention: int = ATTENTION,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
) -> DataFrame:
    """Adds sequence_id and offset to a table with doc_id, piece and length (1 to ``tokens``)."""
    capacity = np.array([tokens, documents, attention], float)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        n = rows["length"].to_numpy(float)
        if len(n) and (n.max() > tokens or n.max() ** 2 > attention):
            raise ValueError("a piece is larger than a bin")
        bins = best_fit(np.stack((n, np.ones(len(n)), n * n), axis=1), capacity, np.array(weights), rule)
        order = np.argsort(bins, kind="stable")
        rows, bins, n = rows.iloc[order], bins[order], rows["length"].to_numpy()[order]
        ends = np.cumsum(n)
        first = np.concatenate(([True], bins[1:] != bins[:-1]))
        base = (ends - n)[first]
        offset = ends - n - np.repeat(base, np.diff(np.append(np.flatnonzero(first), len(n))))
        return rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offset).drop(columns="packing_group")

    dealt = parts.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    schema = parts.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"
    return dealt.groupBy("packing_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, end: int = 2, group: int = GROUP, remembered: int = REMEMBERED, kept: int = KEPT, **capacities) -> DataFrame:
    """Pieces of all documents with their places: one row per piece. Sequences of one full piece have negative numbers."""
    size = capacities.get("tokens", TOKENS)
    parts = staged(pieces(docs, path, end, size, remembered=remembered, kept=kept), "pieces")
    if size**2 > capacities.get("attention", ATTENTION):
        raise ValueError("a piece is larger than a bin")
    full = parts.where(F.col("length") == size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    short = parts.where(F.col("length") < size)
    return full.unionByName(pack(short, max(1, round(short.count() / group)), **capacities))
