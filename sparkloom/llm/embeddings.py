"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors are scaled to length one and quantised once to int8 with a scale of their own. For
x = a + d, a being the quantised vector and d the rest, the cosine of x and y differs from
the product of their quantised vectors by at most |d_x| * |y| + |a_x| * |d_y|; both norms are
kept with each vector. Tiles of one label are multiplied pairwise on the int8 codes
(in float32, whose sums are exact for up to 1,040 dimensions), and only codes and norms are sent to a tile product.
It names the vectors with a pair whose upper bound reaches the threshold; these alone are joined with
full precision, and their possible pairs computed again in double precision.

Equal vectors of a label are one class and go through the tiles once. A tile product returns counts of
links for each class and a spanning forest of its links, not the links themselves.

Defined results: a null label, a null or empty vector, a null, NaN or infinite component or a zero vector links
with nothing; vectors of different lengths do not link; components of any finite size count, as vectors are scaled by a
power of two before their norms are taken; every input row is returned, and rows that share a vec_id are
vectors of their own, each with its own links; a null vec_id is returned without links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, staged

THRESHOLD = 0.98
#: Vectors of a tile (of 64 dimensions; of more, fewer), and of the blocks that a tile product is computed in.
TILE, BLOCK = 16384, 1024
#: float32 sums of int8 products stay exact up to this many dimensions.
EXACT = 1040
#: Vectors that are quantised at a time.
SLICE = 4096


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the largest component is between 1/2 and 1; cosines stay what they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> int8 codes, scales, and bounds for the norms of codes * scale and of the rest."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None])
    near = q * scale[:, None]
    slack = 1e-9
    return q.astype(np.int8), scale, np.linalg.norm(near, axis=1) + slack, np.linalg.norm(x - near, axis=1) + slack


class Codes:
    """Quantised vectors: int8 codes, scales and bounds."""

    def __init__(self, q: np.ndarray, scale: np.ndarray, near: np.ndarray, rest: np.ndarray) -> None:
        self.q, self.scale, self.near, self.rest = q, scale, near, rest

    @classmethod
    def read(cls, rows: pd.DataFrame) -> Codes:
        q = np.frombuffer(b"".join(rows["code"]), np.int8).reshape(len(rows), -1)
        return cls(q, *(rows[c].to_numpy() for c in ("scale", "near", "rest")))


def possible_pairs(x: Codes, y: Codes, threshold: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), in blocks, of rows whose cosine may reach the threshold; i < j if ``same``."""
    kind = np.float32 if x.q.shape[1] <= EXACT else np.float64
    for i in range(0, len(x.q), BLOCK):
        left = x.q[i : i + BLOCK].astype(kind)
        for j in range(i if same else 0, len(y.q), BLOCK):
            dot = (left @ y.q[j : j + BLOCK].astype(kind).T).astype(np.float64)
            upper = dot * x.scale[i : i + BLOCK, None] * y.scale[None, j : j + BLOCK]
            upper += x.rest[i : i + BLOCK, None] * (1 + 1e-9) + x.near[i : i + BLOCK, None] * y.rest[None, j : j + BLOCK]
            a, b = np.nonzero(upper >= threshold)
            a, b = a + i, b + j
            if same:
                a, b = a[a < b], b[a < b]
            for s in range(0, len(a), 65536):
                yield a[s : s + 65536], b[s : s + 65536]


def close_pairs(x: np.ndarray, y: np.ndarray, cx: Codes, cy: Codes, threshold: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of ``possible_pairs`` whose cosine is at least the threshold."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    for p, q in possible_pairs(cx, cy, threshold, same):
        cos = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q])
        yield p[cos >= threshold], q[cos >= threshold]


class _Forest:
    """Disjoint sets over 0..n-1; join() returns the links that joined two sets."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        up, out = self.up, []
        while True:
            while True:
                top = up[up]
                if (top == up).all():
                    break
                up[:] = top
            ra, rb = up[a], up[b]
            go = ra != rb
            if not go.any():
                return out
            a, b, ra, rb = a[go], b[go], ra[go], rb[go]
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            _, first = np.unique(hi, return_index=True)
            up[hi[first]] = lo[first]
            out += list(zip(a[first].tolist(), b[first].tolist()))


def _coded(reps: DataFrame) -> DataFrame:
    """Adds code, scale, near and rest to (label, dim, node, size, x), and scales x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE):
                batch = whole.slice(s, SLICE)
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    x = scaled(part.column("x").flatten().to_numpy().reshape(-1, dim))
                    q, *bounds = quantise(x / np.linalg.norm(x, axis=1)[:, None])
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), int(dim)).cast(pa.list_(pa.float64()))
                    code = pa.array([r.tobytes() for r in q], pa.binary())
                    keep = [part.column(c) for c in ("label", "dim", "node", "size")]
                    yield pa.RecordBatch.from_arrays(
                        [*keep, lists, code, *map(pa.array, bounds)], names=["label", "dim", "node", "size", "x", "code", "scale", "near", "rest"]
                    )

    return reps.mapInArrow(run, "label string, dim int, node long, size long, x array<double>, code binary, scale double, near double, rest double")


def _sides(key: tuple, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    i, j = key[2], key[3]
    return rows[rows.tile == i], rows[rows.tile == j], i == j


def _candidates(threshold: float):
    """Vectors of a pair of tiles that have a possible pair in it, from codes alone."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(key, rows)
        may = [np.zeros(len(left), bool), np.zeros(len(right), bool)]
        if len(left) and len(right):
            x = Codes.read(left)
            for a, b in possible_pairs(x, x if same else Codes.read(right), threshold, same):
                may[0][a] = True
                may[0 if same else 1][b] = True
        found = left[may[0]] if same else pd.concat((left[may[0]], right[may[1]]))
        return pd.DataFrame({"label": str(key[0]), "dim": int(key[1]), "i": int(key[2]), "j": int(key[3]), "tile": found.tile, "node": found.node})

    return run


def _links(threshold: float):
    """Counts of links and a forest of them, from the candidates of a pair of tiles."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(key, rows)
        out = [np.zeros((0, 3), np.int64)]
        if len(left) and len(right):
            x, cx = np.stack(left.x.to_numpy()), Codes.read(left)
            y, cy = (x, cx) if same else (np.stack(right.x.to_numpy()), Codes.read(right))
            rx, ry, sx, sy = left.node.to_numpy(), right.node.to_numpy(), left["size"].to_numpy(), right["size"].to_numpy()
            nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
            shift = 0 if same else len(x)
            forest, kept = _Forest(shift + len(y)), []
            for a, b in close_pairs(x, y, cx, cy, threshold, same):
                np.add.at(nx, a, sy[b])
                np.add.at(nx if same else ny, b, sx[a])
                kept += forest.join(a, b + shift)
            node = rx if same else np.concatenate((rx, ry))
            n = nx if same else np.concatenate((nx, ny))
            have = np.flatnonzero(n)
            out.append(np.stack((node[have], np.full(len(have), -1), n[have]), axis=1))
            if kept:
                e = np.array(kept)
                out.append(np.stack((node[e[:, 0]], node[e[:, 1]], np.zeros(len(e), np.int64)), axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> one row per vector: (vec_id, n_links, component_id, kept)."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(F.size(x) > 0, F.lit(False))
        & F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    )
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        x.alias("x"),
        good.alias("good"),
    ).withColumn("k1", F.when(F.col("good"), F.xxhash64("label", "x"))).withColumn("k2", F.when(F.col("good"), F.xxhash64(F.lit(7), "x", "label")))
    # Numbers that are written stand for the rows from here on.
    rows = staged(rows.withColumn("no", F.monotonically_increasing_id()), "vectors")
    size = rows.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.min("no").alias("node"), F.count("*").alias("size"))
    size = staged(size, "classes")
    reps = rows.where("good").join(size, ["k1", "k2"]).where("no = node").select("label", F.size("x").alias("dim"), "node", "size", "x")
    coded = staged(_coded(reps), "codes")
    # At most so many bytes of codes in a tile, whatever the number of dimensions.
    most = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(64 * tile) / F.col("dim"))))
    tiles = staged(coded.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / most).cast("int").alias("tiles")), "tiles")
    codes = coded.select("label", "dim", "node", "code", "scale", "near", "rest").join(tiles, ["label", "dim"])
    paired = codes.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    paired = paired.select(
        "label", "dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "code", "scale", "near", "rest"
    )
    by = ["label", "dim", "i", "j"]
    may = staged(paired.groupBy(by).applyInPandas(_candidates(threshold), "label string, dim int, i int, j int, tile int, node long"), "candidates")
    full = may.join(coded.drop("label", "dim"), "node")
    found = staged(full.groupBy(by).applyInPandas(_links(threshold), "a long, b long, n long"), "tileproducts")
    comp = connected_components(found.where("b >= 0").select("a", "b"))
    linked = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    names = comp.join(size.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = comp.join(staged(names, "component-names"), "component").select("node", "component_id")
    per_class = (
        size.join(linked, "node", "left")
        .join(named, "node", "left")
        .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    per_class = staged(per_class, "linked")
    for spent in (coded, may, found, comp):
        discard(spent)
    return rows.select("vec_id", "k1", "k2").join(per_class, ["k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
