"""Document quality by Bradley-Terry ranking of preference pairs.

A pair is a labelled good document and a labelled bad one; the model says that the good one
is preferred with probability ``sigmoid(w . (x_good - x_bad))`` and ``w`` is fitted by
regularised logistic loss on these feature differences, over all pairs of all labelled rows. Pairs are not made one by one:
a row's slope is a smooth function of its raw score, which follows from how the other label's raw scores are spread. These are summed up
in bins of 1/32 with the powers of their distances from the bin's centre, and the loss is expanded there (Taylor, order 4, off by less than 1e-10).
All sums over rows are of whole numbers, so that the model doesn't depend on how rows are dealt out. The raw score ``w . x`` is cut at the
quantile that the share of bad labels names, and mapped to 0..1 so that this cut is 0.3.

Features are of the text alone: shares of character classes and measures of repetition.

Defined results: null and empty texts have features of zero and get the score that follows; labels that are null,
of no document or of held-out documents are not learnt from, repeated ones once; of rows that share a doc_id
the text with the smallest hash is learnt from; a null doc_id is not held out; without labels of both values every score is 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import slices
from .shingles import mix, word_hashes
from .storage import discard, staged

THRESHOLD, RIDGE = 0.3, 1e-3
#: Width of the bins of raw scores, and the order of the expansion in them.
WIDTH, ORDER = 1 / 32, 4
#: Fixed point of the sums: exact up to 2**31 rows.
ONE = 2.0**32
#: Slots that raw scores are counted in, and how many different ones are looked at one by one, where the threshold is sought.
SLOTS, FEW = 65_536, 10_000

FEATURES = (
    "length", "upper", "digits", "symbols", "pipes", "exclamation", "punctuation", "spaces", "word_length",
    "same_as_previous", "distinct_words", "distinct_triples", "repeated_lines", "line_length", "symbol_ends",
)

_UPPER, _LOWER, _DIGIT, _SYMBOL, _PIPE, _BANG, _PUNCT, _SPACE, _OTHER = range(9)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = _UPPER, _LOWER, _DIGIT
for _set, _code in ((b"#$%&*+<=>@[\\]^_`{}~/", _SYMBOL), (b"|", _PIPE), (b"!", _BANG), (b"\"'(),-.:;?", _PUNCT), (b" \t\r\n", _SPACE)):
    _CLASS[list(_set)] = _code


def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Distinct values of each document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=docs)


def features(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text."""
    docs = len(texts)
    raw = [(t or "").encode("utf-8", "replace") + b"\n" for t in texts]
    size = np.fromiter(map(len, raw), np.int64, docs)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(docs), size)
    cls = _CLASS[buf]
    count = np.bincount(doc * 9 + cls, minlength=docs * 9).reshape(docs, 9).astype(float)
    count[:, _SPACE] -= 1
    chars = np.maximum(size - 1, 1)
    share = count / chars[:, None]

    ends = np.flatnonzero((cls[1:] == _SPACE) & (cls[:-1] != _SPACE))
    odd = np.isin(cls[ends], (_SYMBOL, _BANG, _PIPE))
    tokens = np.maximum(np.bincount(doc[ends], minlength=docs), 1)
    symbol_ends = np.bincount(doc[ends[odd]], minlength=docs) / tokens

    h, n = word_hashes(texts)
    wdoc = np.repeat(np.arange(docs), n)
    words = np.maximum(n, 1)
    same = np.zeros(docs)
    if len(h) > 1:
        again = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
        same = np.bincount(wdoc[1:][again], minlength=docs) / words
    distinct = _distinct(h, wdoc, docs) / words
    triples, td = np.zeros(docs), np.zeros(0, np.int64)
    if len(h) > 2:
        whole = wdoc[2:] == wdoc[:-2]
        t3 = mix(mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])[whole]
        td = wdoc[2:][whole]
        triples = _distinct(t3, td, docs) / np.maximum(np.bincount(td, minlength=docs), 1)

    brk = np.flatnonzero(buf == 10)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(buf.astype(np.uint64) + np.uint64(1)) * (np.arange(len(buf)).astype(np.uint64) * np.uint64(2) + np.uint64(1)))))
    first = np.concatenate(([0], brk[:-1] + 1))
    # A sum of byte values weighted by place, made independent of where the line starts.
    plain = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(buf.astype(np.uint64) + np.uint64(1)))))
    line = run[brk] - run[first] - (plain[brk] - plain[first]) * (first.astype(np.uint64) * np.uint64(2))
    ldoc = doc[brk]
    lines = np.bincount(ldoc, minlength=docs)
    repeated = 1 - _distinct(mix(line), ldoc, docs) / np.maximum(lines, 1)

    out = np.stack(
        (
            np.log1p(size - 1) / 10, share[:, _UPPER], share[:, _DIGIT] * 4, share[:, _SYMBOL] * 8, share[:, _PIPE] * 8,
            share[:, _BANG] * 8, share[:, _PUNCT] * 4, share[:, _SPACE], chars / words / 20, same,
            distinct, triples, repeated, np.log1p(n / np.maximum(lines, 1)) / 10, symbol_ends,
        ),
        axis=1,
    )
    out[size == 1] = 0
    return np.clip(out, 0, 1)


class BradleyTerry:
    """Weights of the features, and the line that maps raw scores to 0..1."""

    def __init__(self, w: np.ndarray, slope: float, shift: float) -> None:
        self.w, self.slope, self.shift = w, slope, shift

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.w) + self.shift, -30, 30)))


#: What passes over the labelled rows give: keys, and a row of whole numbers for each.
Sums = tuple[np.ndarray, np.ndarray]
#: A pass: sums of a function of (features, labels) over all rows.
Pass = Callable[[Callable[[np.ndarray, np.ndarray], Sums], int], Sums]


def _raw(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x . w column by column: a row's value doesn't depend on the rows beside it."""
    out = np.zeros(len(x))
    for i, v in enumerate(w):
        out += x[:, i] * v
    return out


def _summed(keys: np.ndarray, values: np.ndarray) -> Sums:
    """Sums of whole numbers for each key."""
    of, at = np.unique(keys, return_inverse=True)
    out = np.zeros((len(of), values.shape[1]), np.int64)
    np.add.at(out, at, values)
    return of, out


def _fixed(v: np.ndarray) -> np.ndarray:
    return np.rint(v * ONE).astype(np.int64)


def _bins(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bin, and its place in it from -0.5 to 0.5."""
    s = _raw(x, w) / WIDTH
    at = np.floor(s)
    return at.astype(np.int64), s - at - 0.5


def _logistic(n: int) -> list[np.ndarray]:
    """log(1 + e**t) and its derivatives up to ORDER + 1 by places of bins, at distances of 1 - n to n - 1 bins."""
    t = np.arange(1 - n, n) * WIDTH
    sig = 1 / (1 + np.exp(-np.clip(t, -700, 700)))
    out, p = [np.logaddexp(0, t)], np.polynomial.Polynomial([0, 1])
    for m in range(1, ORDER + 2):
        out.append(p(sig) * WIDTH**m)
        p = p.deriv() * np.polynomial.Polynomial([0, 1, -1])
    return out


class _Spread:
    """How raw scores of both labels are spread for weights ``w``, and what follows from it."""

    def __init__(self, over: Pass, w: np.ndarray) -> None:
        def moments(x: np.ndarray, y: np.ndarray) -> Sums:
            at, e = _bins(x, w)
            return _summed(at * 2 + y, _fixed(np.column_stack((*(e**k for k in range(ORDER + 1)), x))))

        keys, sums = over(moments, ORDER + 1 + len(w))
        bins, label = keys // 2, keys % 2
        self.w, self.low = w, int(bins.min()) if len(bins) else 0
        self.n = int(bins.max()) + 1 - self.low if len(bins) else 1
        spread = np.zeros((2, self.n, sums.shape[1]))
        spread[label, bins - self.low] = sums / ONE
        self.by_bin = spread[:, :, ORDER + 1 :]
        self.rows, self.totals = spread[:, :, 0].sum(axis=1), self.by_bin.sum(axis=1)
        self.curves = _logistic(self.n)
        self.moments = [[spread[label, :, k] / math.factorial(k) for k in range(ORDER + 1)] for label in (0, 1)]

    def _all(self, m: int, label: int, values: np.ndarray) -> np.ndarray:
        """For each bin of the other label, the sum of the m-th curve at (bad bin - good bin) times the values of ``label``."""
        curve = self.curves[m]
        return np.convolve(values, curve if label else curve[::-1], "valid")

    def _expanded(self, label: int, m: int) -> list[np.ndarray]:
        """Coefficients, by bin, of the sum of the m-th curve over ``label`` as a polynomial in the other row's place."""
        here, there = (-1, 1) if label else (1, -1)
        return [
            sum(here**k * self._all(m + k + q, label, self.moments[label][k]) for k in range(ORDER + 1 - q)) * there**q / math.factorial(q) for q in range(ORDER + 1)
        ]

    def loss(self, ridge: float) -> float:
        """Mean loss of all pairs."""
        by_good = self._expanded(0, 0)
        total = sum((c * self.moments[1][q] * math.factorial(q)).sum() for q, c in enumerate(by_good))
        return total / self.rows.prod() + ridge / 2 * (self.w @ self.w)

    def step(self, over: Pass, ridge: float) -> np.ndarray:
        """Newton's step. The slope is that of all pairs; the curvature is taken at the bins' centres, which leaves it positive."""
        w, low, k = self.w, self.low, len(self.w)
        # Of a row with label 0, slopes come from rows with label 1.
        slope = np.array([np.column_stack(self._expanded(1 - label, 1)) / self.rows[1 - label] for label in (0, 1)])
        bend = np.array([self._all(2, 1 - label, self.moments[1 - label][0]) / WIDTH / WIDTH / self.rows[1 - label] for label in (0, 1)])

        def sums(x: np.ndarray, y: np.ndarray) -> Sums:
            at, e = _bins(x, w)
            at = at - low
            c = slope[y, at]
            a = c[:, -1]
            for q in range(ORDER - 1, -1, -1):
                a = a * e + c[:, q]
            bent = x * bend[y, at][:, None]
            keys, values = [y * (k + 1)], [_fixed(x * (a / WIDTH)[:, None])]
            for i in range(k):
                keys.append(y * (k + 1) + 1 + i)
                values.append(_fixed(bent * x[:, i : i + 1]))
            return _summed(np.concatenate(keys), np.concatenate(values))

        keys, got = over(sums, k)
        made = np.zeros((2 * (k + 1), k))
        made[keys] = got / ONE
        bad, good = made.reshape(2, k + 1, k) / self.rows[:, None, None]
        crossed = np.column_stack([self._all(2, 0, self.by_bin[0, :, i]) for i in range(k)]) / WIDTH / WIDTH
        cross = self.by_bin[1].T @ crossed / self.rows.prod()
        grad = bad[0] - good[0] + ridge * w
        return np.linalg.solve(bad[1:] + good[1:] - cross - cross.T + ridge * np.eye(k), grad)


def _nth(over: Pass, w: np.ndarray, least: float, most: float, ranks: tuple[int, ...]) -> list[float]:
    """The raw scores, from ``least`` to ``most``, of these ranks (from 0) of all rows, exactly: counts in ever narrower slots, then the few scores of the last one."""
    seen: dict = {}

    def inside(x: np.ndarray, path: tuple) -> np.ndarray:
        s = _raw(x, w)
        for low, width, slot in path:
            s = s[np.clip(np.floor((s - low) / width), 0, SLOTS - 1) == slot]
        return s

    def counts(path: tuple, low: float, width: float) -> Sums:
        def slots(x: np.ndarray, y: np.ndarray) -> Sums:
            at = np.clip(np.floor((inside(x, path) - low) / width), 0, SLOTS - 1).astype(np.int64)
            return _summed(at, np.ones((len(at), 1), np.int64))

        return over(slots, 1)

    def values(path: tuple) -> Sums:
        def bits(x: np.ndarray, y: np.ndarray) -> Sums:
            s = inside(x, path) + 0.0
            return _summed(s.view(np.int64), np.ones((len(s), 1), np.int64))

        return over(bits, 1)

    def found(rank: int) -> float:
        path, low, high = (), least, most
        while True:
            width = max((high - low) / SLOTS, 1e-300)
            if path not in seen:
                seen[path] = counts(path, low, width)
            keys, n = seen[path]
            order = np.argsort(keys)
            keys, n = keys[order], n[order, 0]
            at = int(np.searchsorted(np.cumsum(n), rank, side="right"))
            rank -= int(n[:at].sum())
            path += ((low, width, int(keys[at])),)
            low, high = low + width * float(keys[at]), low + width * float(keys[at] + 1)
            # Five times narrower by SLOTS, those left are equal but for rounding.
            if n[at] <= FEW or len(path) == 5:
                break
        last = (*path, "values")
        if last not in seen:
            seen[last] = values(path)
        bits, n = seen[last]
        raw = bits.view(np.float64)
        order = np.argsort(raw)
        return float(raw[order][np.searchsorted(np.cumsum(n[order, 0]), rank, side="right")])

    return [found(r) for r in ranks]


def _fitted(over: Pass, k: int, threshold: float, ridge: float) -> BradleyTerry:
    """The model of all pairs of the rows that ``over`` passes over, by Newton's method with steps halved until the loss falls."""
    at = _Spread(over, np.zeros(k))
    if not at.rows.all():
        return BradleyTerry(np.zeros(k), 0.0, 0.0)
    # Beyond it the ridge alone costs more than no weights at all.
    most = math.sqrt(2 * math.log(2) * k / ridge)
    for _ in range(50):
        step = at.step(over, ridge)
        while np.abs(step).max() >= 1e-7:
            new = at.w - step
            if np.abs(new).sum() <= most:
                after = _Spread(over, new)
                if after.loss(ridge) <= at.loss(ridge) + 1e-9:
                    at = after
                    break
            step = step / 2
        else:
            break
    ranked = lambda ranks: _nth(over, at.w, at.low * WIDTH, (at.low + at.n) * WIDTH, ranks)
    return _scaled(at.w, at.totals[1] / at.rows[1], at.totals[0] / at.rows[0], _cut(ranked, int(at.rows[0]), int(at.rows.sum())), threshold)


def _cut(ranked: Callable[[tuple[int, ...]], list[float]], bad: int, n: int) -> float:
    """The raw score between as many as are labelled bad and the rest."""
    cut = min(bad, n - 1)
    return sum(ranked((cut - 1, cut))) / 2


def _scaled(w: np.ndarray, good: np.ndarray, bad: np.ndarray, at: float, threshold: float) -> BradleyTerry:
    slope = 4 / max(abs((good - bad) @ w), 1e-9)
    return BradleyTerry(w, slope, np.log(threshold / (1 - threshold)) - slope * at)


def fit(x: np.ndarray, y: np.ndarray, pairs: int | None = None, threshold: float = THRESHOLD, ridge: float = RIDGE) -> BradleyTerry:
    """Fits all pairs of rows with label 1 over rows with label 0, or ``pairs`` drawn ones, by Newton's method."""
    y = np.asarray(y, np.int64)
    if pairs is None:
        return _fitted(lambda f, _: f(x, y), x.shape[1], threshold, ridge)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return BradleyTerry(np.zeros(x.shape[1]), 0.0, 0.0)
    rng = np.random.default_rng(8)
    d = x[good[rng.integers(len(good), size=pairs)]] - x[bad[rng.integers(len(bad), size=pairs)]]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / pairs + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    raw = np.sort(_raw(x, w))
    return _scaled(w, x[good].mean(axis=0), x[bad].mean(axis=0), _cut(lambda ranks: [raw[r] for r in ranks], len(bad), len(raw)), threshold)


def _with_features(docs: DataFrame, schema: str, make) -> DataFrame:
    """``docs`` with features in place of their text, as ``make`` lays them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            rest = batch.select([c for c in batch.schema.names if c != "text"])
            for a, b in slices(texts):
                yield make(rest.slice(a, b - a), features(texts.slice(a, b - a).to_pylist()))

    return docs.mapInArrow(run, schema)


def held_out() -> F.Column:
    """Whether a document is kept from training; one without doc_id has no label and is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _over(rows: DataFrame) -> Pass:
    """Passes over a written table of (label, x): sums are made in each partition, then by key."""

    def over(f: Callable[[np.ndarray, np.ndarray], Sums], width: int) -> Sums:
        names = ["key", *(f"c{i}" for i in range(width))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, sums = np.zeros(0, np.int64), np.zeros((0, width), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    more, values = f(x, batch.column("label").to_numpy().astype(np.int64))
                    keys, sums = _summed(np.concatenate((keys, more)), np.concatenate((sums, values)))
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c) for c in sums.T)], names=names)

        made = rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))
        got = made.groupBy("key").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()
        order = np.argsort(got.column("key").to_numpy())
        return got.column("key").to_numpy()[order], np.column_stack([got.column(c).to_numpy() for c in names[1:]])[order]

    return over


def train(docs: DataFrame, labels: DataFrame) -> BradleyTerry:
    """Fits on all labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out()).distinct()
    text = F.col("text").cast("string")
    # Features are made before the join, so that texts stay where they are.
    src = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text")).where(F.col("doc_id").isNotNull() & ~held_out())

    def make(rest: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*rest.columns, lists], names=["doc_id", "h", "x"])

    made = _with_features(src, "doc_id long, h long, x array<double>", make)
    one = made.groupBy("doc_id").agg(F.min(F.struct("h", "x")).alias("m"))
    rows = staged(one.join(known, "doc_id").select("label", "m.x"), "labelled-features")
    model = _fitted(_over(rows), len(FEATURES), THRESHOLD, RIDGE)
    discard(rows)
    return model


def score(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """(doc_id, score) of every document."""

    def make(rest: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rest.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _with_features(src, "doc_id long, score double", make)


def keep_good(docs: DataFrame, model: BradleyTerry, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of the threshold or more, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                good = model.score(features(texts.slice(a, b - a).to_pylist())) >= threshold
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
