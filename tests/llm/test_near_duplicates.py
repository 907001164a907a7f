import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import embeddings, minhash
from sparkloom.llm.components import connected_components
from sparkloom.llm.queries import op6_embedding_near_dedup, op7_minhash_near_dedup
from sparkloom.llm.shingles import weighted_shingles

from .conftest import DOCS, SF


def union(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    for n, m in ((0, 0), (200, 190), (200, 400)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040) if n]
        got = {r.node: r.component for r in connected_components(spark.createDataFrame([*links, (None, 5), (7, 7)], "a long, b long")).collect()}
        want = union({x for e in links for x in e}, links)
        assert {k: v for k, v in want.items() if got.get(k, k) != v} == {}
        assert all(want[k] == v for k, v in got.items())


def shingle_counter(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similarity(x, y):
    if not x or not y:
        return 0.0
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x | y) for d in x & y)


def brute(texts):
    sets = {k: shingle_counter(t) for k, t in texts.items()}
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) * 5 > 3 * len(sets[a]) / 2 and similarity(sets[a], sets[b]) >= 0.8 - 1e-9]
    return union(keys, links), links


def test_shingles_are_counted():
    texts = ["a b c d e f a b c d e", "x", "", None, "É, è-b c's d\ne", "a b c d e " * 4, "日本 語 a b c d"]
    h, w, doc = weighted_shingles(texts)
    for i, t in enumerate(texts):
        assert sorted(w[doc == i]) == sorted(shingle_counter(t).values())
        assert len(set(h[doc == i])) == (doc == i).sum()


def test_probability_jaccard():
    rng = random.Random(2)
    for _ in range(200):
        x, y = (Counter(rng.choices(range(12), k=rng.randint(1, 30))) for _ in range(2))
        a, b = ((np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for c in (x, y))
        assert minhash.probability_jaccard(*a, *b) == pytest.approx(similarity(x, y))


def test_registers_estimate_the_similarity():
    rng, m = random.Random(6), 4096
    for _ in range(6):
        x = Counter(rng.choices(range(200), k=500))
        y = x.copy()
        y.update(rng.choices(range(150, 260), k=120))
        both = [c for c in (x, y)]
        h = np.concatenate([np.array(sorted(c), np.uint64) for c in both])
        w = np.concatenate([np.array([c[k] for k in sorted(c)]) for c in both])
        regs = minhash.probminhash(h, w, np.repeat([0, 1], [len(x), len(y)]), 2, m) & np.uint64(0xFFFFFFFF)
        assert (regs[0] == regs[1]).mean() == pytest.approx(similarity(x, y), abs=0.04)


def changed(words, n, rng):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("small", [12, 1])
def test_against_brute_force(spark, monkeypatch, small):
    """With ``small`` at 1, all mixed buckets are compared in blocks."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(1)
    texts = {}
    for f in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(40, 160))]
        for _ in range(rng.randint(1, 9)):
            texts[len(texts) + 100] = changed(base, rng.randint(0, 4), rng)
    base = [f"v{rng.randrange(400)}" for _ in range(90)] + ["la"] * 20
    for _ in range(60):
        texts[len(texts) + 100] = changed(base, rng.randint(1, 5), rng)
    texts |= {1: "tiny text", 2: "Tiny, text", 3: "", 4: None, 5: "la " * 50, 6: "la " * 60}
    rows = [(k, t, "en", "s", 0) for k, t in texts.items()]
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    want, _ = brute(texts)
    assert {k: r.group_id for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.group_id) for r in got.values())


def test_chain_in_one_bucket(spark):
    """Neighbours of a long chain are similar, its ends are not; all must meet through the chain."""
    rng = random.Random(9)
    words = [f"c{i}" for i in range(120)]
    texts = {}
    for i in range(40):
        texts[i] = " ".join(words)
        words[(i * 7) % 120] = f"n{i}"
    rows = [(k, t, "en", "s", 0) for k, t in texts.items()]
    rng.shuffle(rows)
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute(texts)[0]


def rows_by_brute_force(rows):
    """Group and kept row of each row, rows that share a doc_id being documents of their own."""
    texts = {i: r[1] for i, r in enumerate(rows) if r[0] is not None}
    group = brute(texts)[0]
    first = {}
    for i in group:
        first[group[i]] = min(first.get(group[i], i), i, key=lambda n: (rows[n][0], n))
    return {i: rows[first[group[i]]][0] for i in group}, [first[g] for g in first]


def test_rows_that_share_a_doc_id(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(f"{x}{rng.randrange(300)}" for _ in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (1, a), (7, c), (7, c), (7, c), (8, ""), (8, ""), (9, None), (None, a), (4, "short"), (4, c + " end")]
    docs = spark.createDataFrame([(k, t, f"l{i}", "s", i) for i, (k, t) in enumerate(rows)], DOCS).repartition(3)
    group, kept = rows_by_brute_force(rows)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.group_id) for r in got) == Counter((rows[i][0], group[i]) for i in group) + Counter({(None, None): 1})
    # Rows 1 and 2 hold text a, 2 and 3 text b, 7 and 4 text c; of each one row stays, and all rows without words or doc_id.
    want = Counter(rows[i] for i in kept) + Counter({(None, a): 1})
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns and left.schema == docs.schema
    near = lambda t: {a: "a", b: "b", b + " more": "b", c: "c", c + " end": "c"}.get(t, t)
    assert Counter(near(r.text) for r in left.collect()) == Counter(near(t) for _, t in want.elements())
    assert len([r for r in got if r.kept]) == sum(want.values())


def test_deduplicated_keeps_one_row_of_each_group(spark):
    rng = random.Random(21)
    bases = [[f"w{rng.randrange(500)}" for _ in range(50)] for _ in range(15)]
    rows = [(rng.randrange(30), changed(rng.choice(bases), rng.choice([0, 0, 1, 12]), rng)) for _ in range(90)]
    rows += rng.choices(rows, k=20)
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS).repartition(4)
    texts = dict(enumerate(t for _, t in rows))
    group = brute(texts)[0]
    left = [r.text for r in minhash.deduplicated(docs).collect()]
    by_text = {t: group[i] for i, t in texts.items()}
    assert sorted(by_text[t] for t in left) == sorted(set(group.values()))


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    """Blocks by their bytes give what blocks by their rows give."""
    monkeypatch.setattr(minhash, "SMALL", 1)
    monkeypatch.setattr(minhash, "BYTES", 3_000)
    rng = random.Random(5)
    base = [f"v{rng.randrange(400)}" for _ in range(90)]
    texts = {i: changed(base, rng.randint(1, 4), rng) for i in range(40)}
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], DOCS)).collect()}
    assert got == brute(texts)[0]


def test_sample_tables(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.group_id for r in op7_minhash_near_dedup(spark, SF).collect()}
    assert got == brute(texts)[0]


def test_minhash_awkward_rows(docs, awkward, none):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(awkward)
    by = {r.doc_id: r.group_id for r in got}
    assert by[5] == 4 and by[7] == 6 and all(by[k] == k for k in (0, 1, 2, 3, 9, 10)) and by[None] is None
    assert all(r.kept for r in got if r.doc_id in (0, 1, None))
    assert minhash.near_duplicates(none).count() == 0


def cosine_links(rows, threshold):
    def unit(v):
        if v is None or any(x is None for x in v):
            return None
        v = np.array(v, np.float64)
        ok = len(v) and np.isfinite(v).all() and np.linalg.norm(v) > 0
        return v / np.linalg.norm(v) if ok else None

    units = [unit(v) if label is not None else None for _, v, label in rows]
    links = []
    for i, x in enumerate(units):
        for j in range(i):
            y = units[j]
            if x is not None and y is not None and len(x) == len(y) and rows[i][2] == rows[j][2] and x @ y >= threshold:
                links.append((j, i))
    return links


def compare_vectors(got, rows, threshold=0.98):
    links = cosine_links(rows, threshold)
    n = Counter(x for e in links for x in e)
    top = union([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {r[0]: (n[i], top[r[0]], top[r[0]] == r[0]) for i, r in enumerate(rows)}


def test_vectors_of_the_sample(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare_vectors(op6_embedding_near_dedup(spark, SF).collect(), rows)


@pytest.mark.parametrize("tile", [7, 4096])
def test_vectors_awkward(spark, tile):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(8):
        centre = rng.normal(size=16)
        for _ in range(12):
            rows.append((len(rows), (centre + rng.normal(size=16) * rng.choice([0, 0.05, 0.12])).astype(np.float32).tolist(), c % 3))
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * 16, [nan] * 16, [inf, *[1.0] * 15], [None, *[1.0] * 15]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(bad)] + [(2000, rows[0][1], None), (2001, rows[0][1], None), (2002, [1.0, 2.0], 1), (2003, [2.0, 4.0], 1)]
    rows += [(3000 + i, [2 * x for x in rows[0][1]], rows[0][2]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    compare_vectors(embeddings.near_duplicates(df, tile=tile).collect(), rows)


def test_vectors_that_share_an_id(spark):
    """Each row has its own links, also where vec_id is repeated with other vectors."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [0.0, 2.0], 0), (5, [-1.0, 0.0], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True)]


def test_vectors_of_extreme_size(spark):
    rows = [(0, [1e200, 0.0], 0), (1, [1e200, 1e190], 0), (2, [2e-200, 0.0], 0), (3, [1e-200, 0.0], 0), (4, [5e-324, 0.0], 0), (5, [0.0, 1e308], 0), (6, [1.0, 1e308], 0), (7, [-1e200, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 64)) * rng.lognormal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, a, d = embeddings.quantise(x)
    near = (q * s[:, None]) @ (q * s[:, None]).T
    assert (np.abs(x @ x.T - near) <= d[:, None] + a[:, None] * d[None, :] + 1e-12).all()
