import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import pii, quality
from sparkloom.llm.queries import op8_quality_classifier, op10_pii

from .conftest import DOCS, SF

S1 = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op8_quality_classifier(spark, S1)
    assert got.count() == spark.read.parquet(f"{S1}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{S1}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert np.mean([(a > s[y == 0]).mean() + (a == s[y == 0]).mean() / 2 for a in s[y == 1]]) > 0.99
    assert ((s >= 0.3) == (y == 1)).mean() > 0.98


def test_quality_awkward_rows(spark, docs, awkward, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(11)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(awkward) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.where("quality = 1"))).collect()} == {0.5}
    assert quality.score(none, model).count() == 0 and quality.train(none, labels).score(np.zeros((1, len(quality.FEATURES)))) == 0.5
    extra = docs.withColumn("label", F.lit("x")).withColumn("score", F.lit(1))
    assert quality.keep_good(extra, model).columns == extra.columns


def test_pairs_rank_good_over_bad():
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    y = (x[:, 0] > 0.25).astype(int)
    model = quality.fit(x, y)
    s = model.score(x)
    assert ((s >= 0.3) == (y == 1)).mean() > 0.97


def slow_features(text):
    """FEATURES of one text, from bytes, words and lines in plain Python."""
    raw = text.encode()
    if not raw:
        return [0.0] * 15
    n = len(raw)
    share = lambda signs: sum(b in signs for b in raw) / n
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())
    count = max(len(words), 1)
    triples = list(zip(words, words[1:], words[2:]))
    tokens = [t for t in re.split(rb"[ \t\r\n]", raw) if t]
    lines = raw.split(b"\n")
    symbols = b"#$%&*+<=>@[\\]^_`{}~/"
    out = [
        math.log1p(n) / 10, share(bytes(range(65, 91))), share(b"0123456789") * 4, share(symbols) * 8, share(b"|") * 8, share(b"!") * 8, share(b"\"'(),-.:;?") * 4, share(b" \t\r\n"), n / count / 20,
        sum(a == b for a, b in zip(words, words[1:])) / count, len(set(words)) / count, len(set(triples)) / max(len(triples), 1), 1 - len(set(lines)) / len(lines), math.log1p(len(words) / len(lines)) / 10,
        sum(t[-1] in symbols + b"!|" for t in tokens) / max(len(tokens), 1),
    ]
    return [min(max(v, 0.0), 1.0) for v in out]


def test_features_against_a_slow_version(spark):
    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["".join(rng.choice(["a ", "b", "AB", "1", "|", "! ", "é", ".", "\n", "x x x", "# ", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "\n", " "]
    got = quality.features(texts)
    for row, text in zip(got, texts):
        assert row.tolist() == pytest.approx(slow_features(text)), repr(text)


def test_fit_is_where_the_loss_is_least():
    """The slope of the pairwise loss, pair by pair, is nought at the fitted weights; the threshold cuts off as many as are labelled bad."""
    rng = np.random.default_rng(4)
    x, ridge, pairs = rng.random((60, 5)), 1e-3, 400
    y = (x[:, 0] + 0.3 * x[:, 2] + 0.2 * rng.normal(size=60) > 0.6).astype(int)
    model = quality.fit(x, y, pairs=pairs, ridge=ridge)
    draw, good, bad = np.random.default_rng(8), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    chosen = list(zip(good[draw.integers(len(good), size=pairs)], bad[draw.integers(len(bad), size=pairs)]))
    slope = [ridge * w for w in model.w]
    for g, b in chosen:
        z = sum(model.w[i] * (x[g][i] - x[b][i]) for i in range(5))
        for i in range(5):
            slope[i] -= (x[g][i] - x[b][i]) / (1 + math.exp(z)) / pairs
    assert max(map(abs, slope)) < 1e-6
    assert (model.score(x) < quality.THRESHOLD).sum() == len(bad)


def test_fit_is_of_all_pairs():
    """The slope of the loss over every good row with every bad one is nought."""
    rng = np.random.default_rng(6)
    x, ridge = rng.random((500, 5)), 1e-3
    for noise in (0.0, 0.2):
        y = (x[:, 0] + 0.3 * x[:, 2] + noise * rng.normal(size=500) > 0.6).astype(int)
        model = quality.fit(x, y, ridge=ridge)
        d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, 5)
        slope = ridge * model.w - (d / (1 + np.exp(d @ model.w))[:, None]).mean(axis=0)
        assert np.abs(slope).max() < 1e-8
        assert (model.score(x) < quality.THRESHOLD).sum() == (y == 0).sum()


def test_scores_of_a_rank_are_exact(monkeypatch):
    monkeypatch.setattr(quality, "FEW", 3)
    rng = np.random.default_rng(7)
    w = np.array([2.0, -1.0])
    for x in (rng.random((900, 2)), np.zeros((900, 2)), np.repeat(rng.random((9, 2)), 100, axis=0), rng.random((900, 2)) * 1e-9):
        raw = np.sort(quality._raw(x, w))
        ranks = (0, 1, 99, 100, 450, 898, 899)
        assert quality._nth(lambda f, _: f(x, np.zeros(900, np.int64)), w, -1.0, 2.0, ranks) == [raw[r] for r in ranks]


def test_every_labelled_row_is_learnt_from(spark):
    """More rows than the 20,000 that were learnt from before; the cut is that of all of them."""
    n = 30_000
    text = F.when(F.col("doc_id") % 7 < 3, F.concat(F.lit("Good words, "), F.repeat(F.lit("and more "), (F.col("doc_id") % 11).cast("int")), F.col("doc_id"))).otherwise(
        F.concat(F.lit("bad | words !! "), F.repeat(F.lit("x 1 "), (F.col("doc_id") % 13).cast("int")), F.col("doc_id"))
    )
    docs = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", text)
    labels = docs.select("doc_id", ((F.col("doc_id") % 7 < 3) != (F.col("doc_id") % 97 == 0)).cast("int").alias("quality"))
    model = quality.train(docs, labels)
    rows = docs.join(labels, "doc_id").where(~quality.held_out()).collect()
    assert len(rows) > 20_000
    y, x = np.array([r.quality for r in rows]), quality.features([r.text for r in rows])
    assert model.w.tolist() == quality.fit(x, y).w.tolist()
    raw = np.sort(quality._raw(x, model.w))
    cut = (y == 0).sum()
    assert model.slope * (raw[cut - 1] + raw[cut]) / 2 + model.shift == pytest.approx(math.log(0.3 / 0.7))


def test_rows_that_share_a_doc_id_are_learnt_once(spark):
    texts = ["good words of a text. " * 9, "bad | bad | !! bad"]
    rows = [(i, texts[i % 2], "", "", 0) for i in range(40)] + [(None, "x", "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    one = quality.train(docs, labels)
    more = quality.train(docs.unionByName(docs).repartition(5), labels.unionByName(labels))
    assert one.w.tolist() == more.w.tolist() and one.shift == more.shift
    assert docs.select(quality.held_out().alias("h")).where("h is null").count() == 0


def test_repeated_lines_are_seen():
    x = quality.features(["a b\nc d\na b\na b", "a b\nc d", "", None])
    assert x[0, quality.FEATURES.index("repeated_lines")] == 0.5 and x[1, quality.FEATURES.index("repeated_lines")] == 0
    assert (x[2:] == 0).all()


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    out = []
    for no, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), no, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def compare(rows, texts):
    for r in rows:
        spans = base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest(), texts[r.doc_id]
        assert set(joined(spans).split(",")) - {""} <= set(r.spans.split(","))


@pytest.mark.parametrize("sf", [SF, S1])
def test_base_spans_of_the_sample(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_pii(spark, sf).collect()
    assert len(got) == len(texts)
    compare(got, texts)


def test_base_spans_of_random_texts(spark):
    rng = random.Random(8)
    bits = ["a", "b.c", "@", ".", "x-y", "_", "%", "+", "+1", "4111111111111111", "4111 1111 1111 1111", "1", "23", "255", "256", "007", "-", " ", "(", ")", "é", "🙂", "\n", "192.168.0.1", "me@x.org", "000"]
    texts = {i: "".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for i in range(4000)}
    texts |= {5000: "1" * 50_000, 5001: "a" * 50_000 + "@" + "b." * 20_000, 5002: "1.2." * 20_000, 5003: "+1" + " 2" * 30_000, 5004: None, 5005: ""}
    df = spark.createDataFrame([(k, t, "", "", 0) for k, t in texts.items()], DOCS)
    compare(pii.report(df).collect(), texts)


def slow_bootstrap(texts):
    """The contextual rule in plain Python: (doc, start, end) of added spans."""
    seen = []
    for doc, text in texts.items():
        spans = base(text)
        # A span is one sign "S" and some "s" in a copy of the text, so that a token is whole around it.
        copy, at, own = list(re.sub("[Ss]", "x", text)), 0, []
        for x, _, y in spans:
            copy[x:y] = ["s" if x + i < at or i else "S" for i in range(y - x)] if x >= at else [c if x + i < at else "s" for i, c in enumerate(copy[x:y])]
            own += [(x, y)] if x >= at else []
            at = max(at, y)
        copy = "".join(copy)
        toks = [(m.start(), m.end()) for m in re.finditer(r"(?<!\S)\S*[0-9S]\S*", copy)]
        for i, (a, b) in enumerate(toks):
            n, seed = copy[:a].count("S"), "S" in copy[a:b]
            skip = len(re.match(r"[^\w+]*", text[a:b])[0])
            core = re.sub(r"^[^\w+]+|[^\w]+$", "", text[a:b])
            s, e = a + skip, a + skip + len(core)
            if not seed and (len(core) < 6 or len(re.sub("[^0-9]", "", core)) < 4):
                continue
            core = text[own[n][0] : own[n][1]] if seed else core
            word = lambda w: re.sub(r"[^a-z=:#]", "", w.lower())
            before, after = text[toks[i - 1][1] if i else 0 : a], text[b : toks[i + 1][0] if i + 1 < len(toks) else len(text)]
            left, right = word((before.split() or [""])[-1]), word((after.split() or [""])[0])
            seen.append((doc, s, e, core, [p for p in (f"L {left}", f"R {right}") if len(p) > 2], seed))
    graph = {}
    for *_, inst, pats, seed in seen:
        for p in pats:
            graph[p, inst] = graph.get((p, inst), False) or seed
    belief = {}
    for (_, i), s in graph.items():
        belief[i] = max(belief.get(i, 0.0), float(s))
    for _ in range(pii.ROUNDS):
        conf = {}
        for p in {k[0] for k in graph}:
            own = {i: s for (q, i), s in graph.items() if q == p}
            if sum(belief[i] >= pii.BELIEF for i in own) >= pii.SUPPORT:
                conf[p] = sum(belief[i] for i in own) / len(own)
        new = {}
        for i in belief:
            own = {p: s for (p, j), s in graph.items() if j == i}
            new[i] = 1.0 if any(own.values()) else 1 - np.prod([1 - min(conf.get(p, 0), 0.999) for p in own])
        belief = new
    return {(d, s, e) for d, s, e, i, pats, seed in seen if not seed and belief.get(i, 0) >= pii.BELIEF and any(conf.get(p, 0) >= pii.CONFIDENCE for p in pats)}


def test_context_finds_unseen_identifiers(spark):
    texts = {i: f"please write to user{i}@mail.org today about this, or call: +1 603 555 87{i:02d} now" for i in range(20)}
    texts |= {100: "please write to user12345(at)mail today about this", 101: "or call: 603-555-8791 now", 102: "in 123456 cases nothing", 103: "or call: 999999 later", 104: "in 123457 cases nothing"}
    rows = [(k, t, "", "", 0) for k, t in texts.items()]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[100] == "id:16:33" and got[101] == "id:9:21" and got[102] == ""
    added = {(d, *map(int, s.split(":")[1:])) for d, all_ in got.items() for s in all_.split(",") if s.startswith("id")}
    assert added == slow_bootstrap(texts)
    masked = {r.doc_id: r for r in pii.masked(spark.createDataFrame(rows, DOCS)).collect()}
    assert masked[101].text == "or call: [ID] now" and masked[101].n_chars == len("or call: [ID] now")
    assert masked[3].text == "please write to [EMAIL] today about this, or call: [PHONE] now"
    assert masked[102].text == texts[102]


def test_found_identifiers_make_patterns(spark):
    """Context beside found identifiers only, and neighbours that are far away or long."""
    texts = {i: f"or call: user{i}@mail.org now" for i in range(20)}
    texts |= {30 + i: f"or call: 77-88{i}00 now" for i in range(4)} | {40 + i: f"ref: 77-88{i}00 filed" for i in range(4)} | {50: "ref: 99-12345 filed"}
    texts |= {60: "or call:" + " " * 60 + "44-55555" + " " * 60 + "now", 61: "in 99-12346 cases", 62: "x" * 60 + "call: 44-66666 " + "now" * 30}
    df = spark.createDataFrame([(k, t, "", "", 0) for k, t in texts.items()], DOCS)
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert all(got[30 + i] == "id:9:17" and got[40 + i] == "id:5:13" for i in range(4))
    assert got[50] == "id:5:13" and got[60] == "id:68:76" and got[61] == got[62] == ""


def slow_masked(text, spans):
    out, at = "", 0
    for start, kind, end in spans:
        if start >= at:
            out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_many_spans_in_one_text(spark):
    """A text full of spans, some overlapping, and with the signs that stand for spans inside the operator."""
    rng = random.Random(15)
    bits = ["me@x.org ", "word ", "192.168.0.1, ", "+1 603 555 8791;", "4111 1111 1111 1111 ", "+4111111111111111@x.org ", "\U0001f642 é ", "\ue001\ue000 ", "a\ue001b "]
    texts = {i: "".join(rng.choice(bits) for _ in range(n)) for i, n in enumerate((0, 1, 2, 5, 50, 500, 20_000))}
    df = spark.createDataFrame([(k, t, "", "", 0) for k, t in texts.items()], DOCS)
    compare(pii.report(df).collect(), texts)
    for r in pii.masked(df).collect():
        want = slow_masked(texts[r.doc_id], base(texts[r.doc_id]))
        assert r.text == want and r.n_chars == len(want)


def test_pii_awkward_rows(docs, awkward, none):
    got = pii.report(docs).collect()
    assert len(got) == len(awkward)
    compare([r for r in got if r.doc_id is not None], {r[0]: r[1] for r in awkward})
    masked = pii.masked(docs)
    assert masked.count() == len(awkward) and masked.where("doc_id = 10").first().text == "[EMAIL] [PHONE]"
    assert pii.report(none).count() == 0 and pii.masked(none).count() == 0


def test_pipeline_stages(spark, none):
    """Each stage against a plain version, on its own input."""
    from .test_near_duplicates import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "pii_masking", "best_fit_packing"]
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality_classifier"](spark, docs, SF).collect()
    scores = {r.doc_id: r.predicted for r in op8_quality_classifier(spark, SF).collect()}
    assert sorted(r.doc_id for r in good) == sorted(k for k, p in scores.items() if p)
    good = spark.createDataFrame(good, docs.schema)
    one = steps["minhash_near_dedup"](spark, good, SF).collect()
    assert sorted(r.doc_id for r in one) == sorted(set(brute({r.doc_id: r.text for r in good.collect()})[0].values()))
    one = spark.createDataFrame(one, docs.schema)
    clean = {r.doc_id: r for r in steps["pii_masking"](spark, one, SF).collect()}
    for r in one.collect():
        if not base(r.text):
            assert clean[r.doc_id].text == r.text or "[ID]" in clean[r.doc_id].text
        assert not base(clean[r.doc_id].text) and clean[r.doc_id].n_chars == len(clean[r.doc_id].text)
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == len(clean)
    for f in steps.values():
        assert f(spark, none, SF).count() == 0
