import base64
import hashlib
import math
import random
import re
import textwrap
import time
import zlib

import numpy as np
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from sparkloom.llm import licenses, media, secrets, sentencepieces
from sparkloom.llm.queries import op1_media_columns, op2_license_scans, op4_secret_scans, op9_sentencepiece, tokenizer

from .conftest import DOCS, SF


def slow_cuts(data):
    """Chunk ends by the rolling hash, one byte at a time."""
    ends, at = [], 0
    while len(data) - at > media.LEAST:
        end = min(at + media.MOST, len(data))
        for e in range(at + media.LEAST, end):
            h = 0
            for b in data[e - media.WINDOW : e]:
                h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
            if h >> (32 - media.BITS) == 0:
                end = e
                break
        ends.append(end)
        at = end
    return ends + ([len(data)] if at < len(data) else [])


def test_cuts_follow_the_rolling_hash():
    rng = np.random.default_rng(2)
    data = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 512, 513, 5000, 40_000)] + [b"\xff" * 50_000]
    got = media.cut_points(data)
    assert got == [slow_cuts(d) for d in data]
    assert got == [media.cut_points([d])[0] for d in data]
    assert [b"".join(media.chunks(d, e)) for d, e in zip(data, got)] == data


def test_an_insertion_moves_no_later_cut():
    data = np.random.default_rng(3).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    a, b = (set(media.chunks(d, media.cut_points([d])[0])) for d in (data, b"some new bytes" + data))
    assert len(a & b) >= len(a) - 2


def check_media(rows, texts):
    """Payload columns against a plain version; equal texts have equal values."""
    seen = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        whole = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert r.feature == media.feature(whole)
        assert seen.setdefault(texts[r.doc_id] or "", (r.media_bytes, r.media_sha256)) == (r.media_bytes, r.media_sha256)


def check_stored_forms(store, media_rows):
    """Digests of the stored forms against the rows of the store, and payloads rebuilt from these by the recipe's layout alone."""
    shared = {r.name: r.body for r in store if r.kind == "chunk"}
    got = {bytes(r.sha): r for r in media_rows}
    for r in store:
        if r.kind == "payload":
            assert r.recipe[:4] == media.MAGIC
            form, whole, own = r.recipe + r.body, b"", zstandard.decompress(r.body)
            for at in range(16, len(r.recipe), 37):
                n, away, digest = int.from_bytes(r.recipe[at : at + 4], "little"), r.recipe[at + 4], r.recipe[at + 5 : at + 37]
                form += shared[digest] if away else b""
                part, own = (zstandard.decompress(shared[digest]), own) if away else (own[:n], own[n:])
                assert len(part) == n and hashlib.sha256(part).digest() == digest
                whole += part
            assert own == b"" and hashlib.sha256(whole).digest() == r.name
            m = got.pop(bytes(r.name))
            assert (m.media_bytes, m.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
    assert not got


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_media_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(media, "BROADCAST_ENTRIES", broadcast)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op1_media_columns(spark, SF).collect()
    assert len(rows) == len(texts)
    check_media(rows, texts)


def test_chunks_are_stored_once(spark):
    rng = random.Random(5)
    piece = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = piece(30_000)
    texts = {i: piece(3000) + common + piece(3000) for i in range(6)} | {10: common, 11: common, 12: None, 13: ""}
    df = spark.createDataFrame([(k, t, "", "", 0) for k, t in texts.items()], DOCS).repartition(3)
    _, store = media.store(df)
    rows = store.collect()
    assert sum(r.kind == "payload" for r in rows) == 8
    names = [r.name for r in rows if r.kind == "chunk"]
    assert len(names) == len(set(names)) > 5
    check_stored_forms(rows, media.load(store).collect())
    kept = sum(len(zstandard.decompress(r.body)) for r in rows)
    assert kept < 0.6 * 6 * 36_000
    check_media(media.round_trip(df).collect(), texts)


def test_smallest_doc_id(spark):
    """The least number is an id like any other, also beside a null one with the same text."""
    df = spark.createDataFrame([(-(1 << 63), "x", "", "", 0), (None, "x", "", "", 0), (None, "y", "", "", 0)], DOCS)
    assert sorted((str(r.doc_id), r.n_bytes) for r in media.round_trip(df).collect()) == [("-9223372036854775808", 1), ("None", 1), ("None", 1)]


def test_media_awkward_rows(docs, awkward, none):
    rows = media.round_trip(docs).collect()
    assert len(rows) == len(awkward)
    check_media([r for r in rows if r.doc_id is not None], {r[0]: r[1] for r in awkward})
    assert media.round_trip(none).count() == 0


def slow_licenses(texts):
    """Every block against every template by wording alone."""
    out = {}
    for doc, text in texts.items():
        for a, b in licenses.blocks(text):
            w = licenses.words(text[a:b])
            best = max(((licenses.differences(licenses.words(t), w), k) for k, t in licenses.TEMPLATES.items()), key=lambda x: (round(x[0][0] * len(licenses.words(licenses.TEMPLATES[x[1]]))) - len(x[0][1].split()), x[0][0]))
            if best[0][0] >= licenses.WORDING:
                out[doc, a, b] = best[1]
    return out


def test_license_scan(spark):
    sf = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r.doc_id, r.start, r.end): r.license for r in op2_license_scans(spark, sf).collect()}
    assert got == slow_licenses(texts) and len(got) > 200
    lines = {line for k in ("GPL-3.0 (notice)", "MIT (notice)", "Apache-2.0 (notice)", "CC-BY-NC-4.0 (notice)") for line in [licenses.TEMPLATES[k]]}
    want = sum(line.strip() in lines for t in texts.values() for line in t.split("\n"))
    assert sum(k.endswith("(notice)") for k in got.values()) >= want


def test_wording_decides(spark):
    mit = licenses.TEMPLATES["MIT"]
    texts = {
        1: "x\n\nCopyright (c) 2020 A B\n" + mit.replace(", free of charge,", ", at a price,") + "\nint main;",
        2: licenses.TEMPLATES["GPL-2.0"], 3: licenses.TEMPLATES["GPL-3.0"], 4: licenses.TEMPLATES["BSD-3-Clause"], 5: licenses.TEMPLATES["BSD-2-Clause"],
        6: "the driver lost his license to drive", 7: "a " * 200 + "Released under the MIT License. " + "b " * 200, 8: None, 9: "",
    }
    df = spark.createDataFrame([(k, t, "", "", 0) for k, t in texts.items()], DOCS)
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert {k: r.license for k, r in got.items()} == {1: "MIT", 2: "GPL-2.0", 3: "GPL-3.0", 4: "BSD-3-Clause", 5: "BSD-2-Clause", 7: "MIT (notice)"}
    assert "+price" in got[1].differences and "-free" in got[1].differences and got[2].differences == ""


@pytest.mark.parametrize("n", [30, 40, 100, 400])
def test_notices_among_prose(spark, n):
    """The words around a notice don't hide it, on a line with it or on lines of their own."""
    prose = [w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(40).collect() if not licenses._CUE.search(r.text) for w in r.text.split()]
    texts, want = {}, set()
    for i, k in enumerate(k for k in licenses.TEMPLATES if k.endswith("(notice)")):
        a, b = prose[i * 900 :][:n], prose[i * 900 + 450 :][:n]
        texts[i] = " ".join([*a, licenses.TEMPLATES[k], *b])
        want.add((i, k))
    df = spark.createDataFrame([(k, t, "", "", 0) for k, t in texts.items()], DOCS)
    assert {(r.doc_id, r.license) for r in licenses.scan(df).collect()} == want


@pytest.mark.parametrize("width", [30, 50, 72])
@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_headers(spark, width, mark):
    """Every wording in lines, without a copyright line, among lines of code."""
    code = "\n".join(f"int v{i} = f(v{i - 1}, {i});" for i in range(1, 60))
    names = sorted(licenses.TEMPLATES)
    texts = ["\n".join([code, *(mark + line for line in textwrap.wrap(licenses.TEMPLATES[k], width, break_long_words=False, break_on_hyphens=False)), code]) for k in names]
    df = spark.createDataFrame([(k, t, "", "", 0) for k, t in enumerate(texts)], DOCS)
    got = licenses.scan(df).collect()
    assert sorted((names[r.doc_id], r.license) for r in got) == [(k, k) for k in names]
    assert all(r.wording == 1 and r.differences == "" for r in got)


def test_every_license_of_a_block(spark):
    names, t = sorted(licenses.TEMPLATES), licenses.TEMPLATES
    short = [k for k in names if k.endswith("(notice)")]
    several = {
        0: ["MIT (notice)", "Apache-2.0 (notice)"], 1: short, 2: names, 3: names[::-1], 4: ["GPL-2.0", "GPL-3.0", "GPL-2.0"], 5: ["MIT (notice)"] * 3,
        6: [short[i % len(short)] for i in range(900)], 7: [names[i % 23] for i in range(115)],
    }
    texts = {k: "\n".join(f"{i} lib{i}: {t[n]}" for i, n in enumerate(v)) for k, v in several.items()}
    texts |= {k + 10: x.replace("\n", " ") for k, x in texts.items()}
    df = spark.createDataFrame([(k, x, "", "", 0) for k, x in texts.items()], DOCS)
    got = {k: [] for k in texts}
    for r in sorted(licenses.scan(df).collect(), key=lambda r: r.found_start):
        got[r.doc_id].append(r.license)
        assert licenses.words(texts[r.doc_id][r.found_start : r.found_end]) == licenses.words(t[r.license]) and r.start <= r.found_start < r.found_end <= r.end
    assert got == {k: several[k % 10] for k in texts}


def test_license_awkward_rows(docs, none):
    assert licenses.scan(docs).count() == 0 and licenses.scan(none).count() == 0


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark))


def test_secrets_of_the_sample(spark):
    sf = "/root/testdata/sf0.01"
    want = {(r.doc_id, m.start(1), m.end(1)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text)}
    assert {(r.doc_id, r.start, r.end) for r in op4_secret_scans(spark, sf).collect()} == want


def test_held_out_findings(spark, forest):
    rows = secrets.labelled_findings(spark, 9000).where("xxhash64(hit) % 3 = 0")
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(secrets.with_features(rows))
    assert forest.transform(data).select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.97


def test_false_positives_go(spark, forest):
    texts = {
        1: 'api_key = "9f14a7029c8514dfe98aba92898d323168e199da"', 2: "see commit 9f14a7029c8514dfe98aba92898d323168e199da for it", 3: 'password = "your_password_here_1234"',
        4: "uuid 123e4567-e89b-12d3-a456-426614174000", 5: None, 6: "", 7: "node_modules/object/v2/string/index3.js", 8: "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    }
    df = spark.createDataFrame([(k, t, "", "src/a.py", 0) for k, t in texts.items()], DOCS)
    got = secrets.scan(df, forest).collect()
    assert [(r.doc_id, r.start, r.end) for r in got] == [(1, 11, 51)]
    assert got[0].secret_sha256 == hashlib.sha256(b"9f14a7029c8514dfe98aba92898d323168e199da").hexdigest()
    assert {r.doc_id: r.probability for r in secrets.scan(df, None).collect()} == {k: 0.5 for k in (1, 2, 3, 4, 7)}


def slow_features(hit, before, after, path):
    """Features of a finding, character by character where a loop can say it."""
    n, low, near = len(hit), hit.lower(), before.lower()
    kind = ["a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "_" for c in hit]
    known = sorted({w for w in (*secrets.DICTIONARY.split(), *secrets.stopwords.ALL) if len(w) > 2 and w.isalpha()}, key=len)
    covered = at = 0
    while at < n:
        most = max((len(w) for w in known if low.startswith(w, at)), default=0)
        covered, at = covered + most, at + max(most, 1)
    repeats = at = 0
    while at < n - 1:
        same = hit[at] == hit[at + 1]
        repeats, at = repeats + same, at + 1 + same
    word = re.search(rf"(?:{secrets.SECRET_WORDS})([^\n]*)$", near)
    beside = any(re.fullmatch(r"[^\n]{0,12}", near[m.end() :]) for k in range(len(near)) for m in [re.compile(secrets.SECRET_WORDS).match(near, k)] if m) if word else False
    return {
        "size": math.log2(n), "changes": sum(a != b for a, b in zip(kind, kind[1:])) / n, "case_changes": sum(a + b == "aA" for a, b in zip(kind, kind[1:])) / n, "distinct": len(set(hit) & set(secrets.SIGNS)) / min(n, 64),
        "digits": kind.count("0") / n, "upper": kind.count("A") / n, "symbols": kind.count("_") / n, "hex": float(set(hit) <= set("0123456789abcdef") or set(hit) <= set("0123456789ABCDEF")), "covered": covered / n,
        "uuid": float([len(p) for p in low.split("-")] == [8, 4, 4, 4, 12] and set(low) <= set("0123456789abcdef-")), "dotted": float(hit.count(".") + hit.count("/")), "repeats": repeats / n, "secret_word": float(beside),
        "assigned": float(bool(near.rstrip("\"'`")[-1:] and near[:-1 if near[-1:] in "\"'`" else None].rstrip().endswith(("=", ":")))), "quoted": float(near[-1:] in set("\"'`") and after[:1] in set("\"'`")),
        "test_path": float(bool(set(re.split(r"[/_.-]", (path or "").lower())) & {"test", "tests", "spec", "fixture", "fixtures", "example", "examples", "sample", "samples", "doc", "docs", "mock", "mocks", "yarn", "poetry"})),
    }


def test_features_against_a_slow_version(spark):
    rng = random.Random(9)
    signs = "abcXYZ019+/_=.-!aa"
    hits = ["".join(rng.choice(signs) for _ in range(rng.randint(8, 60))) for _ in range(150)] + ["your_token_here_12", "theandthe", "123e4567-e89b-12d3-a456-426614174000", "DEADBEEF12", "deadbeef12", "aaaa", "aaaaa"]
    befores = ["token = ", 'api_key: "', "see commit ", "x=", "", "secret of a long line, and", "password `", "token\n"]
    rows = [(h, rng.choice(befores), rng.choice(['"', " x", "", "`"]), rng.choice([None, "src/a.py", "src/tests/a.py", "docs/x", "latest/a", "a_test.py"])) for h in hits]
    got = secrets.with_features(spark.createDataFrame(rows, "hit string, before string, after string, path string")).collect()
    for r in got:
        for name, value in slow_features(r.hit, r.before, r.after, r.path).items():
            assert r[name] == pytest.approx(value), (name, r)


def test_candidates_of_any_length(spark):
    """Names before '=' are not part of a hit, padding is, and no length is too great."""
    rng = random.Random(6)
    made = lambda n, signs="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choice(signs) for _ in range(n - 2)) + "a7"
    cases = {
        "DB_PASSWORD=": made(8), "AWS_SECRET_ACCESS_KEY=": made(40), "export GITHUB2_APP3_TOKEN=": made(36), 'password: "': made(15), "token = ": made(22) + "==",
        "auth: Bearer ": ".".join(["eyJ" + made(33), made(700), made(43)]), "private_key = ": base64.b64encode(rng.randbytes(1600)).decode(), "secret=": made(300_000), "x = ": made(600),
    }
    texts = {i: f"some words\n{a}{b}\nmore words" for i, (a, b) in enumerate(cases.items())} | {20: "version " + made(12), 21: "password = abcdefghijkl", 22: "see a1b2c3 token"}
    df = spark.createDataFrame([(k, t, "", "src/a.py", 0) for k, t in texts.items()], DOCS)
    got = [(r.doc_id, r.start, r.end, r.secret_sha256) for r in secrets.scan(df, None).collect() if "TOKEN" not in texts[r.doc_id][r.start : r.end]]
    assert sorted(got) == [(i, 11 + len(a), 11 + len(a) + len(b), hashlib.sha256(b.encode()).hexdigest()) for i, (a, b) in enumerate(cases.items())]


def test_quoted_values_in_little_time(spark):
    """Places without a quote before them cost next to nothing; the values found are those of the words alone."""
    plain = rf"(?<=(?i:{secrets.SECRET_WORDS})[\"'`]?\s{{0,3}}(?:[:=]|:=|=>)\s{{0,3}}[\"'`])[^\"'`\s]{{8,}}+(?=[\"'`])"
    rng = random.Random(8)
    parts = ["token", "API_key", "Auth", "x", " ", "  ", "\n", ":", "=", ":=", "=>", '"', "'", "`", "abcdefg", "h!", "é$", "a1b2c3d4e5"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(4000)]
    texts += [f"{w}{q}{s}{a}{q}{v}{q}" for w in ("Password", "pwds") for q in ("'", '"', "") for s in ("", "   ", "    ") for a in ("=", ":=", "=>", "==") for v in ("8 signs!", "8_signs!", "7_signs", "9_signs'!")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    all_of = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    got = df.select(all_of(secrets.QUOTED).alias("got"), all_of(plain).alias("want")).collect()
    assert all(r.got == r.want for r in got) and 50 < sum(len(r.want) for r in got)

    prose = spark.createDataFrame([("It isn't the author's word, nor hers. " * 2000,)] * 8, "text string").repartition(8).cache()
    prose.count()

    def seconds(pattern):
        start = time.perf_counter()
        assert prose.where(F.col("text").rlike(pattern)).count() == 0
        return time.perf_counter() - start

    seconds(secrets.TOKEN)
    assert seconds(secrets.QUOTED) < 0.2 * seconds(plain) + 0.2


def test_secrets_of_any_length(spark, forest):
    """Short, long and env-style secrets are told from harmless runs like them."""
    rng = random.Random(7)
    made = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n - 2)) + "k7"
    blob = lambda n: base64.b64encode(rng.randbytes(n)).decode()
    secret = {
        "short": lambda: f'password = "{made(rng.randint(9, 15))}"', "env": lambda: f"export CLIENT2_SECRET1_TOKEN={made(40)}", "short env": lambda: f"DB_PASSWORD={made(12)}",
        "letters": lambda: f'password = "{"".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randint(10, 15)))}"',
        "signs": lambda: f"passwd: '{made(rng.randint(5, 8))}{rng.choice('!#$%@&')}{made(4)}'", "hex": lambda: f'token = "{hashlib.sha1(rng.randbytes(9)).hexdigest()}"',
        "jwt": lambda: f"token: eyJ{made(33)}.{made(rng.randint(100, 900))}.{made(43)}", "key": lambda: f"private_key={blob(rng.randint(400, 3000))}",
    }
    harmless = {
        "named": lambda: f'token = "{rng.choice(["value", "example", "default", "content"])}_item{rng.randint(10, 99)}"', "image": lambda: f"data:image/png;base64,{blob(rng.randint(400, 3000))}",
        "words": lambda: f'secret = "{rng.choice(["enter", "your", "insert", "default"])}{rng.choice(["-", "_", ""])}{rng.choice(["password", "value", "content"])}"',
        "env": lambda: f"COMMIT={hashlib.sha1(rng.randbytes(9)).hexdigest()}", "plain": lambda: f"version {made(12)}",
    }
    rows = [(label, k, f()) for label, kinds in ((1, secret), (0, harmless)) for k, f in kinds.items() for _ in range(40)]
    df = spark.createDataFrame([(i, f"some words\n{t}\nmore", "", "src/a.py", 0) for i, (_, _, t) in enumerate(rows)], DOCS)
    seen = {r.doc_id for r in secrets.scan(df, forest).collect()}
    right = {}
    for i, (label, k, _) in enumerate(rows):
        right[label, k] = right.get((label, k), 0) + ((i in seen) == label) / 40
    assert min(right.values()) >= 0.9, right


def test_secrets_awkward_rows(spark, docs, none, forest):
    assert secrets.scan(docs, forest).count() == 0 and secrets.scan(none, forest).count() == 0
    assert secrets.train(secrets.labelled_findings(spark).where("label = 1")) is None
    assert secrets.scan(docs.drop("source"), forest).count() == 0


MODEL = tokenizer("piece_bpe_32k.model")


def test_pieces_are_the_librarys(spark):
    sp, auto, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepieces.automaton(MODEL), random.Random(1)
    signs = list("abcdeéñ .,\n-AB19") + ["  ", "the", "ing", "日本", "🙂", "    ", "▁", "\x00", "\t", "<0x41>", "<s>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text in texts:
        ids = auto.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text), repr(text)
        assert auto.decode(ids) == text.replace("▁", " ")


def test_merging_a_long_text(monkeypatch):
    """By merging outright, with the best score and the leftmost of equals, as one that looks at all pairs each time."""
    auto, rng = sentencepieces.automaton(MODEL), random.Random(8)

    def slow(parts):
        while True:
            pairs = [(-auto.scores[auto.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in auto.ids]
            if not pairs:
                return parts
            i = min(pairs)[1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]

    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "the", "in", "g", "aa", "é", "x"]) for _ in range(rng.randint(0, 40)))
        assert auto._merged(text) == slow(list(text))
    assert len(auto._merged("ab" * 50_000)) == 50_000


def message(*fields):
    """A message of (number, value) with integers under 128 and short strings."""
    return b"".join(bytes([k << 3, v]) if isinstance(v, int) else bytes([k << 3 | 2, len(v)]) + v for k, v in fields)


def test_settings_that_are_not_supported_raise():
    plain = [(3, 1), (4, 0)]
    model = lambda kind=2, norm=plain, more=(): message((2, message((3, kind))), (3, message(*norm)), *more)
    assert sentencepieces.settings(model()) == (True, True) and sentencepieces.settings(model(1, [(3, 0), (4, 0)])) == (False, False)
    piece = lambda kind: (1, message((1, b"x"), (3, kind)))
    assert sentencepieces.settings(model(more=[piece(1), piece(6)])) == (True, True)
    for bad in (model(3), model(norm=[(2, b"map"), (4, 0)]), model(norm=[(4, 1)]), model(norm=[]), model(norm=[*plain, (5, 0)]), model(more=[piece(4)])):
        with pytest.raises(ValueError):
            sentencepieces.settings(bad)


def slow_best(text, scores):
    best = [(0.0, [])] + [None] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            if best[i] is not None and text[i:j] in scores:
                s = best[i][0] + scores[text[i:j]]
                if best[j] is None or s > best[j][0]:
                    best[j] = (s, best[i][1] + [text[i:j]])
    return best[-1]


def test_unigram_scores_are_best():
    rng = random.Random(4)
    for _ in range(300):
        scores = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.random() * 5 for _ in range(12)} | {c: -6 - rng.random() for c in "abc"}
        pieces = ["<unk>", *scores]
        auto = sentencepieces.PieceAutomaton(pieces, [None, *scores.values()], 0, merges=False, prefix=False)
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        got = [pieces[i] for i in np.frombuffer(auto.encode(text), "<u4")]
        assert "".join(got) == text and sum(scores[p] for p in got) == pytest.approx(slow_best(text, scores)[0])


def test_unknown_characters_without_byte_pieces():
    auto = sentencepieces.PieceAutomaton(["<unk>", "a", "ab"], [None, -1.0, -1.5], 0, merges=False, prefix=False)
    assert np.frombuffer(auto.encode("abxa"), "<u4").tolist() == [2, 0, 1]


def test_sentencepiece_round_trip(spark, docs, awkward, none):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op9_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts) and all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
    rows = sentencepieces.round_trip(docs, MODEL).collect()
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in awkward)
    back = sentencepieces.decode(sentencepieces.encode(docs, MODEL), MODEL).collect()
    assert {r.doc_id: r.text for r in back} == {r[0]: r[1] or "" for r in awkward}
    assert sentencepieces.round_trip(none, MODEL).count() == 0
