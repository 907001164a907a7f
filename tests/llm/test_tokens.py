import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import packing, token_files
from sparkloom.llm.queries import op3_token_files, op5_best_fit_packing, tokenizer
from sparkloom.llm.tokens import PieceEncoder

from .conftest import SF

FILES = {"word": tokenizer("word_bpe_49k.json"), "byte": tokenizer("byte_bpe_50k.json")}


def plain(splits):
    lib = Tokenizer.from_file(FILES[splits])
    lib.encode_special_tokens = True
    return lambda text: lib.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("splits", ["word", "byte"])
def test_pieces_give_the_librarys_ids(spark, splits):
    rng, enc, lib = random.Random(3), PieceEncoder(FILES[splits], splits), plain(splits)
    signs = list("aZé9 \n\t\r'") + ["  ", "\n\n", "'s", "n't", "\x1c", "\x85", "\xa0", " ", "́", "ß", "Σ", "日本", "🙂", "<|endoftext|>", "...", " !", "Ǆ", "İ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib(text), repr(text)


def test_small_memory(monkeypatch):
    monkeypatch.setattr("sparkloom.llm.tokens.REMEMBERED", 3)
    lib = plain("byte")
    texts = ["a b c d e f", "f e d", "g"]
    assert [np.frombuffer(x, "<u4").tolist() for x in PieceEncoder(FILES["byte"], "byte").encode(texts)] == [lib(t) for t in texts]


def test_token_files_match_the_library(spark):
    lib, start = plain("word"), 0
    got = {r.doc_id: r for r in op3_token_files(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*lib(r.text), 2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_awkward_rows(spark, docs, awkward, none):
    lib = plain("word")
    got = token_files.read(token_files.encode_documents(docs, FILES["word"], partitions=3)).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(i), zlib.crc32(i.tobytes())) for i in (np.array([*lib(r[1]), 2], "<u4") for r in awkward))
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start)])[:-1].tolist()
    assert [r.doc_id for r in by_start] == [None, *sorted(r[0] for r in awkward if r[0] is not None)]
    assert token_files.read(token_files.encode_documents(none, FILES["word"])).count() == 0


def limited(counts, limit):
    """Least total bits over all length choices that keep Kraft's inequality, by trying them."""
    best = None
    counts = sorted(counts)

    def go(i, least, room, bits):
        nonlocal best
        if i < 0:
            best = bits if best is None else min(best, bits)
            return
        for length in range(least, limit + 1):
            if room >= 2.0**-length:
                go(i - 1, length, room - 2.0**-length, bits + length * counts[i])

    go(len(counts) - 1, 1, 1.0, 0)
    return best


def test_code_lengths_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = rng.integers(1, 200, rng.integers(2, 8)) ** rng.integers(1, 3)
        limit = int(np.ceil(np.log2(len(counts)))) + int(rng.integers(0, 3))
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and (2.0 ** -lengths.astype(float)).sum() <= 1
        assert (lengths * counts).sum() == limited(counts.tolist(), limit)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000, 300_000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 4000).astype(np.uint32)
    lengths = token_files.code_lengths(np.bincount(np.append(ids, 7), minlength=5000))
    sizes = np.array([n // 3, 0, n - n // 3])
    got, back = token_files.decode_block(token_files.encode_block(ids, sizes, token_files.canonical(lengths)[0], lengths))
    assert (got == ids).all() and (back == sizes).all()


def check_packing(rows, want, size=1024):
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert set(by_doc) == set(want)
    for doc, ids in want.items():
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist()
        assert all(r.length == size for r in parts[1:]) and sum(r.length for r in parts) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in parts)
    return len(bins)


def test_packing_covers_all_ids(spark):
    lib = plain("byte")
    want = {r.doc_id: np.array([*lib(r.text), 2], "<u4") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = check_packing(op5_best_fit_packing(spark, SF).collect(), want)
    assert n <= 1.02 * -(-sum(map(len, want.values())) // 1024) + 1


def test_packing_awkward_rows(spark, docs, awkward, none):
    lib = plain("byte")
    got = packing.pack_documents(docs.where("doc_id <> 4"), FILES["byte"]).collect()
    check_packing(got, {r[0]: np.array([*lib(r[1]), 2], "<u4") for r in awkward if r[0] not in (4, None)})
    both = packing.pack_documents(docs, FILES["byte"]).collect()
    assert len(both) == len(got) + 3
    assert packing.pack_documents(none, FILES["byte"]).count() == 0


def test_packing_in_many_groups(spark):
    """Groups waste little: full pieces are sequences of their own, and each group ends with about one open bin."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = packing.pack_documents(docs, FILES["byte"]).select("sequence_id", "length").collect()
    many = packing.pack_documents(docs, FILES["byte"], group=125).select("sequence_id", "length").collect()
    least = -(-sum(r.length for r in one) // 1024)
    sizes = [len({r.sequence_id for r in rows}) for rows in (one, many)]
    assert sizes[0] <= 1.002 * least + 1 and sizes[1] <= sizes[0] + 8
    assert all(r.sequence_id < 0 for r in many if r.length == 1024) and sum(r.length for r in many) == sum(r.length for r in one)


def test_forgetting_pieces_changes_nothing():
    lib, enc = plain("byte"), PieceEncoder(FILES["byte"], "byte", remembered=40)
    texts = [f"some words {i} and {i * 7} more, of {i % 5} kinds" for i in range(300)]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
    assert got == [list(lib(t)) for t in texts]
    enc.trim(3)
    assert len(enc.memory) == 3 and [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts[:3])] == got[:3]


def slow_best_fit(size, capacity, weights, rule):
    bins, out = [], []
    for item in size:
        best = None
        for no, left in enumerate(bins):
            if all(left - item >= 0):
                share, part = (left - item) / capacity, item / capacity
                value = (weights * share**2).sum() if rule == "norm" else -(weights * (left / capacity) * part).sum()
                if best is None or value < best[0] - 1e-12:
                    best = (value, no)
        if best is None:
            bins.append(np.array(capacity, float))
            best = (0, len(bins) - 1)
        bins[best[1]] -= item
        out.append(best[1])
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = np.sort(rng.integers(1, 60, 120))[::-1].astype(float)
        size = np.stack((n, np.ones(120), n * n), axis=1)
        capacity, weights = np.array([100.0, 5, 4000]), np.array([1, 0.3, 0.2])
        got = packing.best_fit(size, capacity, weights, rule)
        for b in set(got.tolist()):
            assert (size[got == b].sum(axis=0) <= capacity).all()
        assert got.tolist() == slow_best_fit(size, capacity, weights, rule)


def test_capacities_of_documents_and_attention(spark, none):
    rows = spark.createDataFrame([(i, 0, 10, 0) for i in range(100)], "doc_id long, piece int, length long, ids_crc32 long")
    few = packing.pack(rows, 1, tokens=1000, documents=4).groupBy("sequence_id").count().collect()
    assert len(few) == 25 and all(r["count"] == 4 for r in few)
    cheap = packing.pack(rows, 1, tokens=1000, documents=1000, attention=500).groupBy("sequence_id").agg(F.sum(F.col("length") ** 2).alias("cost")).collect()
    assert len(cheap) == 20 and all(r.cost <= 500 for r in cheap)
