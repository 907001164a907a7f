"""Every query with SQL against DuckDB, and what holds for all of them."""

import datetime
import os
import zlib

import duckdb
import pytest

import __spark_entry__ as entry_point
from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    assert len(got.columns) == len(set(got.columns))
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, data) == rows(want.columns, want.fetchall())


def test_cloze_texts_of_words_that_begin_like_the_sentence(spark, tmp_path):
    texts = ["onlynd", "The onlyer", "onlyx", "no onlyabcd", "foxtrot", "", None, "ONLY words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["cloze_texts"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL["cloze_texts"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_checksums(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.crc32 for r in registry.QUERIES["content_checksums"](spark, SF).collect()} == {k: zlib.crc32(t.encode()) for k, t in texts.items()}


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_same_rows_for_any_partitioning(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("word_top_forms", "renumbered_segments", "id_to_file", "gap_sessions"):
            seen = []
            for n in ("1", "5"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                df = registry.QUERIES[name](spark, SF)
                seen.append(rows(df.columns, [tuple(r) for r in df.collect()]))
            assert seen[0] == seen[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
