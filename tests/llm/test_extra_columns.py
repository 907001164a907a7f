"""Extra columns whose names the operators use themselves."""

from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import embeddings, licenses, media, minhash, packing, pii, quality, secrets, sentencepieces, token_files
from sparkloom.llm.queries import tokenizer

NAMES = ("key", "base", "added", "rep", "bands", "bucket", "k", "h", "k1", "node", "kind", "label", "score", "path", "path_", "tokens", "start", "end", "piece", "ids", "crc", "shared", "owner", "features", "probability", "a", "b", "x", "kept")


def extra(df):
    return df.withColumns({n: F.lit("clash") for n in NAMES if n not in df.columns})


def test_documents(spark, docs, awkward):
    more, n = extra(docs), len(awkward)
    model = quality.train(more, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int"))
    byte, word = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
    assert media.round_trip(more).count() == n
    assert licenses.scan(more).count() == 0 and secrets.scan(more, None).count() == 0
    assert token_files.read(token_files.encode_documents(more, word, partitions=2)).count() == n
    assert packing.pack_documents(more, byte).where("piece = 0").count() == n
    assert quality.score(more, model).count() == n and quality.keep_good(more, model).columns == more.columns
    assert sentencepieces.round_trip(more, tokenizer("piece_bpe_32k.model")).count() == n
    assert minhash.near_duplicates(more).count() == n and pii.report(more).count() == n
    masked = pii.masked(more)
    assert masked.columns == more.columns and masked.count() == n and masked.where("base <> 'clash'").count() == 0
    assert dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, more, "").columns == more.columns


def test_vectors(spark):
    rows = [(i, [1.0, float(i % 2)], 0) for i in range(6)]
    df = extra(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert embeddings.near_duplicates(df).where("n_links = 2").count() == 6
