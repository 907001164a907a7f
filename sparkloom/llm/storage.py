"""Tables written between the steps of a job.

Lineage is cut by writing Parquet into the folder that the cluster names in
``spark.checkpoint.dir``: it is shared by all executors, so a lost executor costs
its running tasks only.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a new one if all runs in one local process, as in tests; else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Rows that scans, and Python workers, take at a time. Texts are long: by default a batch takes tens of megabytes, in the JVM and in each worker.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 1000}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, plans are made with BATCHES, or with what the session has if that is smaller."""
    was = {k: spark.conf.get(k) for k in BATCHES}
    try:
        for k, most in BATCHES.items():
            # Zero or less stands for no limit.
            spark.conf.set(k, min(int(was[k]), most) if int(was[k]) > 0 else most)
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def staged(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet, in a folder for each value of ``by``, and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files behind a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
