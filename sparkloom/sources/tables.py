"""Input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of at most so many bytes is dealt out; bytes for one task then.
SMALL, SHARE = 256 << 20, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A small table over all cores: a file with one row group is one task otherwise. A table over ``SMALL`` stays as it is read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL:
        return df
    return df.repartition(max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE))))
