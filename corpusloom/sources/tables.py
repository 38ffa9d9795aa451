"""Tables of a folder, and small ones dealt over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes a core below which a table is dealt anew: a file of one row group is one task, however many cores wait.
SPREAD_BYTES = 16 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if the plan's size is below ``SPREAD_BYTES`` a core, so what moves is that much at most; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPREAD_BYTES * cores else df
