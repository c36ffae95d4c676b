"""Writing results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[DataFrame, str], DataFrame]


def json_object(*columns: str | Column) -> Column:
    """JSON text of the given columns; a null column has no key in it."""
    return F.to_json(F.struct(*columns))


def as_json(df: DataFrame, keep: Sequence[str] = (), name: str = "json") -> DataFrame:
    """The row as JSON text, next to the columns to keep."""
    return df.select(*keep, json_object(*df.columns).alias(name))


def write_table(
    df: DataFrame, path: str, mode: str = "error", partition_by: Sequence[str] = ()
) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def parquet_stage(spark: SparkSession, folder: str) -> Stage:
    """Write an intermediate table under a shared folder and go on from there, with no lineage left."""

    def stage(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("error").parquet(path)
        return spark.read.parquet(path)

    return stage
