"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallydesk.plans.checkpoints import parquet_checkpoint

# Write a table to the folder that the session shares and go on from there: read twice, computed once.
staged = parquet_checkpoint


TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_definition(name: str = TOKENIZER) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def plain_columns(docs: DataFrame, text: str, keep: Sequence[str] | None, added: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """The columns to keep as c0, c1, ... with the text as the last one, and the names they had.

    Functions over Arrow batches look columns up by name, which dots and names that differ in case
    only would break. Columns that are called like ``added``, in any case, are left out.
    """
    replaced = {name.lower() for name in added}
    names = [name for name in docs.columns if (keep is None or name in keep) and name.lower() not in replaced]
    return docs.select(*[col(name).alias(f"c{n}") for n, name in enumerate(names)], col(text).alias("text")), names


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name like ``name`` that no column has, whatever its case."""
    used = {column.lower() for column in taken}
    while name.lower() in used:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    return F.coalesce(col(name), F.lit(""))


def worked_out(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with ``value`` as one more column that is worked out once a row.

    A column that lambdas refer to would otherwise be put in their place, and be worked out again
    for every element; the optimizer leaves what a generator makes as it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def blocks_for(df: DataFrame, size: Column, bytes_per_block: int) -> int:
    """How many blocks of that many bytes the rows fill."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return max(1, -(-total // bytes_per_block))


def row_key(*names: str) -> Column:
    """A 64-bit key from values, so that a task that runs again gives each row the same one."""
    return F.xxhash64(*[col(name) for name in names])
