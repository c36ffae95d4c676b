"""Equi-joins that stay balanced under hot keys.

A plain shuffle join sends all rows of a key to one task. Here the rows of a hot key are spread
over several slots by a hash of the row's own columns, and the matching rows of the other side are
repeated once per slot. Slots come from row values, never from random numbers, so a task that is
run again after a lost executor puts every row where it was before.

The list of hot keys is the only thing broadcast. A hot key holds more than a fixed share of all
rows, so there are only so many of them, and all of them are spread.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spread:
    """A key with more than ``rows_per_slot`` rows, and more than one in ``most_keys`` of all, is hot.

    So there are fewer than ``most_keys`` hot keys, whatever the input. Slots hold ``rows_per_slot``.
    """

    rows_per_slot: int = 500_000
    most_keys: int = 100_000


DEFAULT_SPREAD = Spread()


def key_counts(df: DataFrame, keys: Sequence[str], name: str = "_rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _slots(rows: str, spread: Spread) -> Column:
    return F.ceil(F.coalesce(F.col(rows), F.lit(0)) / F.lit(spread.rows_per_slot)).cast("int")


def hot_from_counts(counts: DataFrame, keys: Sequence[str], spread: Spread, name: str = "_rows") -> DataFrame:
    """The hot keys with their number of slots; the null key counts like any other."""
    return counts.filter(_is_hot(F.col(name), counts, name, spread)).select(
        *keys, _slots(name, spread).alias("_own"), F.lit(1).alias("_other")
    )


def _is_hot(rows: Column, counts: DataFrame, name: str, spread: Spread) -> Column:
    """More than fits a slot, and a share of the total that few keys can have."""
    total = counts.select(F.sum(name)).scalar()
    return (rows > spread.rows_per_slot) & (rows * F.lit(spread.most_keys) > total)


def _with_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    marks = hot.select(*[F.col(key).alias(f"_hot_{key}") for key in keys], "_own", "_other")
    same = reduce(lambda a, b: a & b, [df[key].eqNullSafe(marks[f"_hot_{key}"]) for key in keys])
    return df.join(F.broadcast(marks), same, "left").drop(*[f"_hot_{key}" for key in keys])


def _hash_slot(by: Sequence[str], slots: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.coalesce(F.col(slots), F.lit(1))).cast("int")


def _every_slot(slots: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(slots), F.lit(1)) - 1))


def join_to_one(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    spread: Spread = DEFAULT_SPREAD,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Left join of a fact side with hot keys to a side with few rows per key.

    ``spread_by`` names columns of the fact side that tell its rows apart. ``counts`` may hand over
    rows per key (``_rows``) that are already known.
    """
    keys = list(keys)
    hot = hot_from_counts(counts if counts is not None else key_counts(many, keys), keys, spread)
    left = _with_hot(many, keys, hot).withColumn("_slot", _hash_slot(spread_by, "_own")).drop("_own", "_other")
    right = _with_hot(one, keys, hot).withColumn("_slot", _every_slot("_own")).drop("_own", "_other")
    return left.join(right, [*keys, "_slot"], "left").drop("_slot")


def join_many(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_by: Sequence[str],
    right_by: Sequence[str],
    spread: Spread = DEFAULT_SPREAD,
    right_counts: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Inner join of two sides that may both have hot keys: a hot key becomes a grid of slots.

    ``right_counts`` may hand over rows per key (``_rows``) of the right side. ``tasks`` is for
    results far larger than both sides: both are dealt to so many, however few their bytes are.
    """
    keys = list(keys)
    right_rows = right_counts if right_counts is not None else key_counts(right, keys)
    both = key_counts(left, keys, "_lrows").join(right_rows.withColumnRenamed("_rows", "_rrows"), keys)
    hot = both.filter(
        _is_hot(F.col("_lrows"), both, "_lrows", spread) | _is_hot(F.col("_rrows"), both, "_rrows", spread)
    ).select(*keys, _slots("_lrows", spread).alias("_own"), _slots("_rrows", spread).alias("_other"))
    across = (
        _with_hot(left, keys, hot)
        .withColumn("_row", _hash_slot(left_by, "_own"))
        .withColumn("_col", _every_slot("_other"))
        .drop("_own", "_other")
    )
    down = (
        _with_hot(right, keys, hot)
        .withColumn("_col", _hash_slot(right_by, "_other"))
        .withColumn("_row", _every_slot("_own"))
        .drop("_own", "_other")
    )
    cell = [*keys, "_row", "_col"]
    if tasks is not None:
        across, down = across.repartition(tasks, *cell), down.repartition(tasks, *cell)
    return across.join(down, cell, "inner").drop("_row", "_col")


def join_head_and_tail(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    weight: str,
    head_size: int = 500_000,
) -> DataFrame:
    """Inner join for keys of a falling-off frequency, such as words.

    ``lookup`` is unique on ``key`` and ``weight`` tells how many rows share the key. Keys with more
    than 1/head_size of the total weight, of which there are fewer than ``head_size``, are broadcast
    and serve most facts without a shuffle. Only facts with a rarer key are shuffled.
    """
    total = lookup.select(F.sum(weight)).scalar()
    is_head = F.col(weight) * F.lit(head_size) > total
    head = lookup.filter(is_head)
    common = facts.join(F.broadcast(head), key, "inner")
    rare = facts.join(F.broadcast(head.select(key)), key, "left_anti").join(
        lookup.filter(~is_head), key, "inner"
    )
    return common.unionByName(rare)
