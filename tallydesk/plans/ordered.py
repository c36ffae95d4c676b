"""Ordered lists of any length, as pages of bounded length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallydesk.plans.checkpoints import checkpointed

# monotonically_increasing_id() keeps the partition above and the row below this bit.
_ROW_BITS = 33


def in_order(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The rows with their place ``_pos`` in one range sort by group and ``order``, checkpointed.

    The checkpoint lets later steps read the rows more than once and agree on their places.
    """
    return checkpointed(
        df.orderBy(group, *order).withColumn("_pos", F.monotonically_increasing_id())
    )


def paged_lists(
    placed: DataFrame, group: str, value: str, page_size: int, separator: str = ", "
) -> DataFrame:
    """(group, page, values, total) of rows from ``in_order``: each group's values, joined page by page.

    The rank of a row in its group follows from the number of rows that earlier partitions hold, so
    no task ever sees a whole group.
    """
    rows = placed.select(group, value, "_pos", F.shiftright("_pos", _ROW_BITS).alias("_part"))
    # One row per partition and group in it: sorted by group first, so partitions + groups at most.
    pieces = rows.groupBy(group, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        group,
        "_part",
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("total"),
    )
    ranked = rows.join(offsets, [group, "_part"]).withColumn(
        "_rank", F.col("_before") + F.col("_pos") - F.col("_first")
    )
    return (
        ranked.withColumn("page", F.floor(F.col("_rank") / F.lit(page_size)))
        .groupBy(group, "page")
        .agg(
            F.expr(f"listagg(CAST(`{value}` AS STRING), '{separator}') WITHIN GROUP (ORDER BY _rank)").alias("values"),
            F.max("total").alias("total"),
        )
    )
