"""Which of several passages holds when they disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_authority(hits: DataFrame) -> DataFrame:
    """Hits with their standing: current before deprecated, then by authority, then by search rank.

    ``is_guidance`` marks the one passage to follow; a deprecated passage never is one and is
    marked ``is_superseded``. A query has at most k hits, so its window is small.
    """
    current = F.coalesce(F.col("status") == "current", F.lit(False))
    order = Window.partitionBy("query_id").orderBy(F.desc("is_current"), "authority_rank", "rank")
    return (
        hits.withColumn("is_current", current)
        .withColumn("authority_position", F.row_number().over(order))
        .withColumn("is_guidance", F.col("is_current") & (F.col("authority_position") == 1))
        .withColumn("is_superseded", F.coalesce(F.col("status") == "deprecated", F.lit(False)))
    )
