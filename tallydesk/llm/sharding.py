"""Shards of a corpus in random order, by an external shuffle in two passes.

First pass: every record goes to a bucket drawn by a seeded hash of its values. Buckets are sized to
fit in memory. Copies of a record that would fill much of a bucket are counted, not moved, and dealt
out one by one, so that repeated records spread like any others. Second pass: each bucket is put in an order drawn by a Fisher-Yates shuffle (Spark's
``shuffle`` of an array) of its positions, and the buckets follow each other. The sequence is cut
into shards of equal counts, at most one record apart.

Draws depend on the seed, on the values of the records and on how buckets lie in partitions, never
on which task runs first, so a task that runs again puts each record where it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallydesk.llm.common import col, fresh, staged

# Bytes of text that one bucket holds.
BUCKET_BYTES = 16 << 20

# Copies of one record that fill more than this part of a bucket are dealt out one by one.
_OFTEN = 1 / 8

# Copies that one row of the count stands for, and buckets whose sizes one task adds up.
_COPIES, _BUCKETS = 4096, 4096


def _sortable(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema if "map" not in field.dataType.simpleString() and "variant" not in field.dataType.simpleString()]


def _numbered_copies(docs: DataFrame, copy: str, key: Column, record_bytes: Column, often_bytes: int) -> DataFrame:
    """The rows, with a number for each copy of the records whose copies are of more than ``often_bytes``; 0 for others.

    There are fewer such records than total bytes / ``often_bytes``. They are counted before they are
    shuffled, and the rows made from counts by many tasks.
    """
    if len(_sortable(docs)) < len(docs.columns):
        return docs.withColumn(copy, F.lit(0).cast("long"))
    known = fresh(docs.columns, "_key")
    keyed = docs.withColumn(known, key)
    copies = keyed.groupBy(known).agg(F.count(F.lit(1)).alias("n"), F.sum(record_bytes).alias("bytes"))
    often = staged(copies.filter((F.col("n") > 1) & (F.col("bytes") > often_bytes)).select(known), "often")
    if often.isEmpty():
        return docs.withColumn(copy, F.lit(0).cast("long"))
    total, part = fresh(docs.columns, "_total"), fresh(docs.columns, "_part")
    others = keyed.join(often, known, "left_anti").withColumn(copy, F.lit(0).cast("long"))
    counted = keyed.join(often, known, "left_semi").groupBy(known, *[col(name) for name in docs.columns]).agg(F.count(F.lit(1)).alias(total))
    parts = counted.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{total}` - 1) div {_COPIES}")))).repartition(known, part)
    first = F.col(part) * _COPIES
    repeated = parts.withColumn(copy, F.explode(F.sequence(first, F.least(first + _COPIES, F.col(total)) - 1)))
    names = [col(name) for name in docs.columns]
    return others.select(*names, copy).union(repeated.select(*names, copy))


def _rows_before(counts: DataFrame, bucket: str, rows: str, before: str) -> DataFrame:
    """Rows of all earlier buckets: added up over groups of buckets, then within each group."""
    counts = counts.withColumn("_group", F.floor(F.col(bucket) / _BUCKETS))
    earlier = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_group").agg(F.sum(rows).alias("_in_group"))
    groups = groups.select("_group", F.coalesce(F.sum("_in_group").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_group").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.withColumn("_inside", F.coalesce(F.sum(rows).over(within), F.lit(0))).join(groups, "_group")
    return summed.select(bucket, rows, (F.col("_base") + F.col("_inside")).alias(before))


def shard(
    docs: DataFrame,
    shards: int = 16,
    text: str = "text",
    seed: int = 42,
    bucket_bytes: int = BUCKET_BYTES,
    shard_column: str = "shard",
    slot_column: str = "slot",
) -> DataFrame:
    """The rows with ``shard`` (from 0) and ``slot``, the place in the shard (from 0, without gaps).

    Counts of shards are at most one apart; with fewer rows than shards some stay empty. Null and
    empty texts, null ids and repeated rows are records like any other; equal rows take any of their
    places, and are told apart by number where they would fill a bucket (not in tables with maps or
    variants; there -0.0 counts as 0.0). Columns already called like the new ones are replaced.
    """
    docs = docs.drop(shard_column, slot_column)
    record_bytes = F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long") + 64
    n, size = docs.agg(F.count(F.lit(1)), F.sum(record_bytes)).first()
    buckets = max(1, -(-(size or 0) // bucket_bytes))
    bucket, place, order, copy = (fresh(docs.columns, name) for name in ("_bucket", "_place", "_order", "_copy"))
    values = [col(name) for name in _sortable(docs)]
    # Pass 1: uniform buckets; within one, an order that follows from the values alone.
    dealt = _numbered_copies(docs, copy, F.xxhash64(F.lit(seed), *values), record_bytes, int(bucket_bytes * _OFTEN))
    in_bucket = F.pmod(F.xxhash64(F.lit(seed), *values, F.col(copy)), F.lit(buckets))
    scattered = dealt.withColumn(bucket, in_bucket).withColumn(
        place,
        F.row_number().over(Window.partitionBy(bucket).orderBy(F.xxhash64(F.lit(seed + 1), *values), copy)) - 1,
    )
    # Pass 2: how many records earlier buckets hold, and a drawn order of each bucket's own places.
    # Rows are sorted before the draw, as draws go from row to row of a partition.
    rows, before, at = (fresh(docs.columns, name) for name in ("_rows", "_before", "_at"))
    counts = dealt.select(in_bucket.alias(bucket)).groupBy(bucket).agg(F.count(F.lit(1)).alias(rows))
    drawn = (
        _rows_before(counts, bucket, rows, before)
        .repartition(bucket)
        .sortWithinPartitions(bucket)
        .select(bucket, before, F.shuffle(F.sequence(F.lit(0), (F.col(rows) - 1).cast("int")), seed).alias(order))
    )
    return (
        scattered.join(drawn, bucket)
        .withColumn(at, F.col(before) + F.col(order)[F.col(place)])
        .withColumn(shard_column, F.expr(f"CAST((`{at}` * {shards}L) div {max(n, 1)}L AS INT)"))
        .withColumn(slot_column, F.col(at) - F.expr(f"(`{shard_column}` * {n}L + {shards - 1}) div {shards}"))
        .select(*[col(name) for name in docs.columns], shard_column, slot_column)
    )


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder per shard, with files of at most that many records in the order of their slots."""
    part = fresh(sharded.columns, "_part")
    (
        sharded.withColumn(part, F.floor(F.col("slot") / rows_per_file))
        .repartition("shard", part)
        .sortWithinPartitions("shard", "slot")
        .drop(part)
        .write.option("maxRecordsPerFile", rows_per_file)
        .partitionBy("shard")
        .parquet(path)
    )
