"""Documents that hold benchmark items, found by size-partitioned MinHash containment search.

An item is short and a document may be long, so their Jaccard similarity tells nothing; what counts
is the share of the item's word shingles that the document holds. Items are partitioned by size. Of
each item the shingles with the smallest hashes are its MinHash sketch, and its partition says how
many are needed: an item of up to u shingles that a document holds to a share of t lacks at most
(1 - t) * u of them, so of one shingle more than that at least one is in the document. Documents
look their shingles up among the sketches, only documents large enough for the item's partition are
candidates, and each candidate is verified on the whole sets of shingles. No such pair is missed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallydesk.llm.common import col, staged, worked_out

# Sketches or items of this many bytes at most are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Containment:
    """``width`` words a shingle; a document holds an item that it shares ``percent`` of the shingles with."""

    width: int = 5
    percent: int = 80


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(found: Column, width: int, of) -> Column:
    """``of`` each run of ``width`` words; a shorter text is one run, an empty one has none."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(found) - (width - 1), F.lit(1)))
    return F.when(F.size(found) > 0, F.transform(starts, lambda i: of(F.slice(found, i, width))))


def _text_of(run: Column) -> Column:
    return F.array_join(run, " ")


def _small(df: DataFrame, size: Column) -> DataFrame:
    """Mark a table for broadcast if its measured size allows it."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def item_sets(items: DataFrame, how: Containment, item_id: str, text: str) -> DataFrame:
    """(item_id, shingles, n, partition): the distinct shingles of each item with words."""
    return (
        worked_out(items.select(col(item_id).alias("item_id"), col(text).alias("text")), "words", words(F.col("text")))
        .select("item_id", F.array_distinct(_shingles(F.col("words"), how.width, _text_of)).alias("shingles"))
        .filter("shingles IS NOT NULL")
        .distinct()
        .withColumn("n", F.size("shingles"))
        .withColumn("partition", F.floor(F.log2("n")).cast("int"))
    )


def sketches(sets: DataFrame, how: Containment) -> DataFrame:
    """(item, hash, least): the smallest hashes of each item, as many as its partition needs.

    ``least`` is the number of shingles that a document needs to hold any item of the partition.
    """
    smallest = F.pow(F.lit(2), F.col("partition"))
    largest = smallest * 2 - 1
    needed = F.floor(largest * (100 - how.percent) / 100).cast("int") + 1
    hashes = F.array_sort(F.transform("shingles", lambda run: F.xxhash64(F.split(run, " "))))
    return sets.select(
        "item",
        F.ceil(smallest * how.percent / 100).alias("least"),
        F.explode(F.slice(hashes, F.lit(1), needed)).alias("hash"),
    )


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    how: Containment = Containment(),
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id_column, item_id, n_item, n_shared, containment, text_hash): a row per document and item it holds.

    Texts without words, null ones too, hold nothing and are held by nothing; a text of fewer words
    than a shingle is one shingle. Rows with the same id and text give one row; a null id is kept as
    it is. Items with the same id and shingles count once.
    """
    sets = staged(item_sets(items, how, item_id, item_text).withColumn("item", F.monotonically_increasing_id()), "items")
    sketch = staged(sketches(sets, how), "sketches")
    key = [col(id_column).alias("id"), F.xxhash64(col(text)).alias("text_hash")]
    probes = (
        worked_out(docs.select(*key, col(text).alias("text")), "words", words(F.col("text")))
        .select("id", "text_hash", F.size("words").alias("size"), _shingles(F.col("words"), how.width, F.xxhash64).alias("hashes"))
        .select("id", "text_hash", "size", F.explode("hashes").alias("hash"))
    )
    candidates = staged(
        probes.join(_small(sketch, F.lit(24)), "hash")
        .filter(F.greatest(F.col("size") - (how.width - 1), F.lit(1)) >= F.col("least"))
        .select("id", "text_hash", "item")
        .distinct(),
        "candidates",
    )
    held = F.size(F.array_intersect("shingles", F.array_distinct(_shingles(F.col("words"), how.width, _text_of))))
    found = docs.select(*key, col(text).alias("text"))
    found = found.join(
        candidates.withColumnsRenamed({"id": "c_id", "text_hash": "c_hash"}),
        found["id"].eqNullSafe(F.col("c_id")) & (found["text_hash"] == F.col("c_hash")),
    )
    return (
        worked_out(found, "words", words(F.col("text")))
        .select("id", "text_hash", "item", "words")
        .join(_small(sets.select("item", "item_id", "shingles", "n"), F.length(F.to_json(F.struct("shingles")))), "item")
        .select("id", "text_hash", "item", "item_id", F.col("n").alias("n_item"), held.alias("n_shared"))
        .filter(F.col("n_shared") * 100 >= F.col("n_item") * how.percent)
        .dropDuplicates(["id", "text_hash", "item"])
        .select(
            F.col("id").alias(id_column),
            "item_id",
            F.col("n_item").cast("long").alias("n_item"),
            F.col("n_shared").cast("long").alias("n_shared"),
            (F.col("n_shared") / F.col("n_item")).alias("containment"),
            "text_hash",
        )
    )


def without_contaminated(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold none of the items in ``found``."""
    marks = found.select(col(id_column).alias("_held_id"), F.col("text_hash").alias("_held_hash")).distinct()
    same = docs[id_column].eqNullSafe(marks["_held_id"]) & (F.xxhash64(docs[text]) == marks["_held_hash"])
    return docs.join(marks, same, "left_anti")
