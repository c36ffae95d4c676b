"""Bounded samples of labelled rows for the models that are fitted on the driver."""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallydesk.llm.common import col, row_key

# So fine that the share of any table's rows is met.
_GRAINS = 1 << 40


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def class_counts(rows: DataFrame, label: str) -> dict:
    """Rows per label, over all of them; null labels are left out."""
    counted = rows.filter(col(label).isNotNull()).groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return {row["label"]: row["n"] for row in counted.collect()}


def _share(label: str, per_class: int, counts: dict) -> Column:
    """The grains to draw of each label, so that about ``per_class`` rows come."""
    shares = [F.when(col(label) == F.lit(name), F.lit(min(_GRAINS, -(-_GRAINS * per_class // n)))) for name, n in counts.items()]
    return reduce(lambda a, b: F.coalesce(a, b), shares)


def sampled(rows: DataFrame, label: str, text: str, per_class: int, counts: dict, longest_bytes: int) -> list[tuple]:
    """(text, label) of about ``per_class`` rows of each label, drawn by a hash of the row's values.

    All rows of a label with fewer. Rows that repeat in all columns count once; null texts and
    labels and texts of more than ``longest_bytes`` are left out, so that the driver holds
    ``per_class`` times ``longest_bytes`` of a label at most.
    """
    if not counts:
        return []
    plain = [c for c, kind in rows.dtypes if kind in ("bigint", "int", "string")]
    key = row_key(*plain)
    drawn = rows.filter((F.octet_length(col(text)) <= longest_bytes) & (F.pmod(key, F.lit(_GRAINS)) < _share(label, per_class, counts)))
    once = drawn.select(key.alias("key"), col(text).alias("text"), col(label).alias("label")).groupBy("key", "label")
    return _in_order(once.agg(F.max("text").alias("text")))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, text: str, id_column: str, per_class: int, counts: dict, longest_bytes: int
) -> list[tuple]:
    """The same where labels are a table of their own.

    The draw is made on the labels, so that what is broadcast to the documents is bounded by
    ``per_class``, and no text is shuffled but those drawn.
    """
    if not counts:
        return []
    drawn = labels.filter(F.pmod(row_key(id_column, label), F.lit(_GRAINS)) < _share(label, per_class, counts))
    drawn = drawn.select(col(id_column).alias("id"), col(label).alias("label")).distinct()
    texts = docs.select(col(id_column).alias("id"), col(text).alias("text")).filter(F.octet_length("text") <= longest_bytes)
    return _in_order(texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.max("text").alias("text")))


def _in_order(drawn: DataFrame) -> list[tuple]:
    table = drawn.select("text", "label").toArrow()
    pairs = zip(table.column("text").to_pylist(), table.column("label").to_pylist(), strict=True)
    return sorted(pairs, key=lambda pair: (xxhash.xxh3_64_intdigest(pair[0]), str(pair[1])))
