"""Lines that many documents share, told as one compressed bitmap a document.

Every document gives one record per distinct line key: a 128-bit hash of the key and the places of
its lines. Records are range-partitioned by hash, then document, then place, and sorted so within
a partition; a hash that holds a large share of all lines is cut into as many ranges as any other
rows. Sorted records are streamed: a run of one hash that begins and ends inside a batch is decided
on the spot. Only runs that touch the edge of a batch wait for a count over all batches. What comes
back per document is a bitmap of the lines to keep; no text is moved.

A document is told by its id and its text. Rows that repeat in both are one document: they count
once and have one bitmap. Null ids are ids like any other. A null or empty text is one empty line.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallydesk.llm.common import col, staged, text_or_empty

DROPPED, OPEN = 1, 0


@dataclass(frozen=True)
class LineRule:
    """Which lines go: those whose key is found in ``documents`` documents and has ``characters`` code points.

    With ``keep_first`` the first line of such a key, by document id and place, stays.
    """

    documents: int = 10
    characters: int = 1
    keep_first: bool = False


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def _text_key(text: str) -> Column:
    return F.xxhash64(text_or_empty(text))


def _records_of(texts: list[bytes | None], characters: int):
    """Per text its number of lines, and its keys as (text number, hash, places)."""
    counts, owners, hashes, places = [], [], [], []
    for n, text in enumerate(texts):
        lines = _lines(text)
        counts.append(len(lines))
        found: dict[bytes, list[int]] = {}
        for place, line in enumerate(lines):
            key = line_key(line)
            if key and (characters <= 1 or len(key.decode()) >= characters):
                found.setdefault(key, []).append(place)
        owners += [n] * len(found)
        hashes += map(xxhash.xxh3_128_digest, found)
        places += found.values()
    return counts, owners, hashes, places


def _line_records(docs: DataFrame, text: str, id_column: str, rule: LineRule) -> DataFrame:
    """(hi, lo, id, text_key, places, n_lines): one row per document and key; without hash, one per document."""
    slim = docs.select(col(id_column).alias("id"), _text_key(text).alias("text_key"), text_or_empty(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("hi", T.LongType()),
            T.StructField("lo", T.LongType()),
            T.StructField("id", slim.schema["id"].dataType),
            T.StructField("text_key", T.LongType()),
            T.StructField("places", T.ArrayType(T.IntegerType())),
            T.StructField("n_lines", T.IntegerType()),
        ]
    )

    def read(batches):
        seen = set()  # of this task: rows that repeat are sent once
        for whole in batches:
            own = list(zip(whole.column("id").to_pylist(), whole.column("text_key").to_pylist(), strict=True))
            new = [n for n, key in enumerate(own) if not (key in seen or seen.add(key))]
            for start in range(0, len(new), 512):
                batch = whole.take(pa.array(new[start : start + 512]))
                counts, owners, hashes, places = _records_of(batch.column("text").cast(pa.binary()).to_pylist(), rule.characters)
                halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                sizes = np.cumsum([0, *map(len, places)])
                flat = np.fromiter((p for some in places for p in some), np.int32, int(sizes[-1]))
                rows, all_rows = pa.array(owners, pa.int64()), batch.num_rows
                keys = [
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    batch.column("id").take(rows),
                    batch.column("text_key").take(rows),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)),
                    pa.nulls(len(owners), pa.int32()),
                ]
                nothing = pa.nulls(all_rows, pa.int64())
                heads = [nothing, nothing, batch.column("id"), batch.column("text_key"), pa.nulls(all_rows, keys[4].type), pa.array(counts, pa.int32())]
                yield pa.RecordBatch.from_arrays(heads, names=schema.names)
                yield pa.RecordBatch.from_arrays(keys, names=schema.names)

    return slim.mapInArrow(read, schema)


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it; the first one does."""
    size = len(columns[0])
    changed = np.zeros(size, bool)
    changed[:1] = True
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        changed[1:] |= codes[1:] != codes[:-1]
    return changed


def _decide(batch: pa.RecordBatch, rule: LineRule) -> pa.Table:
    """The rows of a sorted batch that are dropped, and those of its first and last run, which stay open."""
    new_key = _changes([batch.column("hi"), batch.column("lo")])
    new_document = new_key | _changes([batch.column("id"), batch.column("text_key")])
    run = np.cumsum(new_key) - 1
    documents = np.bincount(run, weights=new_document).astype(np.int64)
    common = (documents >= rule.documents)[run]
    edge = (run == 0) | (run == run[-1])
    dropped = common & ~edge
    first = new_key & dropped if rule.keep_first else np.zeros(len(run), bool)
    places = batch.column("places")
    sizes = places.value_lengths().to_numpy(zero_copy_only=False)
    state = np.where(edge, OPEN, DROPPED).astype(np.int32)
    out = pa.table({name: batch.column(name) for name in ("hi", "lo", "id", "text_key", "places")})
    out = out.append_column("state", pa.array(state)).append_column("spared", pa.array(first.astype(np.int32)))
    return out.filter(pa.array((dropped & ~(first & (sizes == 1))) | edge))


def _dropped_lines(records: DataFrame, rule: LineRule) -> DataFrame:
    """(id, text_key, places) of dropped lines; a row per document and key."""
    order = ["hi", "lo", "id", "text_key"]
    ranges = records.select(*order, "places").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*ranges.schema.fields, T.StructField("state", T.IntegerType()), T.StructField("spared", T.IntegerType())])

    def stream(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _decide(batch, rule).to_batches()

    marks = staged(ranges.mapInArrow(stream, schema), "line_marks")
    waiting = marks.filter(F.col("state") == OPEN)
    # Rows that repeat count once; sums are made on the map side, so that a hot hash is no hot task.
    per_document = waiting.groupBy(*order).agg(F.count(F.lit(1)).alias("n"))
    per_key = per_document.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("documents"), F.min(F.struct("id", "text_key")).alias("first"))
    common = staged(per_key.filter(F.col("documents") >= rule.documents).select("hi", "lo", "first"), "common_lines")
    late = waiting.join(common, ["hi", "lo"])
    is_first = F.struct("id", "text_key").eqNullSafe(F.col("first")) if rule.keep_first else F.lit(False)
    late = late.withColumn("spared", is_first.cast("int")).drop("first")
    dropped = marks.filter(F.col("state") == DROPPED).unionByName(late)
    later = F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0)))
    return dropped.select("id", "text_key", F.when(F.col("spared") == 1, later).otherwise(F.col("places")).alias("places"))


def pack_bits(keep: np.ndarray) -> bytes:
    """A keep bitmap: a bit a line, first line lowest, compressed."""
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def unpack_bits(packed: bytes, lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=lines, bitorder="little").astype(bool)


def keep_bitmaps(docs: DataFrame, rule: LineRule = LineRule(), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id_column, text_key, n_lines, n_dropped, keep): a row per document, with the bitmap of the lines to keep.

    Lines are split at line feeds; the key of a line is the line without ASCII white space at its
    ends and with A-Z lower-cased. Empty keys are never dropped. Other columns play no part. A table
    without rows gives none.
    """
    records = staged(_line_records(docs, text, id_column, rule), "line_records")
    dropped = _dropped_lines(records.filter("hi IS NOT NULL"), rule)
    heads = records.filter("hi IS NULL").select("id", "text_key", "n_lines", F.lit(None).cast("array<int>").alias("places"))
    lists = heads.unionByName(dropped.withColumn("n_lines", F.lit(None).cast("int")))
    # Only the lines of one document come together here.
    whole = lists.groupBy("id", "text_key").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("places")).alias("places"))
    schema = T.StructType(
        [
            T.StructField("id", whole.schema["id"].dataType),
            T.StructField("text_key", T.LongType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("keep", T.BinaryType()),
        ]
    )

    def pack(batches):
        for batch in batches:
            sizes, packed, dropped = batch.column("n_lines").to_pylist(), [], []
            for lines, places in zip(sizes, batch.column("places"), strict=True):
                keep = np.ones(lines, bool)
                keep[places.values.to_numpy(zero_copy_only=False)] = False
                packed.append(pack_bits(keep))
                dropped.append(lines - int(keep.sum()))
            columns = [batch.column("id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return whole.mapInArrow(pack, schema).withColumnRenamed("id", id_column)


def kept_text(docs: DataFrame, bitmaps: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Every row of the documents with ``n_lines``, ``n_dropped`` and ``kept``, its kept lines joined by line feeds.

    Columns that are called so already are replaced; a text whose lines all go is empty.
    """
    added = ("n_lines", "n_dropped", "kept")
    names = [name for name in docs.columns if name.lower() not in added]
    plain = [f"c{n}" for n in range(len(names))]
    slim = docs.select(*[col(name).alias(new) for name, new in zip(names, plain, strict=True)], text_or_empty(text).alias("_text"), _text_key(text).alias("_key"))
    own = plain[names.index(id_column)]
    marks = bitmaps.select(col(id_column).alias("_id"), F.col("text_key").alias("_of"), "n_lines", "n_dropped", "keep")
    # A bitmap is small next to its text: it is the side that is held while texts stream by.
    met = slim.join(marks.hint("shuffle_hash"), F.col(own).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")), "left")
    met = met.select(*plain, "n_lines", "n_dropped", "keep", "_text")
    schema = T.StructType([*[met.schema[c] for c in plain], met.schema["n_lines"], met.schema["n_dropped"], T.StructField("kept", T.StringType())])

    def apply(batches):
        for batch in batches:
            kept = []
            columns = (batch.column(c).to_pylist() for c in ("n_lines", "n_dropped", "keep"))
            for whole, lines, dropped, packed in zip(batch.column("_text").cast(pa.binary()).to_pylist(), *columns, strict=True):
                if dropped:
                    keep = unpack_bits(packed, lines)
                    whole = b"\n".join(line for line, stays in zip(_lines(whole), keep.tolist(), strict=True) if stays)
                kept.append(whole)
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names[:-1]], texts], names=schema.names)

    return met.mapInArrow(apply, schema).toDF(*names, *added)
