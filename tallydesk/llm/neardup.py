"""Near-duplicate documents by min-max hashing of their word shingles.

Under each random permutation of the shingles both the smallest and the largest value are kept, so
half as many permutations give a signature of the same length (Ji et al., "Min-Max Hash for Jaccard
Similarity", 2013). Signatures are cut into bands; documents that agree in a band meet in a bucket.

Documents with the same set are one class from the start, so exact copies never pair up. In a
bucket not all pairs are formed: every member is compared with the bucket's hub, the member that
meets most others over all buckets, and links join classes to components. Where all members of a
bucket then lie in one component it is done. In the others, members are compared with one more
member drawn for the bucket, and at last with all members of other components, inside a join that
emits only pairs that may link. Every link is confirmed on the whole sets of shingles.

A pair may link unless its set sizes, its bitmaps or its signatures tell otherwise. Each set has a
bitmap with a bit for each shingle; bits that differ stand for shingles that only one set has, so
this bound is exact. So no link between components is lost, however large a bucket is, but for those
that hashing itself misses: a pair of similarity s shares no bucket with probability
(1 - s^rows)^bands, 0.000003 at 0.8.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallydesk.llm.common import col, fresh, row_key, staged
from tallydesk.llm.components import components, with_links
from tallydesk.llm.shingles import WordHashes, shingle_set


@dataclass(frozen=True)
class MinMax:
    """``width`` words a shingle; linked at ``percent`` of similarity; bands of ``rows`` values.

    ``bands * rows`` values need half as many permutations. Four bits of each value make a bit
    sketch; pairs whose sketches differ in more bits than a similarity of ``percent`` explains,
    ``deviations`` standard deviations off, are not looked at further.
    """

    width: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    deviations: float = 4.5
    seed: int = 20130101

    @property
    def values(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """Two of four bits differ, with a variance of one, where values do."""
        apart = 1 - self.percent / 100
        return int(self.values * 2 * apart + self.deviations * (self.values * (5 * apart - 4 * apart**2)) ** 0.5)


_SHINGLES_AT_ONCE = 4096
_BITMAP_LONGS = 64

_SIGNED = "id {kind}, text_hash long, hi long, lo long, n_shingles long, bands array<long>, bits array<long>, bitmap array<long>"


def signatures(docs: DataFrame, how: MinMax, id_column: str, text: str) -> DataFrame:
    """(id, text_hash, hi, lo, n_shingles, bands, bits): set fingerprint, set size, band keys, bit sketch, bitmap."""
    half = how.values // 2
    draw = np.random.default_rng(how.seed)
    factors = draw.integers(0, 1 << 63, half, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 63, half, np.uint64)[:, None]
    factors = factors[:, None]

    def signature(values: np.ndarray) -> np.ndarray:
        least = np.full(half, np.iinfo(np.uint64).max, np.uint64)
        most = np.zeros(half, np.uint64)
        for start in range(0, len(values), _SHINGLES_AT_ONCE):
            permuted = factors * values[start : start + _SHINGLES_AT_ONCE]
            permuted += shifts
            np.minimum(least, permuted.min(axis=1), out=least)
            np.maximum(most, permuted.max(axis=1), out=most)
        return np.concatenate([least, most])

    def sign(batches):
        known = WordHashes()
        for batch in batches:
            prints, sizes, keys, bits, bitmaps = [], [], [], [], []
            for text_bytes in batch.column(2).cast(pa.binary()).to_pylist():
                values = known.shingles(text_bytes, how.width)
                sizes.append(len(values))
                prints.append(np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), np.int64))
                if not len(values):
                    keys.append([])
                    bits.append([])
                    bitmaps.append([])
                    continue
                signed = signature(values)
                rows = signed.reshape(how.bands, how.rows)
                keys.append([xxhash.xxh3_64_intdigest(row.tobytes(), n) - (1 << 63) for n, row in enumerate(rows)])
                nibbles = ((signed >> np.uint64(24)) & np.uint64(15)).astype(np.uint8)
                nibbles = np.pad(nibbles, (0, -len(nibbles) % 16))
                bits.append((nibbles[::2] << 4 | nibbles[1::2]).view(np.int64))
                present = np.zeros(64 * _BITMAP_LONGS, bool)
                present[(values >> np.uint64(20)) % np.uint64(len(present))] = True
                bitmaps.append(np.packbits(present).view(np.int64))
            marks = np.array(prints).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(marks[:, 0]),
                    pa.array(marks[:, 1]),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(bits, pa.list_(pa.int64())),
                    pa.array(bitmaps, pa.list_(pa.int64())),
                ],
                names=["id", "text_hash", "hi", "lo", "n_shingles", "bands", "bits", "bitmap"],
            )

    slim = docs.select(col(id_column).alias("id"), row_key(text).alias("text_hash"), col(text).alias("text"))
    return slim.mapInArrow(sign, _SIGNED.format(kind=slim.schema["id"].dataType.simpleString()))


def _may_link(how: MinMax, one: str, other: str) -> Column:
    """Whether sizes, bitmaps and bit sketches of two sides leave room for the similarity."""

    def differ(name: str, longs: int) -> Column:
        pairs = [F.col(f"{one}.{name}")[i].bitwiseXOR(F.col(f"{other}.{name}")[i]) for i in range(longs)]
        return reduce(lambda a, b: a + b, map(F.bit_count, pairs))

    n, m = F.col(f"{one}.n_shingles"), F.col(f"{other}.n_shingles")
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * how.percent
    # Sets of similarity s differ in (1 - s) / (1 + s) of the sum of their sizes.
    alone = differ("bitmap", _BITMAP_LONGS) * (100 + how.percent) <= (n + m) * (100 - how.percent)
    return sizes & (differ("bits", -(-how.values // 16)) <= how.most_bits) & alone


def _likely(pairs: DataFrame, marks: DataFrame, how: MinMax) -> DataFrame:
    """The (u, v) of ``pairs`` that may link."""
    left = pairs.join(marks.alias("l"), F.col("u") == F.col("l.node"))
    both = left.join(marks.alias("r"), (F.col("v") == F.col("r.node")) & _may_link(how, "l", "r"))
    return staged(both.select("u", "v"), "pairs")


def _confirmed(pairs: DataFrame, texts: DataFrame, how: MinMax) -> DataFrame:
    """The (u, v) of ``pairs`` that reach the similarity on their whole sets."""
    full = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(
        texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v"
    )

    def confirm(batches):
        for batch in batches:
            us, vs, tus, tvs = (batch.column(batch.schema.names.index(c)) for c in ("u", "v", "tu", "tv"))
            last, last_set, linked = None, set(), []
            for v, tu, tv in zip(vs.to_pylist(), tus.cast(pa.binary()).to_pylist(), tvs.cast(pa.binary()).to_pylist(), strict=True):
                a = shingle_set(tu, how.width)
                if v != last:
                    last, last_set = v, shingle_set(tv, how.width)
                shared = len(a & last_set)
                linked.append(100 * shared >= how.percent * (len(a) + len(last_set) - shared))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([us.filter(keep), vs.filter(keep)], names=["u", "v"])

    kind = full.schema["u"].dataType.simpleString()
    return full.select("u", "v", "tu", "tv").mapInArrow(confirm, f"u {kind}, v {kind}")


def _ordered(u, v) -> list:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def _apart(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, component) of the buckets whose members lie in several components."""
    placed = buckets.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return staged(placed.join(several.filter("least < most"), "key", "left_semi"), "apart")


def _same_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of each id that has several."""
    with_id = signed.filter("n_shingles > 0 AND id IS NOT NULL").select("id", "hi", "lo")
    marks = [reach(name).alias(f"{reach.__name__}_{name}") for name in ("hi", "lo") for reach in (F.min, F.max)]
    several = with_id.groupBy("id").agg(*marks).filter("min_hi < max_hi OR min_lo < max_lo")
    members = with_id.join(several.select("id"), "id", "left_semi").distinct()
    members = staged(members.join(classes.select("hi", "lo", "node"), ["hi", "lo"]).select("id", "node"), "same_ids")
    least = members.groupBy("id").agg(F.min("node").alias("least"))
    return members.join(least, "id").filter("node <> least").select(*_ordered("node", "least"))


def _drawn_links(apart: DataFrame, marks: DataFrame, texts: DataFrame, how: MinMax) -> DataFrame:
    """Links of members that are apart with one member drawn for their bucket."""
    drawn = apart.groupBy("key").agg(F.max_by(F.struct("node", "component"), F.xxhash64("key", "node")).alias("other"))
    pairs = (
        apart.join(drawn, "key")
        .filter("component <> other.component")
        .select(*_ordered(F.col("node"), F.col("other.node")))
        .distinct()
    )
    return staged(_confirmed(_likely(pairs, marks, how), texts, how), "links")


def _rest_of_links(apart: DataFrame, marks: DataFrame, texts: DataFrame, how: MinMax) -> DataFrame:
    """Links of members that are still apart: only pairs that may link leave the join."""
    marked = apart.join(marks, "node")
    same_bucket = (F.col("l.key") == F.col("r.key")) & (F.col("l.node") > F.col("r.node"))
    rest = marked.alias("l").join(
        marked.alias("r"), same_bucket & (F.col("l.component") != F.col("r.component")) & _may_link(how, "l", "r")
    )
    rest = rest.select(F.col("l.node").alias("u"), F.col("r.node").alias("v")).distinct()
    return staged(_confirmed(rest, texts, how), "links")


def near_duplicates(
    docs: DataFrame, how: MinMax = MinMax(), id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id_column, n_shingles, component_id, kept, text_hash), a row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links. A document without words has an empty
    set, is linked with nothing and stays. Rows that share an id count as one document, with links
    from each of its texts. Rows with a null id take part like others; as a null id can't be pointed
    to, a component without any id has a null ``component_id``, and the rows of one of its texts
    stay. Empty tables give no rows.
    """
    # Classes are told apart by the number of a row of theirs: ids may be null, or have several texts.
    signed = staged(signatures(docs, how, id_column, text).withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = signed.filter("n_shingles > 0").groupBy("hi", "lo")
    classes = classes.agg(F.min("row").alias("node"), F.min("id").alias("least_id"), F.min_by("text_hash", "row").alias("first_text"))
    classes = staged(classes, "classes")
    nodes = signed.withColumnRenamed("row", "node").join(classes.select("node"), "node", "left_semi")
    nodes = staged(nodes, "nodes")

    # Buckets with several members; the hub of each is the member that meets most others.
    banded = nodes.select("node", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    buckets = staged(banded.join(crowded, "key"), "buckets")
    met = buckets.groupBy("node").agg(F.sum("members").alias("met"))
    marks = staged(nodes.select("node", "n_shingles", "bits", "bitmap").join(met.select("node"), "node", "left_semi"), "marks")
    key = ["id_key", "text_hash"]
    wanted = nodes.join(met.select("node"), "node", "left_semi").select("node", row_key("id").alias("id_key"), "text_hash")
    texts = docs.select(row_key(id_column).alias("id_key"), row_key(text).alias("text_hash"), col(text).alias("text"))
    texts = staged(texts.join(wanted, key).dropDuplicates([*key, "node"]).select("node", "text"), "texts")

    hubs = buckets.join(met, "node").groupBy("key").agg(
        F.max_by("node", F.struct("met", -F.col("node"))).alias("hub")
    )
    pairs = buckets.join(hubs, "key").filter("node <> hub").select(*_ordered("node", "hub")).distinct()
    links = _confirmed(_likely(pairs, marks, how), texts, how).unionByName(_same_ids(signed, classes))
    links = staged(links, "links")

    # Later steps only run on what earlier ones leave: the driver holds the plan of every one.
    found = components(links)
    apart = _apart(buckets, found)
    if not apart.isEmpty():
        more = _drawn_links(apart, marks, texts, how)
        if not more.isEmpty():
            found = with_links(found, more)
            apart = _apart(apart.drop("component"), found)
        last = _rest_of_links(apart, marks, texts, how)
        if not last.isEmpty():
            found = with_links(found, last)

    groups = found.join(classes, "node").groupBy("component")
    groups = groups.agg(F.min("least_id").alias("group_id"), F.min_by("first_text", "node").alias("group_text"))
    linked = found.join(groups, "component").select("node", "group_id", "group_text")
    named = classes.join(linked, "node", "left").select(
        "hi",
        "lo",
        F.when(F.col("group_text").isNull(), F.col("least_id")).otherwise(F.col("group_id")).alias("component"),
        F.coalesce("group_text", "first_text").alias("stays"),
    )
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    kept = F.when(component.isNull(), F.coalesce(F.col("text_hash") == F.col("stays"), F.lit(True)))
    return (
        signed.select("id", "hi", "lo", "n_shingles", "text_hash")
        .join(named, ["hi", "lo"], "left")
        .select(
            F.col("id").alias(id_column),
            "n_shingles",
            component.alias("component_id"),
            "text_hash",
            kept.otherwise(F.coalesce(F.col("id") == component, F.lit(False))).alias("kept"),
        )
    )


def keep_one(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``found`` (of ``near_duplicates``) keeps; of rows with equal id and text one."""
    id_key, text_key, number = (fresh(docs.columns, name) for name in ("_id_key", "_text_key", "_number"))
    kept = found.filter("kept").select(row_key(id_column).alias(id_key), F.col("text_hash").alias(text_key)).distinct()
    values = [name for name, kind in docs.dtypes if "map" not in kind and "variant" not in kind]
    repeats = Window.partitionBy(id_key, text_key).orderBy(row_key(*values))
    return (
        docs.withColumn(id_key, row_key(id_column))
        .withColumn(text_key, row_key(text))
        .join(kept, [id_key, text_key], "left_semi")
        .withColumn(number, F.row_number().over(repeats))
        .filter(F.col(number) == 1)
        .select(*[col(name) for name in docs.columns])
    )
