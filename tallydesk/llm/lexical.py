"""Ranked lexical search: largest inner products with sparse document vectors, by ball trees.

A document is a sparse vector of whole numbers, one for each term: how much the term counts in it,
less in a longer text. A query is a sparse vector of term weights, and a score their inner product.
Of a batch of queries only the terms that it asks for are looked at, so documents are vectors in the
space of those terms.

Documents are gathered into blocks of bounded size where they lie, and each block becomes a ball
tree: a node has a centre, a radius around it that holds all its documents, and the terms any of
them has. By Cauchy and Schwarz no document of a node scores more than the centre's product plus the
radius times the length of the query, of which only terms of the node count. Centres are rounded to
whole numbers and roots are rounded up, so the bound is exact arithmetic on whole numbers and never
too low. The trees are a table in the shared folder. A first look at one leaf of each tree gives
every query a floor, a score that ten documents are known to reach; then trees are searched
best-first, subtrees below the floor are left out, and what remains is scored exactly at the leaves.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallydesk.llm.common import col, staged, text_or_empty

# Terms are runs of ASCII letters and digits and of all that is not ASCII; A-Z count as a-z.
_FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

# How much a term counts: SCALE * tf div (1000 * tf + 8 * m), where m is 100 for a text of mean length.
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 90


@dataclass(frozen=True)
class Trees:
    """Sizes of trees (documents and entries of a block, documents of a leaf) and of a batch of queries."""

    documents: int = 4096
    entries: int = 1_000_000
    leaf: int = 48
    batch_bytes: int = 4 << 20


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLDED).split() if text else []


# --- documents as vectors -----------------------------------------------------------------------


def _counted(docs: DataFrame, vocabulary: dict[bytes, int], text: str, id_column: str) -> DataFrame:
    """(id, n, terms, tfs) of documents with terms: their number, and those of the vocabulary with counts."""
    slim = docs.select(col(id_column).alias("id"), text_or_empty(text).alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    whole = T.ArrayType(T.IntegerType())
    schema = T.StructType([slim.schema["id"], T.StructField("n", T.LongType()), T.StructField("terms", whole), T.StructField("tfs", whole)])

    def count(batches):
        place = shipped.value.get
        for batch in batches:
            sizes, terms, tfs, ends, rows = [], [], [], [0], []
            for row, value in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = terms_of(value)
                if not words:
                    continue
                known = np.fromiter((p for p in map(place, words) if p is not None), np.int32)
                found, counts = np.unique(known, return_counts=True)
                rows.append(row)
                sizes.append(len(words))
                terms.append(found)
                tfs.append(counts.astype(np.int32))
                ends.append(ends[-1] + len(found))
            bounds, nothing = pa.array(ends, pa.int32()), [np.zeros(0, np.int32)]
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(parts or nothing), pa.int32())) for parts in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=schema.names)

    return slim.mapInArrow(count, schema)


def _length_shares(sizes: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of texts with so many terms; whole numbers of any size while it is worked out."""
    return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * documents // terms for n in sizes.tolist()], np.int64)


def term_weight(documents: int, found_in: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * found_in + 1)))


# --- ball trees ---------------------------------------------------------------------------------


def _rows(indptr: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the entries of some rows, row after row."""
    sizes = indptr[rows + 1] - indptr[rows]
    ends = np.cumsum(sizes)
    return np.repeat(indptr[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def build_tree(indptr: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int, leaf: int) -> dict[str, np.ndarray]:
    """A ball tree over sparse rows. ``order`` deals rows into nodes, whose children split them in two halves."""
    squares = _row_sums(values * values, np.diff(indptr))
    scratch = np.zeros(width, np.int64)
    order = np.arange(len(indptr) - 1)
    nodes: list[tuple[int, int, int, int]] = []  # start, end, left, right
    radii, supports, centres = [], [], []
    todo = [(0, len(order), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        number = len(nodes)
        if parent >= 0:
            s, e, left, right = nodes[parent]
            nodes[parent] = (s, e, number, right) if side == 0 else (s, e, left, number)
        nodes.append((start, end, -1, -1))
        rows = order[start:end]
        at, sizes = _rows(indptr, rows), indptr[rows + 1] - indptr[rows]
        own, given = terms[at], values[at]
        support, inverse = np.unique(own, return_inverse=True)
        centre = np.rint(np.bincount(inverse, weights=given, minlength=len(support)) / len(rows)).astype(np.int64)
        distances = squares[rows] - 2 * _row_sums(given * centre[inverse], sizes) + int((centre * centre).sum())
        radii.append(int(distances.max()))
        supports.append(support.astype(np.int32))
        centres.append(centre)
        if end - start <= leaf or radii[-1] == 0:
            continue
        # The two documents that are far apart; the others by which of them they are nearer to.
        poles = []
        for far in (int(distances.argmax()), None):
            if far is None:
                far = int((squares[rows] - 2 * poles[0][1]).argmax())
            pole = rows[far]
            span = slice(indptr[pole], indptr[pole + 1])
            scratch[terms[span]] = values[span]
            poles.append((pole, _row_sums(given * scratch[own], sizes)))
            scratch[terms[span]] = 0
        lean = (squares[poles[0][0]] - 2 * poles[0][1]) - (squares[poles[1][0]] - 2 * poles[1][1])
        order[start:end] = rows[np.argsort(lean, kind="stable")]
        middle = (start + end) // 2
        todo += [(middle, end, number, 1), (start, middle, number, 0)]
    at = _rows(indptr, order)
    sizes = np.diff(indptr)[order]
    return {
        "order": order,
        "indptr": np.concatenate(([0], np.cumsum(sizes))),
        "terms": terms[at].astype(np.int32),
        "values": values[at].astype(np.int32),
        "nodes": np.array(nodes, np.int32),
        "radii": np.array(radii, np.int64),
        "node_ptr": np.concatenate(([0], np.cumsum([len(s) for s in supports]))),
        "support": np.concatenate(supports),
        "centres": np.concatenate(centres).astype(np.int32),
    }


def _packed(tree: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **tree)
    return out.getvalue()


class TreeSearch:
    """Best-first search of one tree. Queries are (terms, weights), sorted by term."""

    def __init__(self, packed: bytes, width: int):
        with np.load(io.BytesIO(packed)) as read:
            self.tree = dict(read)
        self.dense = np.zeros(width, np.int64)

    def bound(self, node: int, terms: np.ndarray, weights: np.ndarray) -> int:
        """No document of the node scores more."""
        tree = self.tree
        span = slice(tree["node_ptr"][node], tree["node_ptr"][node + 1])
        support = tree["support"][span]
        at = np.minimum(support.searchsorted(terms), len(support) - 1)
        met = support[at] == terms
        if not met.any():
            return 0
        here = weights[met]
        lengths = int((here * here).sum()) * int(tree["radii"][node])
        return int((here * tree["centres"][span][at[met]]).sum()) + (math.isqrt(lengths - 1) + 1 if lengths else 0)

    def scores(self, node: int, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a leaf and their exact scores."""
        tree = self.tree
        start, end = tree["nodes"][node][:2]
        ptr = tree["indptr"][start : end + 1]
        span = slice(ptr[0], ptr[-1])
        self.dense[terms] = weights
        found = _row_sums(self.dense[tree["terms"][span]] * tree["values"][span], np.diff(ptr))
        self.dense[terms] = 0
        return tree["order"][start:end], found

    def first_leaf(self, terms: np.ndarray, weights: np.ndarray) -> int:
        node = 0
        while self.tree["nodes"][node][2] >= 0:
            node = max(self.tree["nodes"][node][2:].tolist(), key=lambda child: self.bound(child, terms, weights))
        return node

    def leaves(self, terms: np.ndarray, weights: np.ndarray, floor):
        """Leaves by falling bound, as long as it is above 0 and at least what ``floor()`` says."""
        heap = [(-self.bound(0, terms, weights), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if bound == 0 or -bound < floor():
                return
            left, right = self.tree["nodes"][node][2:].tolist()
            if left < 0:
                yield node
            else:
                for child in (left, right):
                    heapq.heappush(heap, (-self.bound(child, terms, weights), child))


class Best:
    """The k first of (score, id): higher scores first, then lower ids, null ids last."""

    def __init__(self, k: int, floor: int):
        self.k, self.known, self.kept = k, floor, []

    def floor(self) -> int:
        return max(self.known, -self.kept[-1][0]) if len(self.kept) == self.k else self.known

    def add(self, scores: np.ndarray, rows: np.ndarray, ids: pa.Array) -> None:
        at = np.flatnonzero((scores > 0) & (scores >= self.floor()))
        if len(at):
            values = ids.take(pa.array(rows[at])).to_pylist()
            new = [(-score, value is None, value) for score, value in zip(scores[at].tolist(), values, strict=True)]
            self.kept = sorted(self.kept + new, key=lambda x: x[:2] if x[1] else x)[: self.k]


# --- the search ---------------------------------------------------------------------------------


def _trees(vectors: DataFrame, documents: int, terms: int, width: int, sizes: Trees) -> DataFrame:
    """(ids, tree): a row per block, built of the documents of one partition where they lie."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(vectors.schema["id"].dataType)), T.StructField("tree", T.BinaryType())])

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        lengths = table.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        indptr = np.concatenate(([0], np.cumsum(lengths)))
        own, tfs = (np.concatenate([p.column(c).flatten().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64) for c in ("terms", "tfs"))
        shares = _length_shares(table.column("n").to_numpy(), documents, terms)
        values = SCALE * tfs // (1000 * tfs + SATURATION * np.repeat(shares, lengths))
        tree = _packed(build_tree(indptr, own, values, width, sizes.leaf))
        ids = table.column("id").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([tree], pa.binary())], names=schema.names)

    def gather(batches):
        parts, rows, entries = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                more = len(part.column("terms").flatten())
                if parts and (rows + part.num_rows > sizes.documents or entries + more > sizes.entries):
                    yield block(parts)
                    parts, rows, entries = [], 0, 0
                parts.append(part)
                rows, entries = rows + part.num_rows, entries + more
        if rows:
            yield block(parts)

    return vectors.mapInArrow(gather, schema)


def _searched(index: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], floors: dict[int, int], width: int, k: int, whole: bool) -> DataFrame:
    """(query, id, score): of each task the k best of every query, from one leaf of a tree or from all that can hold them."""
    shipped = index.sparkSession.sparkContext.broadcast((asked, floors))
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("id", index.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])

    def look(batches):
        queries, known = shipped.value
        best = {number: Best(k, known.get(number, 0)) for number, _, _ in queries}
        kind = None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for ids, packed in zip(batch.column("ids"), batch.column("tree"), strict=True):
                tree = TreeSearch(packed.as_py(), width)
                for number, terms, weights in queries:
                    found = best[number]
                    leaves = tree.leaves(terms, weights, found.floor) if whole else [tree.first_leaf(terms, weights)]
                    for leaf in leaves:
                        rows, scores = tree.scores(leaf, terms, weights)
                        found.add(scores, rows, ids.values)
        rows = [(number, value, -score) for number, found in best.items() for score, _, value in found.kept]
        if rows:
            numbers, values, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(values, kind), pa.array(scores, pa.int64())], names=schema.names)

    return index.mapInArrow(look, schema)


def _first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rank_batch(docs: DataFrame, queries: DataFrame, k: int, text: str, id_column: str, sizes: Trees) -> DataFrame | None:
    """(query_id, rank, id, score) of one batch of queries (query_id, query_text), which the driver holds."""
    given = queries.toArrow()
    bags = [set(terms_of(value)) for value in given.column("query_text").cast(pa.binary()).to_pylist()]
    vocabulary = {term: place for place, term in enumerate(sorted(set().union(*bags)))}
    if not vocabulary:
        return None
    counted = staged(_counted(docs, vocabulary, text, id_column), "term_counts")
    documents, terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found_in = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect())
    weights = {place: term_weight(documents, found_in[place]) for place in vocabulary.values() if place in found_in}
    asked = []
    for number, bag in enumerate(bags):
        own = np.array(sorted(vocabulary[term] for term in bag if vocabulary[term] in weights), np.int64)
        if len(own):
            asked.append((number, own, np.array([weights[place] for place in own.tolist()], np.int64)))
    if not asked:
        return None
    width = len(vocabulary)
    index = staged(_trees(counted.filter(F.size("terms") > 0), documents, terms, width, sizes), "trees")
    seen = _first_k(_searched(index, asked, {}, width, k, whole=False), k).filter(F.col("rank") == k)
    floors = dict(seen.select("query", "score").collect())
    best = _first_k(_searched(index, asked, floors, width, k, whole=True), k)
    spark = docs.sparkSession
    kind = queries.schema["query_id"].dataType
    names = spark.createDataFrame(
        list(enumerate(given.column("query_id").to_pylist())), T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", kind)])
    )
    return best.join(F.broadcast(names), "query").select("query_id", "rank", "id", "score")


def rank(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    text: str = "text",
    id_column: str = "doc_id",
    query_text: str = "text",
    query_id: str = "item_id",
    sizes: Trees = Trees(),
) -> DataFrame:
    """(query_id, rank, id_column, score): the k documents with the highest scores above 0 for every query.

    Terms are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. A term that
    ``df`` of N documents have weighs floor(1000 ln((2N+2)/(2df+1))); N counts documents with terms.
    Equal scores go by ascending id, null ids last. Documents that repeat take part as often as they
    stand there; queries equal in id and text are one, and those without terms or with terms that no
    document has find nothing. Null texts have no terms. Queries go in batches whose texts are bounded
    in bytes, as the driver and every task hold one; a batch is one pass over the texts.
    """
    asked = queries.select(col(query_id).alias("query_id"), text_or_empty(query_text).alias("query_text")).distinct()
    total = asked.agg(F.coalesce(F.sum(F.octet_length("query_text")), F.lit(0))).first()[0]
    batches = max(1, -(-total // sizes.batch_bytes))
    if batches > 1:
        asked = staged(asked, "queries")
    dealt = F.pmod(F.xxhash64("query_id", "query_text"), F.lit(batches))
    parts = [asked if batches == 1 else asked.filter(dealt == number) for number in range(batches)]
    found = [answer for part in parts if (answer := _rank_batch(docs, part, k, text, id_column, sizes)) is not None]
    names = [query_id, "rank", id_column, "score"]
    if not found:
        kinds = [asked.schema["query_id"].dataType, T.IntegerType(), docs.select(col(id_column)).schema[0].dataType, T.LongType()]
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField(n, kind) for n, kind in zip(names, kinds, strict=True)]))
    return reduce(DataFrame.unionByName, found).toDF(*names)
