"""Exact search for the largest inner products, by buckets of vectors of similar length.

After LEMP (Teflioudi et al., "Fast Retrieval of Large Entries in a Matrix Product", 2015). Vectors
are grouped by length. What a query must reach, divided by its own length and by the largest length
of a bucket, is the cosine that a vector of this bucket has to have, so each bucket has a threshold
of its own. Above one, the bucket is left out. If it is high, vectors are pruned by the query's
largest coordinates: a unit vector p with cosine c to the unit query q has each p_f within
sqrt(1 - c^2) * sqrt(1 - q_f^2) of c * q_f. If it is low, that would prune little, and vectors are
pruned by their own lengths. What is left is verified by whole products.

Queries and vectors are cut into blocks of bounded size and meet in a grid, each cell a task's work.
What a query must reach comes from a first round over the block of the longest vectors, and grows as
a cell goes through its buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallydesk.llm.common import col, staged


@dataclass(frozen=True)
class Blocks:
    """Rows of a block of vectors, of a block of queries, and of a bucket in a block.

    ``coordinate_cosine`` is the local threshold from which coordinates prune, on ``coordinates`` of them.
    """

    vectors: int = 16_384
    queries: int = 1_024
    bucket: int = 1_024
    coordinate_cosine: float = 0.5
    coordinates: int = 3


def whole_numbers(vectors: DataFrame, scale: int, id_column: str, vector: str) -> DataFrame:
    """(id, x, dim, norm2): floor(scale * component); without vectors that are null or hold a null or
    a component that is not finite. One whose multiple does not fit 64 bits is an error."""

    def whole(value: Column) -> Column:
        multiple = value.cast("double") * scale
        message = F.lit("a component times the scale does not fit 64 bits")
        return F.when(F.abs(multiple) < 2.0**63, F.floor(multiple)).otherwise(F.raise_error(message).cast("long"))

    x = F.transform(col(vector), whole)
    finite = F.forall(
        col(vector),
        lambda value: value.isNotNull() & ~F.isnan(value) & (F.abs(value.cast("double")) < float("inf")),
    )
    return (
        vectors.filter(col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(col(id_column).alias("id"), x.alias("x"))
        .withColumn("dim", F.size("x"))
        .withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda total, value: total + value.cast("double") * value))
    )


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim).astype(np.float64)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers: as floats where no sum can pass 2^53, as 64 bits where none can
    pass 2^62, else as Python numbers, of which one that does not fit 64 bits is an error."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(queries.shape[1], 1)
    if most < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    if most < 2.0**62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    return (queries.astype(np.int64).astype(object) @ vectors.astype(np.int64).T.astype(object)).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _search_cell(queries: pa.Table, vectors: pa.Table, k: int, blocks: Blocks) -> pa.Table:
    """The best k of one block of vectors for each query of one block."""
    dim = queries.column("dim")[0].as_py()
    q_ids, q = queries.column("id").to_numpy(), _matrix(queries.column("x"), dim)
    reach = queries.column("reach").to_numpy(zero_copy_only=False).astype(np.float64)  # NaN: not known yet
    order = np.argsort(-vectors.column("norm2").to_numpy(), kind="stable")
    v_ids, v = vectors.column("id").to_numpy()[order], _matrix(vectors.column("x"), dim)[order]
    v_len = np.sqrt(vectors.column("norm2").to_numpy()[order])
    q_len = np.sqrt((q * q).sum(axis=1))
    unit = v / np.where(v_len > 0, v_len, 1)[:, None]
    found_ids = [np.zeros(0, np.int64)] * len(q_ids)
    found_scores = [np.zeros(0, np.int64)] * len(q_ids)
    for start in range(0, len(v_ids), blocks.bucket):
        part = slice(start, start + blocks.bucket)
        longest = v_len[start]
        with np.errstate(divide="ignore", invalid="ignore"):
            # The local threshold, a little lower for rounding; below -1 where nothing is known.
            cosine = np.where(np.isnan(reach), -2.0, reach / (q_len * longest) - 1e-9)
        cosine = np.where(q_len * longest > 0, cosine, np.where(reach > 0, 2.0, -2.0))
        by_length = np.flatnonzero(cosine < blocks.coordinate_cosine)
        by_coordinate = np.flatnonzero((cosine >= blocks.coordinate_cosine) & (cosine <= 1))
        work = []
        if len(by_length):
            # Vectors come by falling length: one that is too short for every query ends the bucket.
            needed = np.where(reach[by_length] > 0, reach[by_length] / np.maximum(q_len[by_length], 1e-300), -1)
            least = np.nanmin(np.where(np.isnan(needed), -1, needed), initial=np.inf)
            tall = int(np.searchsorted(-v_len[part], -(least * (1 - 1e-9) - 1e-9), side="right"))
            scores = _products(q[by_length], v[start : start + tall])
            work += [(n, np.arange(start, start + tall), scores[at]) for at, n in enumerate(by_length)]
        for n in by_coordinate:
            unit_q, c = q[n] / q_len[n], cosine[n]
            keep = np.ones(len(v_ids[part]), bool)
            for f in np.argsort(-np.abs(unit_q))[: blocks.coordinates]:
                slack = np.sqrt(max(0.0, 1 - c * c)) * np.sqrt(max(0.0, 1 - unit_q[f] ** 2)) + 1e-9
                # A larger cosine only narrows what is allowed on the far side of c * q_f.
                side = unit[part, f] * np.sign(unit_q[f])
                keep &= side >= c * abs(unit_q[f]) - slack
                if abs(unit_q[f]) <= c:
                    keep &= side <= c * abs(unit_q[f]) + slack
            rows = start + np.flatnonzero(keep)
            if len(rows):
                work.append((n, rows, _products(q[n : n + 1], v[rows])[0]))
        for n, rows, scores in work:
            other = v_ids[rows] != q_ids[n]
            ids = np.concatenate([found_ids[n], v_ids[rows][other]])
            total = np.concatenate([found_scores[n], scores[other]])
            top = _best(ids, total, k)
            found_ids[n], found_scores[n] = ids[top], total[top]
            if len(top) == k:
                reach[n] = np.fmax(reach[n], total[top][-1])
    sizes = [len(ids) for ids in found_ids]
    return pa.table(
        {
            "query_id": pa.array(np.repeat(q_ids, sizes)),
            "vec_id": pa.array(np.concatenate(found_ids)),
            "score": pa.array(np.concatenate(found_scores)),
        }
    )


def _searched(queries: DataFrame, vectors: DataFrame, k: int, blocks: Blocks) -> DataFrame:
    """Each cell (dim, query_block, vector_block) of two sides that have these columns."""
    cell = ["dim", "query_block", "vector_block"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        return _search_cell(left, right, k, blocks)

    # Names of their own tell the two sides apart where both come from one table.
    queries = queries.select(*[F.col(name).alias(name) for name in queries.columns])
    return queries.groupBy(*cell).cogroup(vectors.groupBy(*cell)).applyInArrow(
        search, "query_id long, vec_id long, score long"
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_products(
    vectors: DataFrame,
    query_every: int = 50,
    k: int = 5,
    scale: int = 256,
    id_column: str = "vec_id",
    vector: str = "embedding",
    blocks: Blocks = Blocks(),
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest products with all others, for every ``query_every``-th id.

    Ids are whole numbers; rows without one take no part. Every row is a candidate, also one that
    repeats another, but not those with the query's own id; queries that are equal are asked once.
    Only vectors of a query's dimension are candidates; those without components have products of 0.
    Ties go to the smaller id; with fewer candidates than k all are given. Products must fit 64 bits.
    """
    given = whole_numbers(vectors, scale, id_column, vector).filter("id IS NOT NULL")
    # Of rows that repeat no more than k can be among the best, so that a hot one is no hot block.
    distinct = given.groupBy("id", "x").agg(F.first("dim").alias("dim"), F.first("norm2").alias("norm2"), F.count(F.lit(1)).alias("copies"))
    distinct = staged(distinct, "vectors")
    whole = distinct.select("id", "x", "dim", "norm2", F.explode(F.array_repeat(F.lit(0), F.least("copies", F.lit(k)).cast("int")))).drop("col")
    # Lengths fall into steps of one part in 64, from which blocks of bounded size are cut in order.
    cut = blocks.vectors
    step = F.floor(F.log2(F.greatest(F.col("norm2"), F.lit(0.5))) * 32)
    steps = whole.groupBy("dim", step.alias("step")).agg(F.count(F.lit(1)).alias("rows"))
    longer = Window.partitionBy("dim").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    placed = steps.withColumn("first", F.floor(F.coalesce(F.sum("rows").over(longer), F.lit(0)) / cut)).withColumn(
        "last", F.floor((F.coalesce(F.sum("rows").over(longer), F.lit(0)) + F.col("rows") - 1) / cut)
    )
    spread = F.col("first") + F.pmod(F.xxhash64("id"), F.col("last") - F.col("first") + 1)
    blocked = staged(
        whole.withColumn("step", step).join(placed.drop("rows"), ["dim", "step"]).select("id", "x", "dim", "norm2", spread.cast("long").alias("vector_block")),
        "blocks",
    )
    asked = distinct.filter(F.col("id") % query_every == 0).select("id", "x", "dim", "norm2")
    n_blocks = max(1, -(-asked.count() // blocks.queries))
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))

    # First round: what each query reaches among the longest vectors.
    longest = blocked.groupBy("dim", "vector_block").agg(F.max("norm2").alias("longest2"))
    top = longest.groupBy("dim").agg(F.min("vector_block").alias("vector_block"))
    start = asked.join(top, "dim").withColumn("reach", F.lit(None).cast("double"))
    columns = ["id", "x", "dim", "query_block", "vector_block"]
    met = blocked.join(top, ["dim", "vector_block"]).withColumn("query_block", _each(n_blocks))
    first = staged(_ranked(_searched(start.select(*columns, "reach"), met, k, blocks), k), "first")

    # Second round: all other blocks that are long enough for what the query has to reach.
    reached = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("reach"))
    others = longest.join(top, ["dim", "vector_block"], "left_anti")
    sent = (
        asked.join(reached, "id", "left")
        .join(others, "dim")
        .filter("reach IS NULL OR reach <= sqrt(norm2 * longest2) * (1 + 1e-9)")
        .select(*columns, "reach")
    )
    # A block of vectors goes to the blocks of queries that have one to put to it.
    cells = staged(sent.select("dim", "vector_block", "query_block").distinct(), "cells")
    rest = blocked.join(cells, ["dim", "vector_block"])
    second = _ranked(_searched(sent, rest, k, blocks), k)
    return _ranked(first.drop("rank").unionByName(second.drop("rank")), k).select("query_id", "rank", "vec_id", "score")


def _each(n_blocks: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
