"""The largest products against brute force over whole numbers."""

import math

import numpy as np
import pytest

from tallydesk.llm import topk


def brute(rows, k):
    def whole(vector):
        if vector is None or any(x is None or not math.isfinite(x) for x in vector):
            return None
        return [math.floor(256 * x) for x in vector]

    vectors = [(n, tuple(x)) for n, v in rows if n is not None and (x := whole(v)) is not None]
    found = []
    for q, x in set(vectors):
        if q % 50:
            continue
        scored = [(sum(a * b for a, b in zip(x, y, strict=True)), n) for n, y in vectors if n != q and len(x) == len(y)]
        scored.sort(key=lambda pair: (-pair[0], pair[1]))
        found += [(q, rank, n, s) for rank, (s, n) in enumerate(scored[:k], 1)]
    return sorted(found)


def search(spark, rows, **blocks):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(row) for row in topk.top_products(df, blocks=topk.Blocks(**blocks)).collect())


@pytest.mark.parametrize("kind", ["unit", "lengths", "clusters", "ties", "negative"])
@pytest.mark.parametrize("blocks", [{}, {"vectors": 64, "queries": 3, "bucket": 16}])
def test_same_as_brute_force(spark, kind, blocks):
    draw = np.random.default_rng(3)
    v = draw.standard_normal((400, 12))
    if kind == "unit":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "lengths":
        v *= draw.lognormal(0, 2, (400, 1))
    if kind == "clusters":
        v = v[draw.integers(0, 6, 400)] + 0.05 * v
    if kind == "ties":
        v = np.round(v[draw.integers(0, 9, 400)])
    if kind == "negative":
        v = -np.abs(v)
        v[::50] = np.abs(v[::50])
    rows = [(n, [float(np.float32(x)) for x in vector]) for n, vector in enumerate(v)]
    assert search(spark, rows, **blocks) == brute(rows, 5)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, None), (100, [nan, 1.0]), (1, [inf, 1.0]), (2, [None, 1.0]), (3, []), (None, [9.0, 9.0])]
    rows += [(4, [1.0, 1.0]), (4, [1.0, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 1.0, 1.0]), (150, [2.0]), (-50, [0.0, -1.0])]
    assert search(spark, rows) == brute(rows, 5)


def test_fewer_candidates_than_asked_for_and_none_at_all(spark):
    assert search(spark, [(0, [1.0]), (7, [2.0])]) == [(0, 1, 7, 256 * 512)]
    assert search(spark, [(0, [1.0])]) == [] and search(spark, []) == []


def test_one_common_vector(spark):
    rows = [(n, [0.5, 0.25]) for n in range(600)] + [(n, [0.1, 0.1]) for n in range(600, 650)]
    assert search(spark, rows, vectors=64, queries=4, bucket=16) == brute(rows, 5)


@pytest.mark.parametrize("blocks", [{}, {"vectors": 64, "queries": 3, "bucket": 16}])
def test_large_components_take_part(spark, blocks):
    """Multiples of 2^31 and more, products beyond 2^53."""
    draw = np.random.default_rng(8)
    v = draw.uniform(-1, 1, (300, 3)) * 10.0 ** draw.uniform(0, 7.3, (300, 1))
    v[::50] = draw.uniform(-1e6, 1e6, (6, 3))
    rows = [(n, [float(np.float32(x)) for x in vector]) for n, vector in enumerate(v)] + [(999, [0.0, 1e12, 0.0])][: not blocks]
    if not blocks:
        rows = [(n, [x / 1e6 for x in vector] if n % 50 == 0 else vector) for n, vector in rows]
        rows = [(n, [float(np.float32(x)) for x in vector]) for n, vector in rows]
    assert search(spark, rows, **blocks) == brute(rows, 5)


def test_products_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="too large|too big|64 bits"):
        search(spark, [(0, [1e12]), (1, [1e12])])
    with pytest.raises(Exception, match="64 bits"):
        search(spark, [(0, [1.0]), (1, [1e30])])


def test_repeated_rows_are_candidates_as_often_as_they_stand_there(spark):
    rows = [(0, [1.0, 0.0])] * 3 + [(1, [2.0, 0.0])] * 3 + [(2, [1.5, 0.0])] * 400 + [(3, [1.0, 1.0]), (100, [0.5, 0.5])]
    assert search(spark, rows) == brute(rows, 5)
    assert [row[2] for row in search(spark, rows) if row[0] == 0] == [1, 1, 1, 2, 2]


def test_vectors_without_components(spark):
    rows = [(0, []), (50, []), (1, []), (2, [1.0]), (100, [2.0])]
    assert search(spark, rows) == brute(rows, 5)
    assert (0, 1, 1, 0) in search(spark, rows)


def test_blocks_go_only_where_a_query_needs_them(spark):
    """Short vectors cannot reach what the long ones give: no cell of theirs is formed."""
    draw = np.random.default_rng(5)
    rows = [(n, [float(x) for x in np.float32(draw.standard_normal(8) * (100 if n < 64 else 0.01))]) for n in range(600)]
    rows = [(n, [abs(x) for x in v]) for n, v in rows]
    assert search(spark, rows, vectors=64, queries=3) == brute(rows, 5)
