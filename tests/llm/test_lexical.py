"""Ranked search by ball trees against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallydesk.llm import lexical
from tallydesk.llm.lexical import Trees

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL_TREES = Trees(documents=40, entries=300, leaf=4)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, k):
    bags = [(n, Counter(found)) for n, text in docs if (found := terms(text))]
    documents, total = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(term for _, bag in bags for term in bag)
    rows = []
    for item, text in {(item, text or "") for item, text in queries}:
        scored = []
        for n, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * documents) // total
            score = 0
            for term in set(terms(text)):
                if bag[term]:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[term] + 1)))
                    score += w * ((1_000_000_000 * bag[term]) // (1000 * bag[term] + 8 * m))
            if score > 0:
                scored.append((-score, n is None, n))
        scored.sort(key=lambda x: x[:2] if x[1] else x)
        rows += [(item, rank, n, -score) for rank, (score, _, n) in enumerate(scored[:k], 1)]
    return sorted(rows, key=repr)


def found(spark, docs, queries, k=10, sizes=SMALL_TREES):
    given = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(queries, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.rank(given, asked, k, sizes=sizes).collect()), key=repr)


def corpus(seed, documents=400):
    """Two languages, copies of some documents, and lengths from none to hundreds of words."""
    draw = random.Random(seed)
    words = [[f"{a}{n}" for n in range(60)] for a in ("Wo", "É")]
    texts = []
    for _ in range(documents):
        if texts and draw.random() < 0.3:
            texts.append(draw.choice(texts))
        else:
            texts.append(", ".join(draw.choices(draw.choice(words), k=int(draw.lognormvariate(2, 1.2)))))
    return [(n * 7 % 1009, text) for n, text in enumerate(texts)]


@pytest.mark.parametrize("sizes, k", [(Trees(), 10), (SMALL_TREES, 1), (SMALL_TREES, 10), (Trees(documents=40, leaf=1, batch_bytes=300), 10)])
def test_same_as_scoring_every_document(spark, sizes, k):
    docs = corpus(4)
    queries = [(n, text) for n, text in enumerate(t for _, t in docs[::19])] + [(900, "wo1 É2 wo1"), (901, "none such"), (902, ""), (903, None)]
    assert found(spark, docs, queries, k, sizes) == brute(docs, queries, k)


def test_bounds_hold_and_prune():
    """No leaf holds a score above the bound of any node over it; a good floor leaves most leaves out."""
    draw = np.random.default_rng(2)
    groups = [draw.choice(300, 20, replace=False) for _ in range(12)]
    rows = [np.unique(np.concatenate([draw.choice(groups[n % 12], 12), draw.choice(300, 1)])) for n in range(600)]
    indptr = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    own = np.concatenate(rows).astype(np.int64)
    values = draw.integers(1, 1_000_000, len(own))
    tree = lexical.TreeSearch(lexical._packed(lexical.build_tree(indptr, own, values, 300, 8)), 300)
    nodes = tree.tree["nodes"]
    visited = everything = 0
    for n in range(0, 600, 40):
        asked = np.unique(rows[n])
        weights = draw.integers(1, 9_000, len(asked)).astype(np.int64)
        dense = np.zeros(300, np.int64)
        dense[asked] = weights
        exact = np.array([int((dense[own[a:b]] * values[a:b]).sum()) for a, b in zip(indptr, indptr[1:])])
        for node, (start, end, left, _) in enumerate(nodes):
            held = tree.tree["order"][start:end]
            assert exact[held].max() <= tree.bound(node, asked, weights)
            if left < 0:
                at, scores = tree.scores(node, asked, weights)
                assert (scores == exact[at]).all()
        floor = int(np.sort(exact)[-1])
        visited += len(list(tree.leaves(asked, weights, lambda floor=floor: floor)))
        everything += int((nodes[:, 2] < 0).sum())
    assert visited < everything / 2


def test_equal_documents_beyond_a_leaf(spark):
    docs = [(n, "same words here") for n in range(100, 0, -1)] + [(None, "same words here"), (200, "other text entirely")]
    queries = [(1, "same"), (2, "text words")]
    assert found(spark, docs, queries) == brute(docs, queries, 10)
    every = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "same")], "item_id long, text string"), 102, sizes=SMALL_TREES)
    assert [row["doc_id"] for row in every.orderBy("rank").collect()] == [*range(1, 101), None]


def test_nulls_repeated_rows_and_clashing_names(spark):
    docs = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (4, "..."), (None, "a"), (5, "B é")]
    queries = [(1, "A"), (1, "A"), (1, "b"), (None, "é"), (7, None)]
    assert found(spark, docs, queries) == brute(docs, queries, 10)
    wide = spark.createDataFrame([(1, "a b", 2, 3, 4.0)], "doc_id long, text string, rank int, Score int, `x.y` double")
    asked = spark.createDataFrame([(1, "a", "q")], "item_id long, text string, query string")
    assert lexical.rank(wide, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_a_very_long_text(spark):
    docs = [(1, "far " * 300_000 + "needle"), (2, "needle far"), (3, "x" * 3_000_000)]
    queries = [(1, "needle"), (2, "far needle"), (3, "x" * 3_000_000)]
    assert found(spark, docs, queries) == brute(docs, queries, 10)


@pytest.mark.parametrize("docs, queries", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")])])
def test_nothing_to_find(spark, docs, queries):
    assert found(spark, docs, queries) == []
