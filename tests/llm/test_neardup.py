"""Near-duplicates and components against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallydesk.llm import components as stars
from tallydesk.llm import neardup
from tallydesk.llm.components import components, with_links


def shingles(text, width):
    found = (text or "").encode().lower().split()
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[n : n + width]) for n in range(len(found) - width + 1)}


def brute(rows, width):
    """component of each id: the least id reachable over links."""
    sets = {}
    for doc, text in rows:
        if doc is not None:
            sets[doc] = shingles(text, width)
    parent = {doc: doc for doc in sets}

    def root(doc):
        while parent[doc] != doc:
            doc = parent[doc]
        return doc

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                one, two = root(a), root(b)
                parent[max(one, two)] = min(one, two)
    return {doc: root(doc) for doc in ids}


def corpus(seed=5):
    draw = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(300)]
    rows = []
    for group in range(25):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 5, 30, 120]))]
        for copy in range(draw.choice([1, 2, 6, 20])):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 5])):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            rows.append((group * 100 + copy, " ".join(words)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_are_those_of_brute_force(spark, width):
    rows = corpus()
    rows += [(9001, None), (9002, ""), (9003, " \n "), (9004, "One"), (9005, "oNE"), (9006, "a b"), (9007, "A  B\n")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.MinMax(width=width)).collect()
    expected = brute(rows, width)
    assert {row["doc_id"]: row["component_id"] for row in got} == expected
    texts = dict(rows)
    assert all(row["n_shingles"] == len(shingles(texts[row["doc_id"]], width)) for row in got)
    assert all(row["kept"] == (row["doc_id"] == row["component_id"]) for row in got)


def test_a_large_group_without_a_common_centre_stays_whole(spark):
    """A chain: each text shares enough with the next one only."""
    rows = [(n, " ".join(f"x{k}" for k in range(2 * n, 2 * n + 60))) for n in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.MinMax(width=2))
    assert {row["component_id"] for row in got.collect()} == {0}


def test_null_ids_repeats_and_clashing_names(spark):
    rows = [(None, "a b c", 1), (None, "p q r", 1), (None, "p q r", 1), (4, "a b c", 2), (4, "a b c", 2), (9, "a b c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hi long").withColumn("node", F.lit("n"))
    found = neardup.near_duplicates(docs, neardup.MinMax(width=2))
    got = sorted((row["doc_id"] or 0, row["component_id"] or 0, row["kept"]) for row in found.collect())
    assert got == [(0, 0, True), (0, 0, True), (0, 4, False), (4, 4, True), (4, 4, True), (9, 4, False)]
    kept = neardup.keep_one(docs, found)
    assert kept.columns == docs.columns
    assert sorted((row["doc_id"] or 0, row["text"]) for row in kept.collect()) == [(0, "p q r"), (4, "a b c")]


def text_of(letter, changed=0):
    return " ".join([*[f"{letter}{n}" for n in range(40 - changed)], *[f"new{n}" for n in range(changed)]])


def test_near_copies_without_ids_take_part(spark):
    rows = [(None, text_of("a")), (None, text_of("a", 1)), (None, text_of("a", 1)), (None, text_of("a", 1).upper())]
    rows += [(7, text_of("b")), (None, text_of("b", 3)), (3, text_of("b", 6)), (None, ""), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.near_duplicates(docs, neardup.MinMax(width=2))
    assert sorted(row["component_id"] or 0 for row in found.collect()) == [0] * 6 + [3] * 3
    kept = [(row["doc_id"], row["text"]) for row in neardup.keep_one(docs, found).collect()]
    assert len(kept) == 4 and {(3, rows[6][1]), (None, ""), (None, "alone")} < set(kept)
    assert sum((row[1] or "").lower().startswith("a0") for row in kept) == 1


def test_every_text_of_an_id_is_linked(spark):
    rows = [(5, text_of("z")), (5, text_of("a")), (8, text_of("a", 2)), (9, text_of("z", 2)), (2, text_of("q")), (6, text_of("a"))]
    rows += [(1, "other"), (6, text_of("c")), (4, text_of("c", 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.near_duplicates(docs, neardup.MinMax(width=2)).collect()
    assert {row["doc_id"]: row["component_id"] for row in found} == {5: 4, 8: 4, 9: 4, 6: 4, 4: 4, 2: 2, 1: 1}


def test_no_rows_give_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).count() == 0


def test_components_of_random_links(spark):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(n, n + 1) for n in range(1000, 1100)]
    parent = {n: n for link in links for n in link}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        one, two = root(a), root(b)
        parent[max(one, two)] = min(one, two)
    got = {row["node"]: row["component"] for row in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: root(n) for n in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_each_table_of_a_round_has_one_join(spark, monkeypatch):
    joins = []

    def counted(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return staged(df, name)

    staged = stars.staged
    monkeypatch.setattr(stars, "staged", counted)
    found = components(spark.createDataFrame([(2, 1), (3, 2), (9, 8)], "u long, v long"))
    assert {tuple(row) for row in found.collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert max(joins) == 1


def test_more_links_join_components(spark):
    first, more = ([(5, 4), (4, 3), (9, 8), (20, 21)], [(8, 5), (30, 31), (9, 9)])
    kind = "u long, v long"
    both = with_links(components(spark.createDataFrame(first, kind)), spark.createDataFrame(more, kind))
    at_once = components(spark.createDataFrame(first + more, kind))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, at_once.collect()))


def test_steps_that_have_nothing_to_do_are_left_out(spark, monkeypatch):
    asked = []

    def counted(how, one, other):
        asked.append((one, other))
        return may_link(how, one, other)

    may_link = neardup._may_link
    monkeypatch.setattr(neardup, "_may_link", counted)
    words = [f"w{n}" for n in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, "other")], "doc_id long, text string")
    got = {row["doc_id"]: row["component_id"] for row in neardup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert len(asked) == 1
